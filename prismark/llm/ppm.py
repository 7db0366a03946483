"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ORDER bytes with frozen counts. A byte is looked for in the longest context
that the language has seen. If it is there it costs -log(n / (total + distinct)) of that context; if not, an escape of cost
-log(distinct / (total + distinct)) leads to the context shorter by one byte, in which the bytes of the longer one are
excluded from total and distinct. Below the empty context all bytes not seen there are alike. A text's language is the one whose
tree gives the shortest code, its prior included.

A text starts in a context of zero bytes. Exclusion depends only on the context from which an escape came, since a longer
context's bytes are among a shorter one's; so every node of a tree carries the two numbers its parent has for those that come
from it. For strings of ORDER + 1 bytes that any language has seen, whole costs are tabulated in all languages: most bytes
take one look-up, and the others walk down the contexts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

#: Documents of each language, about, that the trees are made of.
TRAIN_DOCS = 1500
#: Bytes of the longest context; 7 at most.
ORDER = 4


def padded(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with `order` zero bytes before each document, and where the documents' own bytes then are."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(buf)) + order * (doc + 1)
    out = np.zeros(len(buf) + order * (len(offsets) - 1), np.uint8)
    out[at] = buf
    return out, at


def grams(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, the bytes before it and itself as one number."""
    out, at = padded(buf, offsets, order)
    code = out[at].astype(np.uint64)
    for k in range(1, order + 1):
        code |= out[at - k].astype(np.uint64) << np.uint64(8 * k)
    return code


def _last(code: np.ndarray, n: int) -> np.ndarray:
    return code & np.uint64((1 << (8 * n)) - 1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, counts, len(kinds))


def _table(keys: np.ndarray) -> wordhash.Table:
    out = wordhash.Table()
    out.add(keys)
    return out


class Trees:
    """The frozen context trees of all languages as tables; the last row of each stands for what none has seen."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], docs: dict[str, int], order: int = ORDER):
        """counts: of each language, the strings of order + 1 bytes and how often each occurs."""
        self.languages, self.order = sorted(counts), order
        n = len(self.languages)
        whole = max(1, sum(docs.values()))
        self.prior = np.array([-np.log(docs[x] / whole) for x in self.languages])
        if not n:
            return
        by_order = {o: [_summed(_last(counts[x][0].astype(np.uint64), o + 1), counts[x][1].astype(float)) for x in self.languages] for o in range(order + 1)}
        union = {o: np.unique(np.concatenate([keys for keys, _ in by_order[o]])) for o in by_order}
        contexts = {o: np.unique(union[o] >> np.uint64(8)) for o in by_order}
        self.strings, self.contexts = ({o: _table(x[o]) for o in by_order} for x in (union, contexts))
        blank = lambda rows: {o: np.zeros((len(rows[o]) + 1, n), np.float32) for o in by_order}
        self.count = {o: np.full((len(union[o]) + 1, n), -np.inf, np.float32) for o in by_order}  # log of how often
        self.known = {o: np.zeros((len(contexts[o]) + 1, n), bool) for o in by_order}
        self.base, self.escape = blank(contexts), blank(contexts)  # without exclusion
        self.parent_base, self.parent_escape = blank(contexts), blank(contexts)  # of the context shorter by one, for those that escape from here
        self.rest = np.zeros(n)
        for k in range(n):
            total, distinct = {}, {}
            for o in range(order + 1):
                keys, c = by_order[o][k]
                seen, at = np.unique(keys >> np.uint64(8), return_inverse=True)
                row = np.searchsorted(contexts[o], seen)
                total[o], distinct[o] = np.bincount(at, c, len(seen)), np.bincount(at, minlength=len(seen))
                self.count[o][np.searchsorted(union[o], keys), k] = np.log(c)
                self.known[o][row, k] = True
                self.base[o][row, k] = np.log(total[o] + distinct[o])
                self.escape[o][row, k] = np.log(total[o] + distinct[o]) - np.log(distinct[o])
                if o:
                    shorter, below = by_order[o - 1][k]
                    up = np.searchsorted(np.unique(shorter >> np.uint64(8)), _last(seen, o - 1) if o > 1 else np.zeros(len(seen), np.uint64))
                    left = total[o - 1][up] - np.bincount(at, below[np.searchsorted(shorter, _last(keys, o))], len(seen))
                    kinds = distinct[o - 1][up] - distinct[o]
                    some = np.maximum(kinds, 1)
                    self.parent_base[o][row, k] = np.where(kinds > 0, np.log(np.maximum(left + kinds, 1)), 0)
                    self.parent_escape[o][row, k] = np.where(kinds > 0, np.log(np.maximum(left + kinds, 1)) - np.log(some), 0)
            self.rest[k] = np.log(max(1, 256 - distinct[0][0]))
        self.cost = self._walk(union[order]).astype(np.float32)

    def _walk(self, codes: np.ndarray) -> np.ndarray:
        """The cost of each string's last byte in each language, context by context."""
        out = np.zeros((len(codes), len(self.languages)))
        open_ = np.ones(out.shape, bool)
        came = None
        for o in range(self.order, -1, -1):
            row, context = self.strings[o].find(_last(codes, o + 1)), self.contexts[o].find(_last(codes, o + 1) >> np.uint64(8))
            known, base, escape = self.known[o][context], self.base[o][context], self.escape[o][context]
            if came is not None:
                above = self.known[o + 1][came]
                base, escape = np.where(above, self.parent_base[o + 1][came], base), np.where(above, self.parent_escape[o + 1][came], escape)
            count = self.count[o][row]
            hit = open_ & np.isfinite(count)
            out[hit] += (base - count)[hit]
            open_ &= ~hit
            out += np.where(open_ & known, escape, 0)
            came = context
        return out + np.where(open_, self.rest, 0)

    def price(self, codes: np.ndarray) -> np.ndarray:
        """The cost of each byte in each language."""
        row = self.strings[self.order].find(codes)
        out = self.cost[np.minimum(row, len(self.cost) - 1)]
        new = np.flatnonzero(row < 0)
        if len(new):
            out[new] = self._walk(codes[new])
        return out

    def code_lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Nats of each document in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for a, b in wordhash.chunks(offsets, 1 << 19):
            part = offsets[a : b + 1] - offsets[a]
            full = np.flatnonzero(np.diff(part))
            if len(full):
                cost = self.price(grams(buf[offsets[a] : offsets[b]], part, self.order))
                out[a + full] = np.add.reduceat(cost, part[full], axis=0, dtype=np.float64)
        return out

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the best language, and its posterior."""
        total = self.code_lengths(buf, offsets) + self.prior
        best = total.argmin(1)
        return best, 1 / np.exp(np.minimum(700, -(total - total.min(1, keepdims=True)))).sum(1)


def _count_grams(batches):
    """Counts of the strings of ORDER + 1 bytes of each language, summed over about a million bytes at a time."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        buf, offsets = wordhash.buffers(batch.column(0))
        for a, b in wordhash.chunks(offsets):
            codes = grams(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            of_byte = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            for name in sorted(set(langs[a:b])):
                mine = np.array([x == name for x in langs[a:b]])
                kinds, n = np.unique(codes[mine[of_byte]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, fold: tuple[int, int] = (5, 0)) -> Trees:
    """Trees of every language of the documents outside the held-out fold.

    About `train_docs` documents of each language are taken, whole, by a hash of their id; how many there are is counted
    over all. Only sums by language and string, bounded by that sample, reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold[0] != fold[1])).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, float(min(1.0, train_docs / n))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    found = sample.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(found.column("lang").to_pylist(), object)
    keys, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    kept = {x: langs == x for x in sizes}
    return Trees({x: (keys[m], n[m]) for x, m in kept.items() if m.any()}, {x: sizes[x] for x, m in kept.items() if m.any()})


def _predict(shared):
    def run(batches):
        trees: Trees = shared.value
        for batch in batches:
            texts = batch.column(1)
            lettered = pa.compute.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            if not trees.languages:
                best, score = np.zeros(len(lettered), int), np.zeros(len(lettered))
            else:
                best, score = trees.predict(*wordhash.buffers(texts))
            names = [trees.languages[k] if ok and trees.languages else "und" for k, ok in zip(best.tolist(), lettered)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, by its whole text.

    `und` with score 0 for null texts, texts without a letter (Unicode category L), and where no language was learned. Equal costs go to the
    first language by name. Repeated rows stay; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return docs.mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS, fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trees from the documents outside the fold, predictions for all."""
    held = (F.crc32(F.col("doc_id").cast("string")) % fold[0] == fold[1]).alias("held_out")
    return identify(docs, train(docs, train_docs, fold)).select("doc_id", held, "lang_pred", "score")


def in_fold(doc_id: int, fold: tuple[int, int]) -> bool:
    return zlib.crc32(str(doc_id).encode()) % fold[0] == fold[1]
