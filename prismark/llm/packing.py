"""Packing by lexical retrieval.

Documents are dealt by what they say: each has a key, its weighted minimum hash over words, so two documents share a key with
the chance of their weighted overlap, where rare words weigh most; words are counted over all rows. Rows are sorted by key, and each stretch of about
SHARD_BYTES of text is a shard with an inverted index over its documents' tokens with BM25 weights. The first unused document is
a seed and opens a sequence; the index returns its unused neighbours by falling score, and they fill the window greedily. A
document that does not fit is cut, and its rest is the next seed. So every sequence is full; what remains in a shard is cut
into sequences whose lengths are powers of two, which need no padding.

Of documents with the same tokens a window takes one, as long as its shard has others.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .store import discard, durable
from .tokens import CHUNK_BYTES, Encoder

WINDOW = 4096
END = 2
#: Bytes of text, about, in a shard, and in a task, which has its shards one after another.
SHARD_BYTES, TASK_BYTES = 4 << 20, 64 << 20
#: Parts of the range of keys for each task.
PARTS = 4
K1, B = 1.2, 0.75
#: What is broadcast: at most so many words and keys with counts of their own, told by their shares, and cells that all other words share.
WORDS, FREQUENT, CELL_BITS = 20_000, 1 << 20, 20
#: Distinct words that a task holds before it hands on their counts.
HELD = 1 << 19

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 over the token ids of a shard's documents; a token in over half of them has no weight, by Robertson's formula."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        size = np.array([len(x) for x in ids])
        flat = np.concatenate(ids).astype(np.int64) if n else np.zeros(0, np.int64)
        pair = np.sort(flat * max(n, 1) + np.repeat(np.arange(n), size))
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, int)
        tf = np.diff(np.append(first, len(pair)))
        term, self.doc = np.divmod(pair[first], max(n, 1))
        at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, int)
        self.starts = np.append(at, len(term))
        df = np.diff(self.starts)
        place = np.repeat(np.arange(len(df)), df)
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
        norm = K1 * (1 - B + B * size / max(1.0, size.mean() if n else 1.0))
        self.weight = idf[place] * tf * (K1 + 1) / (tf + norm[self.doc])
        told = np.flatnonzero((idf > 0)[place] & (df > 1)[place])
        order = told[np.argsort(self.doc[told], kind="stable")]
        self.terms, self.of = place[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a weighted token with the seed, best first, ties by place."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        many = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        if 8 * len(at) < self.n:  # a seed with few postings does not look at all documents
            docs, place = np.unique(self.doc[at], return_inverse=True)
            scores = np.bincount(place, self.weight[at], len(docs)) * unused[docs]
        else:  # and one with many does not sort them
            docs, scores = np.arange(self.n), np.bincount(self.doc[at], self.weight[at], self.n) * unused
        found = np.flatnonzero(scores > 0)
        return docs[found[np.argsort(-scores[found], kind="stable")]]


class Seeds:
    """The first unused document that equals none of the open sequence, else the first unused one.

    Equal documents form a class, and a heap holds the first unused one of each; classes of the open sequence are set
    aside until it closes. So a seed costs the logarithm of the number of classes, not a look at all documents.
    """

    def __init__(self, alike: np.ndarray, unused: np.ndarray, inside: set[int]):
        self.alike, self.unused, self.inside, self.first, self.aside = alike, unused, inside, 0, []
        order = np.argsort(alike, kind="stable")
        self.next = np.full(len(alike), -1)
        same = alike[order[1:]] == alike[order[:-1]]
        self.next[order[:-1][same]] = order[1:][same]
        self.heap = np.sort(order[np.append(True, ~same)]).tolist() if len(alike) else []

    def closed(self) -> None:
        for doc in self.aside:
            heapq.heappush(self.heap, doc)
        self.aside = []

    def take(self) -> int | None:
        while self.heap:
            doc = heapq.heappop(self.heap)
            while doc >= 0 and not self.unused[doc]:
                doc = int(self.next[doc])
            if doc < 0:
                continue
            if int(self.alike[doc]) in self.inside:
                self.aside.append(doc)
                continue
            heapq.heappush(self.heap, doc)  # until it is used; then those equal to it come
            if doc == self.heap[0]:
                return doc
        while self.first < len(self.unused) and not self.unused[self.first]:
            self.first += 1
        return self.first if self.first < len(self.unused) else None


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def arrange(ids: list[np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    index = Index(ids)
    size = [len(x) for x in ids]
    names: dict[bytes, int] = {}
    alike = np.array([names.setdefault(x.tobytes(), len(names)) for x in ids], int)
    unused = np.ones(len(ids))
    out: list[tuple[int, int, int, int, int]] = []
    left = sum(size)
    frames = [window] * (left // window) + powers_of_two(left % window)
    sequence = offset = 0
    inside: set[int] = set()

    def put(doc: int, start: int) -> int:
        """Lay tokens of a document from `start` into the open sequence; how many are laid afterwards."""
        nonlocal sequence, offset
        length = min(size[doc] - start, frames[sequence] - offset)
        out.append((doc, start, length, sequence, offset))
        inside.add(int(alike[doc]))
        offset += length
        if offset == frames[sequence]:
            sequence, offset = sequence + 1, 0
            inside.clear()
            seeds.closed()
        return start + length

    seeds = Seeds(alike, unused, inside)
    rest: tuple[int, int] | None = None
    while True:
        if rest is not None:
            seed, start = rest
        else:
            seed, start = seeds.take(), 0
            if seed is None:
                return out
            unused[seed] = 0
        rest = None
        start = put(seed, start)
        while start < size[seed]:  # a document longer than a window goes on in the next
            start = put(seed, start)
        if not offset:
            continue
        for doc in index.neighbours(seed, unused).tolist():
            if int(alike[doc]) in inside:
                continue
            unused[doc] = 0
            start = put(doc, 0)
            if start < size[doc]:
                rest = (doc, start)
            if not offset:
                break


class Keys:
    """Weights of all words, and the keys that are frequent with the parts they are spread over.

    Frequent words have weights of their own; each other word has that of the most frequent word of its cell.
    """

    def __init__(self, words: np.ndarray, weights: np.ndarray, cells: np.ndarray):
        self.table = wordhash.Table()
        self.table.add(words)
        self.weights, self.cells = np.append(weights, 0.0), cells
        self.frequent, self.spread = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def weights_of(self, words: np.ndarray) -> np.ndarray:
        row = self.table.find(words)
        return np.where(row >= 0, self.weights[row], self.cells[(words >> np.uint64(64 - CELL_BITS)).astype(np.int64)])

    def of_texts(self, buf: np.ndarray, offsets: np.ndarray, second: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, second key, hash of the whole text) of each document; those without words have their text's hash as keys, as all have for the second if it is not asked for."""
        low = wordhash.lower(buf)
        sums = wordhash.prefix_sums(low)
        starts, ends, firsts = wordhash.word_spans(low, offsets)
        whole = wordhash.substring_hashes(sums, offsets[:-1], offsets[1:])
        keys = [whole.copy(), whole.copy()]
        full = np.flatnonzero(np.diff(firsts))
        if len(full):
            words = wordhash.substring_hashes(sums, starts, ends)
            weight = self.weights_of(words)
            doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            for k, key in enumerate(keys if second else keys[:1]):
                mixed = wordhash.mix(words + np.uint64(k + 1))
                value = -np.log((mixed >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54) / weight
                least = np.full(len(firsts) - 1, np.inf)
                least[full] = np.minimum.reduceat(value, firsts[full])
                best = np.flatnonzero(value == least[doc])
                key[doc[best]] = wordhash.mix(mixed[best] + np.uint64(1))  # the least value has a great hash, so it is mixed anew
        return keys[0], keys[1], whole

    def part(self, key: np.ndarray, draw: np.ndarray, parts: int) -> np.ndarray:
        """Keys in order are parts in order; a frequent key has several."""
        base = (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)
            many = np.where(self.frequent[at] == key, self.spread[at], 1)
            base = (base + (draw % many.astype(np.uint64)).astype(np.int64)) % parts
        return base


def _words(batches):
    """How many documents have each word, added up over stretches of a task's documents."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added():
        kinds, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(kinds)
        kinds = kinds[order]
        at = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])[: len(kinds)])
        n = np.diff(np.append(0, np.cumsum(n[order]))[np.append(at, len(kinds))])
        return pa.RecordBatch.from_arrays([pa.array(kinds[at].view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        buf, offsets = wordhash.buffers(batch.column(0))
        for a, b in wordhash.chunks(offsets):
            words, firsts = wordhash.words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            doc = np.repeat(np.arange(1, b - a + 1, dtype=np.uint64), np.diff(firsts))
            pair = wordhash.mix(words + doc * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(pair)
            pair = pair[order]
            words = np.sort(words[order[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]])  # each once for each of its documents
            at = np.flatnonzero(np.append(True, words[1:] != words[:-1])[: len(words)])
            held.append((words[at], np.diff(np.append(at, len(words)))))
            if sum(len(k) for k, _ in held) >= HELD:
                yield added()
    if held:
        yield added()


def _keys(shared):
    def run(batches):
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(0))
            for a, b in wordhash.chunks(offsets):
                key, _, _ = shared.value.of_texts(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], second=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.diff(offsets[a : b + 1]) + 64)], names=["key", "bytes"])

    return run


def _size(docs: DataFrame):
    """Rows, and bytes with 64 for each row."""
    return docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64), F.lit(0)).alias("bytes")).first()


def lexical_keys(docs: DataFrame, rows: int, parts: int, total: int | None = None, words: int = WORDS) -> Keys:
    """Words and keys are counted over all rows; `total` is `_size`'s bytes.

    Shares bound what has an entry of its own: at most `words` words have a part of 1 / `words` of all (document, word)
    pairs. A key is spread over twice as many parts as its bytes are parts' worth.
    """
    spark = docs.sparkSession
    total = _size(docs)["bytes"] if total is None else total
    counts = durable(docs.select("text").mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("n") * words >= pairs
    found = counts.where(often).toArrow()
    others = counts.where(~often).groupBy(F.shiftrightunsigned("word", 64 - CELL_BITS).alias("cell")).agg(F.max("n").alias("n")).toArrow()
    discard(counts)
    cells = np.full(1 << CELL_BITS, np.log1p(max(rows, 1)))
    cells[others.column("cell").to_numpy()] = np.log1p(rows / others.column("n").to_numpy())
    out = Keys(found.column("word").to_numpy().view(np.uint64), np.log1p(rows / found.column("n").to_numpy()), cells)
    keyed = docs.select("text").mapInArrow(_keys(spark.sparkContext.broadcast(out)), "key long, bytes long").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    hot = keyed.where((F.col("n") >= 8) & (F.col("bytes") >= total / min(2 * parts, FREQUENT))).toArrow()
    key = hot.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    out.frequent, out.spread = key[order], np.minimum(parts, np.ceil(2 * parts * hot.column("bytes").to_numpy()[order] / max(total, 1))).astype(np.int64)
    return out


def _deal(shared, parts: int):
    def run(batches):
        keys: Keys = shared.value
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy().view(np.uint64)
            for a, b in wordhash.chunks(offsets):
                key, other, whole = keys.of_texts(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = keys.part(key, wordhash.mix(whole + ids[a:b] * np.uint64(0x9E3779B97F4A7C15)), parts)
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), pa.array(part), pa.array(key.view(np.int64)), pa.array(other.view(np.int64))], names=[*batch.schema.names, "part", "key", "other"])

    return run


def _pack(vocabulary: str, window: int, end: int, shard_bytes: int):
    """The pieces of a task's sorted rows, shard by shard; a sequence's id has the task's number above its own."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def shard(ids_of: list, texts: list, first: int):
        encoder, ids = Encoder.of(vocabulary), []
        buf, offsets = wordhash.buffers(pa.chunked_array(texts, pa.string()))
        for a, b in wordhash.chunks(offsets, CHUNK_BYTES):
            flat, starts = encoder.ids(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids += [np.append(flat[x:y], end).astype("<u4") for x, y in zip(starts[:-1].tolist(), starts[1:].tolist())]
        pieces = arrange(ids, window)
        known = [x for part in ids_of for x in part.to_pylist()]
        cols = list(zip(*((known[d], s, n, zlib.crc32(ids[d][s : s + n]), len(ids[d]), first + q, o) for d, s, n, q, o in pieces)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names), 1 + max(q for _, _, _, q, _ in pieces)

    def run(batches):
        ids_of, texts, held, first = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = wordhash.buffers(batch.column(1))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max(0, shard_bytes - held), "right")) - 1)
                b = min(b, batch.num_rows)
                ids_of.append(batch.column(0)[a:b])
                texts.append(batch.column(1)[a:b])
                held += int(offsets[b] - offsets[a]) + 64 * (b - a)
                a = b
                if held >= shard_bytes:
                    out, used = shard(ids_of, texts, first)
                    yield out
                    ids_of, texts, held, first = [], [], 0, first + used
        if ids_of:
            yield shard(ids_of, texts, first)[0]

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of its whole text without added special tokens, then `end`; so an empty or null text is
    one token. Every id lies in exactly one piece. Every sequence has `window` tokens or, at the end of a shard, a power of
    two of them: none needs padding. Rows with one id, or without, are packed each; texts longer than a shard make one of their
    own and run over several windows. Sequence ids are unique; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = _size(docs)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if size["bytes"] > shard_bytes else 1, -(-int(size["bytes"]) // TASK_BYTES))
    parts = PARTS * tasks
    shared = spark.sparkContext.broadcast(lexical_keys(docs, size["rows"], parts, size["bytes"]))
    dealt = docs.mapInArrow(_deal(shared, parts), "doc_id long, text string, part long, key long, other long")
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", "key", "other", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(_pack(vocabulary, window, end, shard_bytes), PIECES)
