"""Binary features of a text for linear models: its words, and prefixes of them, as 64-bit hashes.

A model keeps a bounded list of features that were chosen on a bounded sample of labelled rows; a text is then a row of
a sparse 0/1 matrix. Nothing here looks at anything but the text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .store import discard, durable

#: Bytes of the word prefixes that are features beside whole words; they catch inflected forms.
PREFIXES = (4, 5, 6, 8)

# Bytes that belong to words here: ASCII letters and digits, and all of other scripts' letters.
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


#: Kinds of features: whole words, a prefix of each length, the making of a text.
KINDS = len(PREFIXES) + 2


def kind_of(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(7)).astype(int)


def _of_kind(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes & ~np.uint64(7)) | np.uint64(kind)


def candidates(buf: np.ndarray, offsets: np.ndarray, shape: bool) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs as they come, repeated ones too; the kind of a feature is in its last three bits."""
    low = wordhash.LOWER[buf]
    dark = _WORDY[low]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = dark[1:] != dark[:-1]
    cut = offsets[1:-1]
    edge[cut[(cut > 0) & (cut < len(buf))]] = True
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = dark[starts] if len(buf) else np.zeros(0, bool)
    starts, ends = (starts[word], ends[word]) if len(buf) else (np.zeros(0, int), np.zeros(0, int))
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(np.searchsorted(starts, offsets)))
    sums = wordhash.prefix_sums(low)
    docs, found = [doc], [_of_kind(wordhash.substring_hashes(sums, starts, ends), 0)]
    long = np.arange(len(starts))
    for k, n in enumerate(PREFIXES, 1):
        long = long[ends[long] - starts[long] > n]
        docs.append(doc[long])
        found.append(_of_kind(wordhash.substring_hashes(sums, starts[long], starts[long] + n), k))
    if shape:
        words = np.bincount(doc, minlength=n_docs)
        letters = np.bincount(doc, ends - starts, n_docs)
        kinds = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (found[0] >> np.uint64(24)))
        kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])] if len(kinds) else kinds
        distinct = np.bincount((kinds >> np.uint64(40)).astype(np.int64), minlength=n_docs)
        size = np.diff(offsets)
        within = lambda mark: np.diff(np.append(0, np.cumsum(mark))[offsets])
        lines, signs = within(buf == 10), within(~dark & ~wordhash.WHITE[low])
        log = lambda x: np.floor(4 * np.log2(np.maximum(x, 1e-3))).astype(np.int64)
        for k, v in enumerate((log(words), log(letters / np.maximum(words, 1)), log(distinct / np.maximum(words, 1)), log(signs / np.maximum(size, 1)), log(lines / np.maximum(words, 1)))):
            docs.append(np.arange(n_docs))
            found.append(_of_kind(wordhash.mix((v * 64 + k).astype(np.uint64) ^ np.uint64(0x5EED5EED)), len(PREFIXES) + 1))
    return np.concatenate(docs), np.concatenate(found)


def of_texts(buf: np.ndarray, offsets: np.ndarray, shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once, sorted by document; with `shape` also how the text is made."""
    docs, found = candidates(buf, offsets, shape)
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])
    return docs[keep], found[keep]


def hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_of_kind(wordhash.substring_hashes(wordhash.prefix_sums(raw), np.array([0]), np.array([len(raw)])), 0)[0])


class Listed:
    """A bounded list of features; gives their columns."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features.astype(np.uint64))
        self.width = len(self.features)
        self._seen = np.zeros(1 << 16, bool)
        self._seen[(self.features >> np.uint64(48)).astype(np.int64)] = True

    def columns(self, found: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return np.where(self.features[at] == found, at, -1)

    def rows(self, buf: np.ndarray, offsets: np.ndarray, shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(document, column) pairs of the listed features in each text, each once, by document and column."""
        docs, found = candidates(buf, offsets, shape)
        maybe = np.flatnonzero(self._seen[(found >> np.uint64(48)).astype(np.int64)])  # a first look that keeps all listed ones
        docs, column = docs[maybe], self.columns(found[maybe])
        pairs = np.unique(docs[column >= 0] * max(1, self.width) + column[column >= 0])
        return pairs // max(1, self.width), pairs % max(1, self.width)


def sample_by_hash(rows: DataFrame, most: int, key: str, salt: str) -> DataFrame:
    """About `most` rows by a hash of their key, all if there are no more; their number is counted over all."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 20)) < int((1 << 20) * most / n))


def _tally(shape: bool):
    def run(batches):
        for batch in batches:
            kind = batch.column(1).to_numpy()
            buf, offsets = wordhash.buffers(batch.column(0))
            for a, b in wordhash.chunks(offsets):
                docs, found = of_texts(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shape)
                for k in np.unique(kind[a:b]):
                    feature, n = np.unique(found[kind[a:b][docs] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64))], names=["feature", "kind", "n"])

    return run


def choose(labelled: DataFrame, kinds: int, most: int, least_docs: int = 5, shape: bool = False) -> tuple[Listed, np.ndarray, np.ndarray]:
    """The features that tell the kinds apart best, of a sample (text, kind int).

    Of the features in at least `least_docs` documents, those with the greatest chi-square between presence and
    kind, `most` for each kind, ties by the feature. Also returns their counts by kind, and the rows of each kind.
    """
    sizes = np.zeros(kinds)
    for r in labelled.groupBy("kind").agg(F.count("*").alias("n")).collect():
        sizes[r["kind"]] = r["n"]
    counts = labelled.select("text", "kind").mapInArrow(_tally(shape), "feature long, kind int, n long")
    wide = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(kinds)])
    have = sum((F.col(f"n{k}") for k in range(1, kinds)), F.col("n0"))
    wide = durable(wide.where(have >= least_docs), "features")
    total, found = float(sizes.sum()), {}
    for k in range(kinds):
        if 0 < sizes[k] < total:
            share = float(sizes[k] / total)
            value = (F.col(f"n{k}") - have * share) ** 2 / (have * (1 - have / (total + 1)))
            for r in wide.withColumn("value", value).orderBy(F.desc("value"), "feature").limit(most).drop("value").collect():
                found[r["feature"]] = [r[f"n{j}"] for j in range(kinds)]
    discard(wide)
    if not found:
        return Listed(np.zeros(0, np.uint64)), np.zeros((0, kinds)), sizes
    keys = np.array(list(found), np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Listed(keys), np.array(list(found.values()))[order], sizes


def _present(shared, shape: bool):
    def run(batches):
        listed: Listed = shared.value
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(0))
            for a, b in wordhash.chunks(offsets):
                docs, column = listed.rows(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shape)
                ends = np.searchsorted(docs, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(column.astype(np.int32)))], names=["kind", "columns"])

    return run


def matrix(labelled: DataFrame, listed: Listed, shape: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, starts, columns) of a sample that is bounded by its caller, in an order of its own."""
    shared = labelled.sparkSession.sparkContext.broadcast(listed)
    rows = labelled.select("text", "kind").mapInArrow(_present(shared, shape), "kind int, columns array<int>").toArrow()
    rows = rows.to_pandas()
    rows["columns"] = [tuple(x.tolist()) for x in rows["columns"]]
    rows = rows.sort_values(["kind", "columns"])
    sizes = np.array([len(x) for x in rows["columns"]], int)
    return rows["kind"].to_numpy(), np.append(0, np.cumsum(sizes)), np.array([c for x in rows["columns"] for c in x], int)


def softmax_regression(target: np.ndarray, starts: np.ndarray, columns: np.ndarray, width: int, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, kinds) and biases fitted to rows of soft targets by accelerated gradient steps."""
    n, kinds = target.shape
    row = np.repeat(np.arange(n), np.diff(starts))
    weight, bias = np.zeros((width, kinds)), np.log(np.maximum(target.mean(0), 1e-6))
    per_row = np.diff(starts).max(initial=0) + 1
    freq = np.bincount(columns, minlength=width) / max(n, 1)
    rate = 1.0 / (0.5 * (np.minimum(freq * per_row, freq + freq.sum()) + l2) + 1e-9)  # bounds the curvature by column
    w, b, last_w, last_b = weight.copy(), bias.copy(), weight.copy(), bias.copy()
    for t in range(steps):
        z = np.stack([np.bincount(row, w[columns, k], n) for k in range(kinds)], 1) + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        error = (p - target) / max(n, 1)
        grad = np.stack([np.bincount(columns, error[row, k], width) for k in range(kinds)], 1) + l2 * w
        new_w, new_b = w - np.minimum(rate, 200.0)[:, None] * grad, b - 1.0 * error.sum(0)
        pace = t / (t + 3)
        w, b = new_w + pace * (new_w - last_w), new_b + pace * (new_b - last_b)
        last_w, last_b = new_w, new_b
    return last_w, last_b


def posteriors(shared_rows: tuple[np.ndarray, np.ndarray], n: int, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    docs, column = shared_rows
    z = np.stack([np.bincount(docs, weight[column, k], n) for k in range(len(bias))], 1) + bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def words_of(texts: Sequence[str]) -> np.ndarray:
    return np.array([hash_of(t) for t in texts], np.uint64)
