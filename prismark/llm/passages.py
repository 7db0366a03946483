"""Removal of repeated passages: a logarithmic family of sparse suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id. Strings never cross
documents, and are judged on the input.

Every window of LENGTH bytes has an anchor: the place of the least of its strings of `SEED` bytes, by a hash, the leftmost if
several are equal. Equal windows have equal anchors wherever they stand, so only the suffixes that begin at anchors are
indexed, one in about 23 bytes, and no match of LENGTH bytes can be missed. A suffix carries the bytes that its windows
reach: up to LENGTH to the right, and up to LENGTH - SEED to the left, which are read leftwards.

1. In a map task, batches of suffixes are sorted by their bytes, to the right and then to the left. Of suffixes that are
   equal in all their bytes those of the batch's smallest document are sent on, to a shard chosen by their seed; the others
   are covered. Occurrences of one suffix in a document that follow each other closely, as in periodic text, travel as one.
2. In a shard, batches in order of document id get a suffix array each. A batch is merge-scanned against the arrays of all
   levels: the common prefixes with its neighbours there, to the right and to the left, are matches if they make LENGTH bytes
   together, and a suffix that is matched whole goes. Then the batch becomes a level, and levels of about equal size merge,
   so a shard of n suffixes has log n levels.
3. A match that is bounded on both sides between two anchors need not be with a neighbour. So suffixes whose longest common
   prefixes with any others, to the right and to the left, could make LENGTH bytes have their windows sorted and compared.

Seeds that are frequent in a bounded sample come last in the order of hashes, so they are anchors only where a window has no
other. Which those are never changes the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .store import durable

LENGTH, SEED = 50, 8
LEFT = LENGTH - SEED
SPAN = LEFT + 1
WIDTH = LENGTH + LEFT
#: Bytes of text whose suffixes make a shard, about; suffixes of a batch; suffixes that a map task gathers before it sends them.
SHARD_BYTES = 4 << 20
BATCH = 1 << 16
GATHERED = 1 << 18
#: Bytes of text that are looked at together; longer documents are looked at piece by piece.
CHUNK_BYTES = 1 << 19
#: Windows that are compared together in the third step, about.
WINDOWS = 1 << 20
#: The sample for frequent seeds, how many documents of it make one frequent, and how many there are at most.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 10_000, 40, 1 << 16

_TOP = np.uint64(1 << 63)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def seeds(buf: np.ndarray) -> np.ndarray:
    """The SEED bytes from each place on, mixed."""
    return wordhash.mix(np.lib.stride_tricks.sliding_window_view(buf, SEED).copy().view("<u8").ravel())


class Frequent:
    """Frequent seeds, looked up for whole arrays."""

    def __init__(self, found: np.ndarray):
        self.found = np.sort(found)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.found >> np.uint64(48)).astype(np.int64)] = True

    def last(self, mixed: np.ndarray) -> np.ndarray:
        """The order of seeds: their hashes, the frequent ones after all others."""
        out = mixed >> np.uint64(1)
        if len(self.found):
            at = np.flatnonzero(self.maybe[(mixed >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.found, mixed[at]), len(self.found) - 1)
            out[at[self.found[place] == mixed[at]]] |= _TOP
        return out


def anchors(buf: np.ndarray, offsets: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, bytes to its left, bytes to its right) of the suffixes of all documents in a buffer.

    The bytes are those of the windows that have this anchor; to the right they include the anchor's own.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none
    low = (frequent.last(seeds(buf)) & _HIGH) | np.arange(len(buf) - SEED + 1, dtype=np.uint64)
    width = 1
    while width < SPAN:  # least of SPAN seeds from each place on
        step = min(width, SPAN - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    windows = len(low)
    size = np.diff(offsets)
    long = size >= LENGTH
    mark = np.zeros(windows + 1, np.int32)
    np.add.at(mark, offsets[:-1][long], 1)
    np.add.at(mark, offsets[:-1][long] + size[long] - LENGTH + 1, -1)
    valid = np.cumsum(mark)[:windows] > 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    opens[offsets[:-1][long]] = True
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | opens[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    at = (low[first] & ~_HIGH).astype(np.int64)
    return at, at - first, last + LENGTH - at


_COLUMN = np.arange(WIDTH)


class Suffixes:
    """Suffixes as columns: document, anchor, last anchor of a close row of equal ones, bytes left and right, and the bytes.

    A row of `body` has the bytes as they are read, the anchor's first at LEFT, and zeros where the suffix has none.
    """

    NAMES = ("doc", "at", "last", "left", "right", "body")

    def __init__(self, *columns: np.ndarray):
        self.doc, self.at, self.last, self.left, self.right, self.body = columns
        self._words: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at) -> Suffixes:
        return Suffixes(*(getattr(self, n)[at] for n in self.NAMES))

    @staticmethod
    def join(parts: list[Suffixes]) -> Suffixes:
        if not parts:
            return Suffixes(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros((0, WIDTH), np.uint8))
        return Suffixes(*(np.concatenate([getattr(p, n) for p in parts]) for n in Suffixes.NAMES))

    @staticmethod
    def read(buf: np.ndarray, place: np.ndarray, doc: np.ndarray, where: np.ndarray, left: np.ndarray, right: np.ndarray) -> Suffixes:
        """Those whose anchors stand at `place` of a buffer, and at `where` of their documents."""
        wide = np.concatenate([np.zeros(LEFT, np.uint8), buf, np.zeros(LENGTH, np.uint8)])
        out = Suffixes(doc, where, where, left.astype(np.uint8), right.astype(np.uint8), np.lib.stride_tricks.sliding_window_view(wide, WIDTH)[place])
        out.body[~out._own()] = 0
        return out

    def _own(self) -> np.ndarray:
        """Which places of the bodies have bytes of the suffix."""
        return (_COLUMN >= LEFT - self.left[:, None].astype(np.int16)) & (_COLUMN < LEFT + self.right[:, None].astype(np.int16))

    def words(self) -> np.ndarray:
        """Strings that sort by the bytes to the right, then by those to the left, read leftwards."""
        if self._words is None:
            self._words = np.concatenate([self.body[:, LEFT:], self.body[:, LEFT - 1 :: -1]], 1).view(f"S{WIDTH}").ravel()
        return self._words

    def sorted(self) -> Suffixes:
        """By their bytes; equal ones stay in order."""
        order = np.argsort(self.words(), kind="stable")
        out = self.take(order)
        out._words = self._words[order]
        return out

    def seeds(self) -> np.ndarray:
        return np.ascontiguousarray(self.body[:, LEFT : LEFT + SEED]).view("<u8").ravel()

    def pack(self) -> bytes:
        """A column after the other, then the bytes of all suffixes one after another, compressed together."""
        columns = (np.array([len(self)], "<i8"), self.doc.astype("<i8"), self.at.astype("<i8"), (self.last - self.at).astype("<i8"), self.left, self.right, self.body[self._own()])
        whole = b"".join(c.tobytes() for c in columns)
        return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)

    @staticmethod
    def unpack(packed) -> Suffixes:
        packed = bytes(packed)
        raw = np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), np.uint8)
        n = int(raw[:8].view("<i8")[0])
        doc, at, more = (raw[8 + 8 * n * k : 8 + 8 * n * (k + 1)].view("<i8") for k in range(3))
        left, right = (raw[8 + 24 * n + n * k : 8 + 24 * n + n * (k + 1)] for k in range(2))
        out = Suffixes(doc, at, at + more, left, right, np.zeros((n, WIDTH), np.uint8))
        out.body[out._own()] = raw[8 + 26 * n :]
        return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    first = differ.argmax(1)
    return np.where(differ.any(1), first, a.shape[1])


def matched(old: Suffixes, new: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """How far each pair of suffixes agrees to the left and to the right."""
    right = np.minimum(common(old.body[:, LEFT:], new.body[:, LEFT:]), np.minimum(old.right, new.right))
    left = np.minimum(common(old.body[:, LEFT - 1 :: -1], new.body[:, LEFT - 1 :: -1]), np.minimum(old.left, new.left))
    return left, right


class Spans:
    """Covered bytes that are gathered: documents, starts and ends."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.parts.append((doc, start, end))

    def united(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, start, end = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        if not len(doc):
            return doc, start, end
        lift = (np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1) << 40
        reach = np.maximum.accumulate(end + lift) - lift  # the farthest end so far in each document
        opens = np.ones(len(doc), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
        at = np.flatnonzero(opens)
        return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def first_documents(batch: Suffixes, spans: Spans) -> Suffixes:
    """The batch, which is in order of document, sorted, without the suffixes that a smaller document of it has whole.

    Occurrences of a suffix in one document with at most LENGTH bytes from one to the next become one.
    """
    if not len(batch):
        return batch
    word = batch.words()
    order = np.argsort(word, kind="stable")
    word, doc, at, last, left, right = word[order], *(getattr(batch, n)[order] for n in Suffixes.NAMES[:-1])
    new = np.ones(len(order), bool)
    new[1:] = (word[1:] != word[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    late = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    spans.add(doc[late], at[late] - left[late], last[late] + right[late])
    live = np.flatnonzero(~late)
    opens = np.ones(len(live), bool)
    opens[1:] = new[live][1:] | (at[live][1:] - last[live][:-1] > LENGTH)
    first = np.flatnonzero(opens)
    out = batch.take(order[live[first]])
    out.last = last[live[np.append(first[1:], len(live)) - 1]]
    out._words = word[live[first]]
    return out


class Family:
    """Suffix arrays whose sizes at least halve from level to level."""

    def __init__(self):
        self.levels: list[Suffixes] = []

    def insert(self, batch: Suffixes, spans: Spans) -> None:
        """Add suffixes of documents that are greater than all before, and tell what of them those have."""
        mine = first_documents(batch, spans)
        whole = np.zeros(len(mine), bool)
        for level in self.levels:
            order = np.argsort(np.concatenate([level.words(), mine.words()]), kind="stable")  # a merge: both are sorted
            old = order < len(level)
            place = np.where(old, order, -1)
            before = np.maximum.accumulate(place)
            after = np.minimum.accumulate(np.where(old, order, len(level))[::-1])[::-1]
            row = order[~old] - len(level)
            for near in (before[~old], after[~old]):
                have = (near >= 0) & (near < len(level))
                found = mine.take(row[have])
                left, right = matched(level.take(near[have]), found)
                match = left + right.astype(np.int64) >= LENGTH
                spans.add(found.doc[match], found.at[match] - left[match], found.last[match] + right[match])
                whole[row[have]] |= (left == found.left) & (right == found.right)
        mine = mine.take(~whole)
        if len(mine):
            self.levels.append(mine)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            late = self.levels.pop()
            self.levels.append(Suffixes.join([self.levels.pop(), late]).sorted())

    def everything(self) -> Suffixes:
        return Suffixes.join(self.levels).sorted()


def _longest(key: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The longest common prefix of each of the sorted rows with a neighbour of the same seed."""
    out = np.zeros(len(key), np.int64)
    if len(key) > 1:
        near = np.where(seed[1:] == seed[:-1], common(key[1:], key[:-1]), 0)
        out[1:] = near
        out[:-1] = np.maximum(out[:-1], near)
    return out


def between_anchors(rest: Suffixes, spans: Spans) -> None:
    """What of sorted suffixes stands in smaller documents, window by window, where their common prefixes allow a match."""
    seed = rest.seeds()
    right = np.minimum(_longest(rest.body[:, LEFT:], seed), rest.right)
    leftwards = np.concatenate([rest.body[:, LEFT : LEFT + SEED], rest.body[:, LEFT - 1 :: -1]], 1)
    order = np.argsort(leftwards.view(f"S{SEED + LEFT}").ravel(), kind="stable")
    left = np.zeros(len(rest), np.int64)
    left[order] = np.minimum(_longest(leftwards[order, SEED:], seed[order]), rest.left[order])
    may = left + right >= LENGTH
    rest, seed = rest.take(may), seed[may]
    if not len(rest):
        return
    many = rest.left.astype(np.int64) + rest.right - LENGTH + 1
    group = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    ends = np.append(group[1:], len(rest))
    several = np.minimum.reduceat(rest.doc, group) != np.maximum.reduceat(rest.doc, group)
    held: list[np.ndarray] = []
    total = 0
    for a, b, yes in zip(group.tolist(), ends.tolist(), several.tolist()):
        if yes:
            held.append(np.arange(a, b))
            total += int(many[a:b].sum())
            if total >= WINDOWS:
                _windows(rest.take(np.concatenate(held)), spans)
                held, total = [], 0
    if held:
        _windows(rest.take(np.concatenate(held)), spans)


def _windows(found: Suffixes, spans: Spans) -> None:
    many = found.left.astype(np.int64) + found.right - LENGTH + 1
    found = found.take(order := np.argsort(found.doc, kind="stable"))
    many = many[order]
    row = np.repeat(np.arange(len(found)), many)
    # the window that begins `back` bytes before the anchor
    back = np.repeat(found.left.astype(np.int64), many) - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    word = np.lib.stride_tricks.sliding_window_view(found.body, LENGTH, axis=1)[row, LEFT - back].view(f"S{LENGTH}").ravel()
    order = np.argsort(word, kind="stable")
    word, doc = word[order], found.doc[row[order]]
    new = np.append(True, word[1:] != word[:-1])
    late = order[doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]]
    spans.add(found.doc[row[late]], found.at[row[late]] - back[late], found.last[row[late]] + LENGTH - back[late])


_SENT = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("suffixes", pa.binary())])
_SENT_DDL = "kind int, shard long, doc long, start long, stop long, suffixes binary"
_SPANS_DDL = "doc long, start long, stop long"


def _shard_of(found: Suffixes, shards: int) -> np.ndarray:
    return (wordhash.mix(found.seeds()) % np.uint64(shards)).astype(np.int64)


def _in_order(found: Suffixes) -> Suffixes:
    """By document and place."""
    if len(found) < 2 or ((found.doc[1:] > found.doc[:-1]) | (found.doc[1:] == found.doc[:-1]) & (found.at[1:] >= found.at[:-1])).all():
        return found
    return found.take(np.lexsort((found.at, found.doc)))


def _pieces(offsets: np.ndarray):
    """Stretches (first document, last document, begin, end) of a buffer; one longer than a chunk overlaps by all but one byte of a window."""
    for a, b in wordhash.chunks(offsets, CHUNK_BYTES):
        begin, stop = int(offsets[a]), int(offsets[b])
        while True:
            end = stop if b - a > 1 else min(stop, begin + CHUNK_BYTES)
            yield a, b, begin, end
            if end == stop:
                break
            begin = end - LENGTH + 1


def _map(shards: int, shared):
    """Suffixes of each task by shard (kind 1), and what a smaller document of the same batch already covers (kind 0)."""

    def flush(parts: list[Suffixes]):
        spans = Spans()
        mine = first_documents(_in_order(Suffixes.join(parts)), spans)
        doc, start, stop = spans.united()
        if len(doc):
            shard = (wordhash.mix(doc.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(doc), np.int32)), *map(pa.array, (shard, doc, start, stop)), pa.nulls(len(doc), pa.binary())], schema=_SENT)
        shard = _shard_of(mine, shards)
        order = np.lexsort((mine.at, mine.doc, shard))
        mine, shard = mine.take(order), shard[order]
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
        for k in range(0, len(cut), 512):
            own = cut[k : k + 512]
            packed = [mine.take(slice(a, b)).pack() for a, b in zip(own, np.append(cut, len(shard))[k + 1 : k + 1 + len(own)])]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(own), np.int32)), pa.array(shard[own]), *(pa.nulls(len(own), pa.int64()) for _ in range(3)), pa.array(packed, pa.binary())], schema=_SENT)

    def run(batches):
        frequent, parts, n = shared.value, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offsets = wordhash.buffers(batch.column(1))
            for a, b, begin, end in _pieces(offsets):
                own, at = buf[begin:end], np.clip(offsets[a : b + 1] - begin, 0, end - begin)
                place, left, right = anchors(own, at, frequent)
                doc = np.searchsorted(at, place, "right") - 1
                where = place + begin - offsets[a:b][doc]
                parts.append(Suffixes.read(own, place, ids[a:b][doc], where, left, right))
                n += len(place)
                if n >= GATHERED:
                    yield from flush(parts)
                    parts, n = [], 0
        if n:
            yield from flush(parts)

    return run


def _index(table: pa.Table) -> pa.Table:
    """One shard: what smaller documents cover. What the map tasks have found covered passes through."""
    spans = Spans()
    passed = table.filter(pa.compute.equal(table.column("kind"), 0)).select(["doc", "start", "stop"])
    every = Suffixes.join([Suffixes.unpack(x.as_buffer()) for x in table.column("suffixes") if x.is_valid])
    every = _in_order(every)
    family, a = Family(), 0
    while a < len(every):
        b = min(a + BATCH, len(every))
        while b < len(every) and every.doc[b] == every.doc[b - 1]:
            b += 1
        family.insert(every.take(slice(a, b)), spans)
        a = b
    between_anchors(family.everything(), spans)
    doc, start, stop = spans.united()
    return pa.concat_tables([passed, pa.table({"doc": doc, "start": start, "stop": stop}, schema=passed.schema)])


def _cut(batches):
    """What is left of each document: rows (doc_id, text, spans)."""
    for batch in batches:
        buf, offsets = wordhash.buffers(batch.column(1))
        removed, spans, digest = [], [], []
        for k, found in enumerate(batch.column(2).to_pylist()):
            own = buf[offsets[k] : offsets[k + 1]]
            if not found:
                removed.append(0)
                spans.append(0)
                digest.append(hashlib.sha256(own.tobytes()).hexdigest())
                continue
            cover = np.zeros(len(own) + 1, np.int32)
            for s in found:
                cover[min(s["start"], len(own))] += 1
                cover[min(s["stop"], len(own))] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
            digest.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _anchors_of_sample(batches):
    """In how many documents of each stretch each seed is an anchor."""
    nothing = Frequent(np.zeros(0, np.uint64))
    for batch in batches:
        buf, offsets = wordhash.buffers(batch.column(0))
        for a, b, begin, end in _pieces(offsets):
            own, at = buf[begin:end], np.clip(offsets[a : b + 1] - begin, 0, end - begin)
            place, _, _ = anchors(own, at, nothing)
            if len(place):
                doc = np.searchsorted(at, place, "right") - 1
                mixed = seeds(own)[place]
                order = np.lexsort((doc, mixed))
                mixed, doc = mixed[order], doc[order]
                new = np.append(True, (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1]))
                kinds, n = np.unique(mixed[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], names=["seed", "n"])


def frequent_seeds(docs: DataFrame, rows: int) -> Frequent:
    """Those in at least FREQUENT of about SAMPLE_DOCS documents, MOST_FREQUENT at most."""
    share = int((1 << 20) * min(1.0, SAMPLE_DOCS / max(rows, 1)))
    sample = docs.where(F.pmod(F.xxhash64(F.lit("frequent"), "doc_id"), F.lit(1 << 20)) < share)
    counts = sample.select("text").mapInArrow(_anchors_of_sample, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "seed").limit(MOST_FREQUENT).toArrow()
    return Frequent(found.column("seed").to_numpy().view(np.uint64))


def repeated_passages(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Null counts as empty; texts under LENGTH bytes lose nothing. Ids are meant to be unique: rows with one id are the same document,
    so they do not remove each other, and each loses what any of them loses, by place. A null id counts as smallest.
    An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size["bytes"] // shard_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_seeds(docs, size["rows"]))
    covered = durable(docs.mapInArrow(_map(shards, shared), _SENT_DDL).groupBy("shard").applyInArrow(_index, _SPANS_DDL), "covered")
    spans = covered.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
