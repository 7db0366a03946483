"""Repeated passages against brute force: through the tasks themselves, and through the query."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import passages as P  # noqa: E402


def covered_by_brute_force(rows, length=50):
    """Bytes of each document that a string of a smaller document covers; rows with one id are given joined by the caller."""
    seen, out = set(), {}
    for i, raw in sorted(rows.items()):
        windows = [raw[k : k + length] for k in range(len(raw) - length + 1)]
        gone = bytearray(len(raw))
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + length] = b"\1" * length
        seen.update(windows)
        out[i] = bytes(gone)
    return out


def expected(rows):
    out = {}
    for i, gone in covered_by_brute_force(rows).items():
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(gone), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(rows[i], gone) if not g)).hexdigest())
    return out


def covered_by_tasks(rows, shards, frequent, tasks):
    ids, sent = list(rows), []
    for t in range(tasks):
        own = ids[t::tasks]
        batch = pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([rows[i] for i in own], pa.binary())], names=["doc_id", "text"])
        sent += list(P._map(shards, SimpleNamespace(value=frequent))(iter([batch])))
    table = pa.Table.from_batches(sent, schema=P._SENT)
    gone = {i: bytearray(len(r)) for i, r in rows.items()}
    for shard in range(shards):
        own = table.filter(pc.equal(table.column("shard"), shard))
        if own.num_rows:
            for doc, start, stop in zip(*(P._index(own).column(c).to_pylist() for c in ("doc", "start", "stop"))):
                assert 0 <= start < stop <= len(rows[doc])
                gone[doc][start:stop] = b"\1" * (stop - start)
    return {i: bytes(g) for i, g in gone.items()}


@pytest.mark.parametrize("seed", range(10))
def test_tasks_against_brute_force(seed, monkeypatch):
    """Few letters make many ties and periods; pieces, batches and levels are small; a third of all seeds may be frequent."""
    rng = random.Random(seed)
    letters = ["ab", "abc d", "abcdefghij klm", "x", "a\0b"][seed % 5]
    base = ["".join(rng.choices(letters, k=rng.randint(0, 300))).encode() for _ in range(6)]
    rows = {999: b"word " * 700 + b"q", 1000: b"x" * 5000, 1001: b"x" * 7000, 1002: b"word " * 900}
    for _ in range(30):
        parts = []
        for _ in range(rng.randint(1, 5)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            parts += [b[a : rng.randint(a, len(b))], bytes(rng.choices(range(256), k=rng.randint(0, 9)))]
        rows[rng.randint(-50, 500)] = b"".join(parts)
    for name, value in (("CHUNK_BYTES", [1 << 19, 700, 64][seed % 3]), ("BATCH", [1 << 16, 50][seed % 2]), ("WINDOWS", [1 << 20, 100][seed // 2 % 2]), ("GATHERED", [1 << 18, 60][seed // 3 % 2])):
        monkeypatch.setattr(P, name, value)
    frequent = np.unique(P.seeds(np.frombuffer(b"".join(rows.values()), np.uint8)))[::3] if seed % 2 else np.zeros(0, np.uint64)
    assert covered_by_tasks(rows, [1, 4][seed % 2], P.Frequent(frequent), 3) == covered_by_brute_force(rows)


def test_suffixes_survive_packing():
    buf = np.frombuffer(b"the quick brown fox jumps over the lazy dog and runs away from the quick brown bear, over and over again", np.uint8)
    at, left, right = P.anchors(buf, np.array([0, len(buf)]), P.Frequent(np.zeros(0, np.uint64)))
    assert (left + right >= P.LENGTH).all() and (left <= P.LEFT).all() and (right <= P.LENGTH).all()
    assert sorted(k for a, l, r in zip(at, left, right) for k in range(a - l, a + r - P.LENGTH + 1)) == list(range(len(buf) - P.LENGTH + 1))
    found = P.Suffixes.read(buf, at, np.full(len(at), 7), at, left, right)
    again = P.Suffixes.unpack(found.pack())
    assert all((getattr(found, n) == getattr(again, n)).all() for n in P.Suffixes.NAMES)
    order = [bytes(buf[a : a + r]).ljust(P.LENGTH, b"\0") + bytes(buf[a - l : a])[::-1] for a, l, r in zip(at, left, right)]
    assert [x.rstrip(b"\0") for x in found.sorted().words()] == sorted(x.rstrip(b"\0") for x in order)


def test_levels_halve():
    rng = np.random.default_rng(2)
    family, spans = P.Family(), P.Spans()
    for k in range(20):
        body = rng.integers(1, 255, (10, P.WIDTH), dtype=np.uint8)
        family.insert(P.Suffixes(np.full(10, k), np.arange(10), np.arange(10), np.full(10, P.LEFT, np.uint8), np.full(10, P.LENGTH, np.uint8), body), spans)
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 200 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and not len(spans.united()[0])
    old = family.levels[0].take([3])
    old.doc, old.at, old.last = np.array([99]), np.array([500]), np.array([500])
    family.insert(old, spans)
    assert [x.tolist() for x in spans.united()] == [[99], [500 - P.LEFT], [500 + P.LENGTH]] and sum(len(x) for x in family.levels) == 200


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "Épsilon", "zeta,", "eta.", "theta", "日本"]
    line = lambda k: " ".join(rng.choices(words, k=k))
    shared = [line(20) for _ in range(4)]
    rows = {k: line(8) + rng.choice(shared) + line(9) for k in range(40)}
    return rows | {100: "", 101: "short", 102: "word " * 20000, 103: "word " * 20000, 104: " " * 70000, 105: " " * 80000, 106: rows[3], 107: rows[3]}


@pytest.mark.parametrize("tasks", [1, 5])
def test_query_against_brute_force(spark, tasks):
    rows = [(i, t, "clash") for i, t in texts().items()] + [(108, None, None)]
    random.Random(tasks).shuffle(rows)
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "doc_id long, text string, spans string")
    got = {r.doc_id: tuple(r)[1:] for r in P.repeated_passages(d, shard_bytes=20_000).collect()}
    assert got == expected({i: (t or "").encode() for i, t, _ in rows})


def test_rows_without_an_id_and_with_one_id(spark):
    text = "a passage of more than fifty bytes that stands in several documents of the table"
    rows = [(None, text), (3, "before " + text), (3, text), (4, "x" + text + "y")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(text)
    assert got == [(False, 3, n, n), (False, 3, n + 7, n + 7), (False, 4, n + 2, n), (True, 0, n, 0)]


def test_empty_table(spark):
    assert P.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
