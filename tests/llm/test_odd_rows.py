"""Null and repeated ids, clashing columns, long texts and empty tables for exact dedup, fingerprints, packing and urls."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import blocks, packing, sketches, store, urls  # noqa: E402
from prismark.llm.queries import vocabulary  # noqa: E402

ROWS = [(1, "same text"), (1, "same  text "), (1, "other"), (None, "sametext"), (None, None), (None, ""), (2, " \n"), (3, "sam"), (4, "x" * 9000), (5, "x" * 9000), (6, "x" * 4096), (7, "x" * 4096 + "y" * 4096 + "x" * 808), (8, "é" * 5000), (8, "é" * 5000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows], "doc_id long, text string, name string, row string, own int").repartition(3)


def squeezed(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_duplicates_of_odd_rows(spark):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[squeezed(t)].append((-len(t or ""), i is not None, i or 0, i))
    want = Counter()
    for i, t in ROWS:
        first = min(groups[squeezed(t)])
        want[(i, first[3], len(groups[squeezed(t)]), hashlib.sha256(squeezed(t).encode()).hexdigest())] += 1
    got = blocks.exact_duplicates(frame(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_rows_of_files_keep_their_names(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "docs"))
    kept = blocks.drop_exact_duplicates(spark.read.parquet(str(tmp_path / "docs")))
    assert kept.columns == ["doc_id", "text", "name", "row", "own"] and sorted(squeezed(r.text) for r in kept.collect()) == sorted({squeezed(t) for _, t in ROWS})


def test_lookups_of_a_frequent_key(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    names = rows.select("k").distinct().selectExpr("k", "k * 2 as name")
    got = store.looked_up(rows, names, ["k"], ["id"])
    assert got.count() == 5000 and got.where("name <> k * 2").count() == 0 and got.columns == ["k", "id", "name"]


def lines(t):
    return {p for p in (t or "").split("\n") if p}


def test_fingerprints_of_odd_rows(spark):
    got = sketches.fingerprints(frame(spark), parts=2).collect()
    order = sorted(ROWS, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    nexts = list(zip(order, order[1:] + order[:1]))
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = Counter()
    for (i, t), (_, n) in nexts:
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(lines(t), lines(e)), 9), round(like(lines(t), lines(n)), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    only = sketches.fingerprints(frame(spark, [(3, "a\nb")])).collect()
    assert [(r.near_edited, r.near_next) for r in only] == [(1.0, 1.0)] or only[0].near_next == 1.0


def test_differences_are_the_digests_themselves(spark):
    rng = random.Random(1)
    sets = {}
    for row in range(30):
        shared = [rng.getrandbits(63) for _ in range(rng.choice([0, 3, 200, 3000]))]
        a, b = ([rng.getrandbits(63) for _ in range(rng.choice([0, 1, 5, 40, 900]))] for _ in range(2))
        sets[row] = (shared + a, b + shared)
    rows = [(k, "p", a or None, b) for k, (a, b) in sets.items()]
    got = {r.row: r.found for r in sketches.differences(spark.createDataFrame(rows, "row long, pair string, left array<long>, right array<long>")).collect()}
    for k, (a, b) in sets.items():
        assert Counter((x.d, x.n) for x in got[k]) == Counter([(d, 1) for d in set(a) - set(b)] + [(d, -1) for d in set(b) - set(a)])


def test_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    got = packing.pack(frame(spark), vocabulary(), window=256, shard_bytes=4000).collect()
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ROWS)
    whole = Counter()
    for r in got:
        if r.start == 0:
            whole[(r.doc_id, r.doc_tokens)] += 1
    assert whole == want and sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_copies_stand_in_different_windows():
    rng = np.random.default_rng(3)
    unique = [rng.integers(0, 500, 40).astype("<u4") for _ in range(120)]
    ids = unique + [x.copy() for x in unique[:30]] * 3
    inside = defaultdict(list)
    for doc, *_, sequence, _ in packing.arrange(ids, 256):
        inside[sequence].append(ids[doc].tobytes())
    assert sum(len(x) - len(set(x)) for x in inside.values()) <= 4


FOLDER = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no tables here")
def test_neighbours_meet_in_a_shard(spark):
    """Of the documents with a lexical neighbour worth the name, how many share a task's part with it, against chance."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    parts = 32
    keys = packing.lexical_keys(docs, len(rows), parts)
    from prismark.llm import wordhash
    from prismark.llm.tokens import Encoder
    import pyarrow as pa

    buf, offsets = wordhash.buffers(pa.array([r.text or "" for r in rows], pa.large_string()))
    key, _, _ = keys.of_texts(buf, offsets)
    place = keys.part(key, np.zeros(len(key), np.uint64), parts)
    flat, starts = Encoder.of(vocabulary()).ids(buf, offsets)
    ids = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
    index, n, together, alike = packing.Index(ids), 0, 0, [x.tobytes() for x in ids]
    for seed in range(0, len(rows), 5):
        best = [d for d in index.neighbours(seed, np.ones(len(rows))).tolist() if d != seed and alike[d] != alike[seed]][:1]
        if best and len(np.intersect1d(ids[seed], ids[best[0]])) > 0.5 * len(set(ids[seed].tolist())):
            n += 1
            together += place[seed] == place[best[0]]
    print("neighbours", n, "in one part", together)
    assert n > 10 and together / n > 4 / parts


def test_urls_of_odd_rows(spark):
    rows = [(None, "http://x.org/porn", "a"), (1, "http://x.org/", "b"), (1, "http://x.org/", "b"), (1, None, None), (2, "http://" + "a" * 100_000 + ".net/es/", "c"), (3, "://", "d"), (4, "a://b://c/é?", "e")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert Counter((r.page_id, r.verdict) for r in got) == Counter({(None, "block"): 1, (1, "allow"): 3, (2, "block"): 1, (3, "allow"): 1, (4, "allow"): 1})
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_seeds_against_a_plain_look_at_all_rows():
    """The next seed is the first unused document that equals none inside, else the first unused one."""
    import numpy as np

    from prismark.llm import packing

    rng = np.random.default_rng(9)
    for _ in range(100):
        n = int(rng.integers(0, 40))
        alike, unused, inside = rng.integers(0, max(1, n // 3), n), np.ones(n), set()
        seeds = packing.Seeds(alike, unused, inside)
        while True:
            free = np.flatnonzero(unused).tolist()
            want = next((d for d in free if int(alike[d]) not in inside), free[0] if free else None)
            assert seeds.take() == want
            if want is None:
                break
            for d in [want, *rng.permutation(free)[: rng.integers(0, 3)].tolist()]:
                unused[d] = 0
                inside.add(int(alike[d]))
            if rng.random() < 0.3:
                inside.clear()
                seeds.closed()


def test_retrieval_sorts_no_long_list_of_postings(monkeypatch):
    """Seeds with few and with many postings have the same scores as a plain sum, and only few postings are ever sorted."""
    rng = np.random.default_rng(8)
    ids = [rng.zipf(1.3, rng.integers(1, 80)).clip(max=4000).astype("<u4") for _ in range(300)] + [np.array([5000], "<u4")] * 2
    index, unique, sorted_at_once = packing.Index(ids), np.unique, [0]

    def counted(x, *args, **kwargs):
        sorted_at_once.append(len(x))
        return unique(x, *args, **kwargs)

    monkeypatch.setattr(packing.np, "unique", counted)
    for seed in range(len(ids)):
        unused = (rng.random(len(ids)) < 0.7).astype(float)
        scores = np.zeros(len(ids))
        for term in index.terms[index.of[seed] : index.of[seed + 1]]:
            at = slice(index.starts[term], index.starts[term + 1])
            np.add.at(scores, index.doc[at], index.weight[at])
        scores *= unused
        got = index.neighbours(seed, unused)
        assert set(got.tolist()) == set(np.flatnonzero(scores > 0).tolist()) and np.all(np.diff(scores[got]) < 1e-9)
    assert len(sorted_at_once) > 1 and max(sorted_at_once) < len(ids)


@pytest.fixture(scope="module")
def many_rows():
    """More rows than were once counted, with words of all frequencies."""
    rng = random.Random(12)
    names = [f"w{k}" for k in range(4000)]
    weights = [1 / (k + 1) for k in range(4000)]
    return [(k, None if k % 5000 == 0 else "" if k % 5000 == 1 else "the same words" if k % 50 == 2 else " ".join(rng.choices(names, weights, k=rng.randint(1, 12)))) for k in range(24_000)]


def plain_keys(texts, words):
    """The key of each text by counts of all of them, word by word."""
    from prismark.llm import wordhash
    import pyarrow as pa

    kinds = sorted({w for t in texts for w in (t or "").split()})
    hashes = dict(zip(kinds, wordhash.words(*wordhash.buffers(pa.array(kinds)))[0].tolist()))
    n = Counter(w for t in texts for w in set((t or "").split()))
    often = {w for w in kinds if n[w] * words >= sum(n.values())}
    cells = defaultdict(int)
    for w in kinds:
        if w not in often:
            cells[hashes[w] >> 44] = max(cells[hashes[w] >> 44], n[w])
    assert 0 < len(often) < len(kinds)
    weight = {w: np.log1p(len(texts) / (n[w] if w in often else cells[hashes[w] >> 44])) for w in kinds}
    mixed = {w: int(wordhash.mix(np.array([hashes[w]], np.uint64) + np.uint64(1))[0]) for w in kinds}
    value = {w: -np.log((mixed[w] >> 11) / 2.0**53 + 2.0**-54) / weight[w] for w in kinds}
    key = {w: int(wordhash.mix(np.array([mixed[w]], np.uint64) + np.uint64(1))[0]) for w in kinds}
    return [key[min(t.split(), key=value.get)] if t else None for t in texts]


def test_words_and_keys_are_counted_over_all_rows(spark, many_rows):
    from prismark.llm import wordhash
    import pyarrow as pa

    docs, parts = spark.createDataFrame(many_rows, "doc_id long, text string").repartition(5), 40
    keys, texts = packing.lexical_keys(docs, len(many_rows), parts), [t for _, t in many_rows]
    got = keys.of_texts(*wordhash.buffers(pa.array(texts)))[0].tolist()
    want = plain_keys(texts, packing.WORDS)
    assert [a for a, t in zip(got, texts) if t] == [b for b in want if b is not None]
    n, size = Counter(got), Counter()
    for k, t in zip(got, texts):
        size[k] += len(t or "") + 64
    total = sum(size.values())
    spread = {k: min(parts, -(-2 * parts * size[k] // total)) for k in n if n[k] >= 8 and 2 * parts * size[k] >= total}
    assert spread and dict(zip(keys.frequent.tolist(), keys.spread.tolist())) == spread


def test_pipeline_packs_by_counts_of_all_rows(spark, many_rows, monkeypatch):
    """The pipeline's last stage has the keys that counts of all its rows give, and packs every row of them."""
    import corpus_pipeline
    from prismark.llm import wordhash
    import pyarrow as pa

    seen, lexical_keys = [], packing.lexical_keys
    monkeypatch.setattr(packing, "lexical_keys", lambda *args, **kwargs: seen.append(lexical_keys(*args, **kwargs)) or seen[-1])
    docs = spark.createDataFrame(many_rows, "doc_id long, text string").repartition(5)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(got) == len(many_rows) and all(r[1] == r[2] for r in got)
    texts = [t for _, t in many_rows]
    keys = seen[0].of_texts(*wordhash.buffers(pa.array(texts)))[0].tolist()
    assert [a for a, t in zip(keys, texts) if t] == [b for b in plain_keys(texts, packing.WORDS) if b is not None]


def test_pieces_encoded_many_at_a_time(monkeypatch):
    """Ids of pieces as the library gives them one by one, in fewer texts than pieces."""
    from prismark.llm import tokens, wordhash

    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghéßçüñ", k=rng.randint(1, 12))) for _ in range(500)]
    texts += ["İstanbul", "ſs", "ﬁn", "Σας", "ΑΣ", "ʼn", "ǅ", "中文字", "ᾳ", "K", "Å", "éa", "ªº", "ⅷ", "ḍ̇", "한글", "ﷺ", "ΐ", "ẞ", "a1b", "it's", "<|endoftext|>", "​", "x" * 500, "12.5%", "a,b"]
    rng.shuffle(texts)
    encoder = tokens.Encoder(vocabulary())
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    given, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda x: given.extend(x) or encode(x))
    flat, size = encoder.flat(texts)
    assert size.tolist() == [len(x) for x in want] and flat.tolist() == [k for x in want for k in x]
    assert len(given) < len(texts) / 4 and encoder.flat([])[1].tolist() == []
    every = np.arange(256, dtype=np.uint8)
    assert np.array_equal(wordhash.lower(every), wordhash.LOWER) and np.array_equal(wordhash.white(every), wordhash.WHITE)
