"""Clusters, phrases and rules against plain versions of them, on odd rows and on the given tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import clusters, phrases, queries, rules  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")


# ---- clusters


def plain_clusters(rows, k, rounds, dims, salt="3"):
    kept = [(i, tuple(max(-(1 << 62), min(1 << 62, math.floor(1024 * x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"{salt}:{i}".encode()).hexdigest() if i is not None else "", q) for i, q in kept)
    cents = [q for _, _, q in named[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        cents = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else c for j, c in enumerate(cents)]
    out = [(i, near(q)[1], near(q)[0]) for i, q in kept]
    most = (1 << 63) - 1
    per = Counter()
    for _, j, d in out:
        per[j] += min(d, most)
    return sorted(((i, j, min(d, most), min(per[j], most), min(sum(per.values()), most), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def points(seed, n=120, dims=4, far=1.0):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-0.4, 0.1, 0.7]) + rng.choice([0.0, 0.001, 0.02]) for _ in range(dims)]) for k in range(n)]
    rows += [(500 + k, rows[0][1]) for k in range(60)]  # a group of copies
    rows += [(None, rows[1][1]), (None, rows[2][1]), (7, rows[3][1]), (7, rows[7][1]), (800, None), (801, [1.0]), (802, [1.0] * dims + [2.0]), (803, [None] * dims), (804, [float("nan")] * dims), (805, [float("inf")] * dims), (806, [])]
    return [(i, None if v is None else [None if x is None else x * far for x in v]) for i, v in rows]


@pytest.mark.parametrize("far", [1.0, 1e5, 1e30])
@pytest.mark.parametrize("k", [1, 5, 8])
def test_clusters_against_plain(spark, k, far):
    rows = points(3, far=far)
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, q double").repartition(3)
    got = clusters.clusters(frame, k=k, rounds=4, dims=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k, 4, 4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_few_or_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert clusters.clusters(spark.createDataFrame([], kind)).count() == 0
    assert clusters.clusters(spark.createDataFrame([(1, None), (2, [1.0])], kind)).count() == 0
    got = clusters.clusters(spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], kind)).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in got) == [(1, 0, 0), (2, 0, 0)] and len({r["cluster"] for r in got}) == 2
    one = clusters.clusters(spark.createDataFrame([(None, [0.5] * 64)], kind)).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in one] == [(None, 0, 0)]


def test_ties_go_to_the_smaller_number():
    best, distance = clusters.nearest(np.array([[0, 0], [4, 0]]), [[2, 0], [-2, 0], [2, 0]])
    assert best.tolist() == [0, 0] and distance.tolist() == [4, 4]
    best, distance = clusters.nearest(np.array([[1 << 40, 0]]), [[0, 0], [(1 << 40) + 3, 0]])
    assert best.tolist() == [1] and distance.tolist() == [9]


# ---- phrases


def plain_phrases(rows, longest, least, percent, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {p: n for p, n in f.items() if n >= least and len(p[1]) > 1}
    worst = Counter()
    for (lang, p), n in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                worst[lang, p[i : i + m]] = max(worst[lang, p[i : i + m]], n)
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if worst[lang, p] and 100 * worst[lang, p] >= percent * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))  # noqa: E741


def prose(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "old", "mill", "été", "Ñu", "x\x00y", "a", "b", "c,", "d.", "(e)", " f", "日本"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", "!?", " ; "]
    rows = [(None, None), ("en", ""), ("en", " \t\n"), (None, "old mill"), ("und", "old mill"), ("fr", "...")]
    for _ in range(n):
        rows.append((rng.choice(["en", "en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, 60)))))
    return rows + [("en", "the old mill")] * 30


@pytest.mark.parametrize("longest,least,percent,top", [(3, 10, 50, 2000), (3, 2, 80, 7), (4, 3, 50, 50), (2, 5, 50, 9)])
def test_phrases_against_plain(spark, longest, least, percent, top):
    rows = prose(longest)
    frame = spark.createDataFrame([(t, g, k, 0.5) for k, (g, t) in enumerate(rows)], "text string, lang string, n long, score double").repartition(5)
    got = phrases.collocations(frame, longest, least, percent, top)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, longest, least, percent, top)


def test_long_texts_are_read_in_sections(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["ab", "cd", "efgh", "x" * 90, "é"]) + rng.choice([" ", " ", " ", ". ", "\t\t"]) for _ in range(4000))
    rows = [("en", text), ("en", "ab cd"), ("de", text[:9000]), ("en", "q" * 3000), ("en", "r s " + "t" * 2500 + " u v")]
    for size in (64, 700):
        monkeypatch.setattr(phrases, "CHUNK_BYTES", size)
        for k in (1, 2, 3, 4):
            got = Counter()
            for batch in phrases._level(k, None)(iter([__import__("pyarrow").RecordBatch.from_pydict({"lang": [g for g, _ in rows], "text": [t for _, t in rows]})])):
                for g, p, n in zip(*(c.to_pylist() for c in batch.columns)):
                    got[g, p] += n
            want = Counter()
            for g, t in rows:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    if k == 1 and w:
                        want[g, ""] += len(w)
                    for i in range(len(w) - k + 1):
                        want[g, " ".join(w[i : i + k])] += 1
            assert got == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = prose(9)
    frame = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    monkeypatch.setattr(phrases, "FILTER_WORDS", 1)
    assert sorted(map(tuple, phrases.collocations(frame, 3, 4).collect())) == plain_phrases(rows, 3, 4, 50, 2000)


def test_no_phrases(spark):
    for rows in ([], [("a b", "en")], [(None, None)]):
        assert phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


# ---- rules


def plain_rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines),
        "n_lettered": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words), "n_capital": sum(len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z]", w) for w in words),
        "n_shouts": text.count("!"), "n_bullets": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines),
    }


def plain_verdict(text):
    c = plain_rule_counts(text)
    failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
    side = lambda x: sum(k * c[f] for f, k in x.items())
    return failed, not failed and not any(side(r.left) > side(r.right) + r.spare for r in rules.RULES)


def notes(seed, n=200):
    rng = random.Random(seed)
    pool = ["alpha", "beta", "Été", "ÉTÉ", "AB", "A1", "x", "42", "日本語", "it's", "•", "-", "* b", "a!", "#$", "<p>", "x\x00"]
    texts = [None, "", "\n", " \t\n\x0b", "one", "\n\na\n\na\n", "a\r\na\r\na", "w" * 100000, "a b c a b c", "one two three\n" * 30]
    for _ in range(n):
        some = rng.sample(pool, rng.randint(1, len(pool))) if rng.random() < 0.5 else [f"w{k}" for k in range(rng.randint(5, 400))]
        body = [" ".join(rng.choices(some, k=rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
        texts.append(rng.choice(["\n", "\n\n", "\r\n", "\n \n"]).join(rng.choice(body) if rng.random() < 0.3 else x for x in body) + rng.choice(["", "\n", "\n\n"]))
    return texts


def test_features_against_plain():
    import pyarrow as pa

    texts = notes(2)
    for size in (1, 7, len(texts)):
        for a in range(0, len(texts), size):
            part = texts[a : a + size]
            for lo, hi, t in rules._chunks(pa.array(part, pa.string())):
                want = [plain_rule_counts(x) for x in part[lo:hi]]
                for name in rules.FEATURES:
                    assert t.part(name).tolist() == [w[name] for w in want], name


def test_rules_against_plain(spark):
    texts = notes(4) + notes(4)[:40]
    rows = [(None if k % 50 == 3 else k // 2, t, "w", True) for k, t in enumerate(texts)]
    got = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean").repartition(3))
    want = [(i, *(plain_rule_counts(t)[f] for f in rules.BASE), *plain_verdict(t)) for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert rules.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_any_order_gives_the_same_texts():
    import pyarrow as pa

    texts, rng = notes(6), random.Random(1)
    for _, _, t in rules._chunks(pa.array(texts, pa.string())):
        everything = np.ones(len(t), bool)
        want = ~np.any([r.rejects(t) for r in rules.RULES], axis=0)
        for _ in range(6):
            mixed = rng.sample(rules.RULES, len(rules.RULES))
            fresh = rules.Texts(t.buf, t.offsets)
            assert (rules.Cascade(tuple(rules.Step(r, 0, 0, 0) for r in mixed)).kept(fresh, everything) == want).all()


def test_rules_are_ordered_by_rejections_per_cost():
    cheap, dear, twin = rules.Rule("cheap", {"n_shouts": 1}, {}), rules.Rule("dear", {"n_repeat_words": 1}, {}), rules.Rule("twin", {"n_symbols": 1}, {})
    seconds = {"n_shouts": 1.0, "n_symbols": 1.0, "n_repeat_words": 10.0, "spans": 10.0}
    # cheap and twin reject the same 50 texts, dear 100 others
    got = rules.ordered([dear, twin, cheap], seconds, {0b110: 50, 0b001: 100, 0: 100}, 1.0)
    assert [s.rule.name for s in got.steps] == ["twin", "dear", "cheap"] and [s.rejected for s in got.steps] == [50, 100, 0]
    got = rules.ordered([dear, twin, cheap], seconds, {0b110: 50, 0b001: 100, 0: 100}, 1.0, given=("n_repeat_words",))
    assert [s.rule.name for s in got.steps][0] == "dear"  # its feature is there already


def test_short_circuit_skips_features():
    import pyarrow as pa

    asked = []

    class Watched(rules.Texts):
        def part(self, name):
            asked.append((name, len(self)))
            return super().part(name)

    buf, offsets = rules.wordhash.buffers(pa.array(["a! b! c!"] * 5 + ["plain words of a text"] * 2))
    cascade = rules.Cascade(tuple(rules.Step(r, 0, 0, 0) for r in rules.RULES if r.name == "shouting"))
    t = Watched(buf, offsets)
    assert cascade.kept(t, np.ones(7, bool)).tolist() == [False] * 5 + [True] * 2
    assert not any(name == "n_repeat_words" for name, _ in asked)
    assert len(t.only(np.array([False] * 5 + [True] * 2))) == 2


def test_without_poor(spark):
    good = "Some plain words that make a sentence of no great length, and then another one that follows it at once.\n"
    rows = [(1, good, "k"), (2, "A! B! C!", "k"), (3, None, "k"), (4, "AB CD EF " * 30, "k"), (None, good, "k"), (1, good, "k")]
    kept = rules.without_poor(spark.createDataFrame(rows, "doc_id long, text string, rule string"))
    assert sorted((r["doc_id"] or 0, r["rule"]) for r in kept.collect()) == [(0, "k"), (1, "k"), (1, "k"), (3, "k")]


# ---- the queries against their SQL


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_phrase_collocations", "op13_quality_rules"])
def test_new_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(FOLDER))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
