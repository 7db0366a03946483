"""Near duplicates: the profile bound, buckets that fall apart over many blocks, repeated ids, recall against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import minhash  # noqa: E402


def shingles(text, n):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)]) if words else frozenset()


def components_by_all_pairs(rows, n):
    """Least id reachable, of (id, text) rows; rows with one id are one document with all its texts."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows]
    of = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            of[x].append(k)
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for x in s for j in of[x] if j < k)
        for j, m in shared.items():
            if 100 * m >= 80 * (len(s) + len(sets[j][1]) - m):
                a, b = sorted((find(i), find(sets[j][0])))
                root[b] = a
    return {i: find(i) for i in root}


def test_profiles_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, rng.integers(1, 900), replace=False)) for _ in range(120)]
    sets += [np.sort(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for s in sets] + [np.zeros(0, np.uint64), np.arange(0, 60_000 * 128, 128, dtype=np.uint64), np.arange(0, 61_000 * 128, 128, dtype=np.uint64)]
    starts = np.cumsum([0, *map(len, sets)])
    prof = minhash.profiles(np.concatenate(sets), starts)
    kept = minhash.possible(prof[:, None, :], prof[None, :, :], 80)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a]) and len(sets[b]) and 100 * (m := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - m)]
    assert len(links) > 60 and all(kept[a, b] for a, b in links) and kept.mean() < 0.2


def boilerplate(seed=3, n=150):
    """Documents that share a long passage, so they meet in buckets without being alike; some have near copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    common = " ".join(rng.choices(words, k=60))
    rows = []
    for k in range(n):
        own = rng.choices(words, k=40)
        rows.append((2 * k, common + " " + " ".join(own)))
        if k % 3 == 0:
            own[rng.randrange(40)] = "changed"
            rows.append((2 * k + 1, common + " " + " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_buckets_that_fall_apart(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = boilerplate()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()}
    assert got == components_by_all_pairs(rows, 2) and len(set(got.values())) == 150


def test_repeated_ids_with_different_texts(spark):
    a, b = (" ".join(random.Random(k).choices([f"w{j}" for j in range(300)], k=70)) for k in (1, 2))
    rows = [(5, a), (5, b), (5, b), (6, a + " more"), (7, b + " more"), (8, "alone here"), (8, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 2).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(5, 5), (6, 5), (7, 5), (8, 8)}
    kept = Counter(r.doc_id for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert kept == {5: 3, 8: 2}


def test_clashing_columns_are_carried(spark):
    rows = [(1, "a b c d e f", "x", 1.0), (2, "a b c d e f", "y", 2.0), (3, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, name string, component_id double")
    assert sorted(map(tuple, minhash.drop_near_duplicates(d).collect()), key=str) == [rows[0], rows[2]]
