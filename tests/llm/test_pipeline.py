"""The whole pipeline on a small folder of tables with odd rows, against what its stages should leave."""

import random
from collections import Counter

import pytest

pytest.importorskip("prismark.llm")

WORDS = [f"word{k}" for k in range(400)]


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_run_against_what_should_stay(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from prismark.llm.queries import vocabulary

    rng = random.Random(7)
    text = lambda: " ".join(rng.choices(WORDS, k=70))
    rows = [(k, text() + (" such a moron and a worthless idiot" if k % 6 == 0 else "")) for k in range(240)]
    rows += [(1000 + k, f" {rows[k][1]}\n") for k in range(1, 25)]  # exact copies but for white space; the longer one stays
    rows += [(2000 + k, rows[k][1] + " once more") for k in range(31, 51)]  # near copies; the smaller id stays
    rows += [(3000, None), (3001, ""), (None, text()), (None, "  "), (3002, " ".join(rng.choices(WORDS, k=6000)))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "n") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, name string")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k % 5 > 0), int(k % 6 == 0)) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    clean = [(i, t) for i, t in rows if "moron" not in (t or "")]
    groups = {}
    for i, t in clean:
        key = "".join((t or "").split())
        best = groups.get(key)
        if best is None or (-len(t or ""), i is not None, i or 0) < (-len(best[1] or ""), best[0] is not None, best[0] or 0):
            groups[key] = (i, t)
    left = sorted(groups.values(), key=lambda r: (r[0] is None, r[0] or 0))
    kept = []
    for i, t in left:
        mine = shingles(t)
        if not any(mine and 100 * len(mine & s) >= 80 * len(mine | s) for s in (shingles(u) for _, u in kept)):
            kept.append((i, t))

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(vocabulary())
    want = {(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in kept}  # two of them have no id
    got = Counter()
    for r in pieces:
        got[(r.doc_id, r.doc_tokens)] += r.length
    assert set(got) == want and all(n % tokens == 0 for (_, tokens), n in got.items())  # each as a whole number of copies
    whole = Counter(r.sequence_id for r in pieces for _ in range(r.length))
    assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in whole.values())
