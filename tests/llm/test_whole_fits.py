"""The pipeline's models are fitted to all labelled rows: against the plain ones on arrays, on many rows, and on odd ones."""

import random

import numpy as np
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import fitting, lexical, mixing, supervision, toxicity  # noqa: E402

WORDS = ["river", "stone", "meadow", "lantern", "harbour", "window", "garden", "copper", "thread", "marble"]


def test_pipeline_learns_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    """More labelled rows than either stage once took; each of them is learned from, in both stages."""
    import corpus_pipeline

    word = "element_at(array('" + "','".join(WORDS) + "'), cast(pmod(xxhash64(id, {}), 10) + 1 as int))"
    words = ", ".join(word.format(k) for k in range(6))
    rows = spark.range(48_000).selectExpr("id as doc_id", f"concat_ws(' ', {words}, if(id % 9 = 0, 'moron scum', null), if(id % 7 = 0, 'click now $$$', null)) as text")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    rows.selectExpr("doc_id", "int(doc_id % 9 = 0) as toxic", "int(doc_id % 7 > 0) as quality").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    models, without_toxic = [], toxicity.without_toxic
    monkeypatch.setattr(toxicity, "without_toxic", lambda d, m: models.append(m) or without_toxic(d, m))
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert models[0].report["rows"] == docs.where("crc32(cast(doc_id as string)) % 3 <> 1").count() > toxicity.SAMPLE_ROWS
    assert clean.count() == docs.where("doc_id % 9 > 0").count()

    learned, choose = [], lexical.choose
    monkeypatch.setattr(lexical, "choose", lambda d, *args, **kwargs: learned.append(d.count()) or choose(d, *args, **kwargs))
    mixed = corpus_pipeline.mix(spark, docs.where("doc_id % 9 > 0"), str(tmp_path))
    assert learned == [docs.where("doc_id % 9 > 0").count()] and learned[0] > mixing.SAMPLE_ROWS
    assert mixed.select("doc_id").distinct().count() == learned[0]


def test_regression_of_stored_rows(spark):
    """The loss of all rows is as low as long plain descent makes it, for soft targets too."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(900)]
    z = np.array([rng.normal() * 0 + sum((c % 5) - 2 for c in r) for r in rows])
    target = np.round(1 / (1 + np.exp(-z)), 3)
    frame = spark.createDataFrame([(float(t), [int(c) for c in r]) for t, r in zip(target, rows)], "target double, columns array<int>").repartition(3)
    w, b = fitting.softmax_regression(frame, supervision._soft, 30, 2, l2=1e-3)
    starts, columns = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    soft = np.stack([1 - target, target], 1)

    def loss(w, b):
        p = lexical.posteriors((np.repeat(np.arange(900), np.diff(starts)), columns), 900, w, b)
        return -(soft * np.log(p)).sum(1).mean() + 1e-3 / 2 * (w * w).sum()

    assert loss(w, b) <= loss(*lexical.softmax_regression(soft, starts, columns, 30, l2=1e-3, steps=3000)) + 1e-4


def test_label_model_of_sums_is_the_plain_one():
    rng = np.random.default_rng(3)
    label = (rng.random(3000) < 0.2).astype(int)
    flip = lambda p: np.where(rng.random(3000) < p, 1 - label, label)
    twin = flip(0.15)
    votes = np.stack([flip(0.05), flip(0.1), twin, twin, flip(0.4)], 1).astype(float)
    belief = np.array([[0.2] * 5, [0.7] * 5])
    plain = toxicity.LabelModel(votes, belief, 0.3, label=label)
    patterns, count = np.unique(np.column_stack([votes, label]), axis=0, return_counts=True)
    model = supervision.SummedModel(belief, 0.3, 3000)
    for step in range(41):
        sums = model.sums(patterns[:, :-1], patterns[:, -1], count)
        assert len(sums) == supervision.SummedModel.width(5)
        model.look(sums)
        if step < 40:
            model.step(sums)
    model.settle()
    assert np.allclose(model.rate, plain.rate) and np.allclose(model.weight, plain.weight) and np.isclose(model.prior, plain.prior)
    assert np.isclose(model.loss, toxicity.log_loss(plain.posterior(votes), label))


def test_alike_rows_of_a_table(spark):
    rng = np.random.default_rng(5)
    rows = [np.unique(np.append(rng.choice(20, 12, replace=False) + 20 * (k % 2), 40)) for k in range(300)]
    frame = spark.createDataFrame([(k, [int(c) for c in r]) for k, r in enumerate(rows)], "k int, columns array<int>")
    alike = supervision.Alike(frame.select("columns").repartition(3), 42)
    starts, columns = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    import pyarrow as pa

    got = alike.groups(pa.record_batch([pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], names=["columns"]))
    assert not got[0].any() and alike.k == 41
    for many, group in zip(toxicity.GROUPS[1:], got[1:]):
        assert not set(group[::2]) & set(group[1::2])  # as by the plain means, no group has rows of both vocabularies
        plain = toxicity.alike(starts, columns, 42, many)
        assert not set(plain[::2]) & set(plain[1::2])


def test_same_model_as_the_plain_one(spark):
    """On rows that both take whole, labels are met alike and scores are near; rows of nulls, several labels and empty tables."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = rng.choices(WORDS, k=20) + ([rng.choice(["moron", "idiot", "grumbleface"]), rng.choice(["scum", "grumbleface"])] if toxic else [])
        rows.append((k, " ".join(rng.sample(words, len(words)))))
        labels.append((k, int(toxic != (rng.random() < 0.1))))
    rows += [(2000, None), (2001, ""), (None, "such a moron and scum"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels + [(None, 1), (5000, None), (7, 0)], "doc_id long, toxic int")
    whole, plain = supervision.train(docs, known), toxicity.train(docs, known)
    assert whole.report["rows"] == plain.report["rows"] and [v[0] for v in whole.report["voters"]] == [v[0] for v in plain.report["voters"]]
    assert abs(whole.report["log_loss"] - plain.report["log_loss"]) < 0.02
    mine, theirs = ({(r.doc_id): r.predicted for r in toxicity.score(docs, m).collect()} for m in (whole, plain))
    assert sum(mine[k] != theirs[k] for k in mine) <= 5 and sum(mine[k] == int(k % 3 == 0) for k in range(900)) >= 870
    none = supervision.train(docs, known.where("false"))
    assert toxicity.without_toxic(docs, none).count() == len(rows)
    assert toxicity.without_toxic(docs.where("false"), supervision.train(docs.where("false"), known)).count() == 0
