"""Mixing against a plain solver: totals, rates and copies, nulls, repeated rows, ties, empty tables, clashing names."""

import random
import warnings

import numpy as np
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import lexical, mixing  # noqa: E402
from prismark.llm.queries import vocabulary  # noqa: E402

GOOD, POOR = ["river", "stone", "meadow", "lantern", "harbour"], ["$$$", "###", "buy", "click", "now"]


def rows():
    rng = random.Random(11)
    out = []
    for k in range(240):
        poor = k % 6 == 0
        out.append((k, " ".join(rng.choices(POOR if poor else GOOD, k=rng.randint(5, 60))), "x"))
    return out + [(1000, None, "x"), (1001, "", "x"), (None, "river stone", "x"), (7, "meadow lantern", "x"), (7, "meadow lantern", "x"), (1002, "river " * 40000, "x")]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, rate string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(200)] + [(None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int")
    return docs, mixing.fit_domains(docs, mixing.domain_labels(labels), ["good", "poor"])


def plain_rates(n, p, wanted):
    """Rates max(0, 1 - p @ x) whose totals are the wanted ones, by Newton steps on x."""
    x = np.zeros(p.shape[1])
    for _ in range(500):
        raw = 1 - p @ x
        live = raw > 0
        off = (n * np.where(live, raw, 0)) @ p - wanted
        slope = (p[live] * n[live, None]).T @ p[live]
        x += 0.5 * np.linalg.lstsq(slope, off, rcond=None)[0]
    return np.maximum(0, 1 - p @ x)


@pytest.mark.parametrize("targets", [{"good": 0.5, "poor": 0.5}, {"good": 0.97, "poor": 0.03}])
def test_mixed_against_a_plain_solver(fitted, targets):
    from tokenizers import Tokenizer

    docs, domains = fitted
    library = Tokenizer.from_file(vocabulary())
    got = mixing.mixed(docs, domains, targets, vocabulary()).toPandas()
    assert len(got) == len(rows()) and got.targets_met.all()
    texts = {i: t or "" for i, t, _ in rows()}
    known = got[got.doc_id.notna() & (got.doc_id != 7)]
    assert [int(x) for x in known.n_tokens] == [len(library.encode(texts[int(i)], add_special_tokens=False).ids) for i in known.doc_id]
    n, p = got.n_tokens.to_numpy(float), got[["p_good", "p_poor"]].to_numpy()
    share = np.array([targets["good"], targets["poor"]])
    assert np.allclose((n * got.rate.to_numpy()) @ p, share * n.sum(), rtol=2e-3)
    assert np.allclose(got.rate, plain_rates(n, p, share * n.sum()), atol=5e-3)
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all() and (got.rate >= 0).all()
    twins = got[(got.doc_id == 7) & (got.n_tokens == 2)]
    assert len(twins) == 2 and twins.rate.nunique() == 1


def test_copies_expect_the_rate(fitted):
    docs, domains = fitted
    got = mixing.mixed(docs, domains, {"good": 0.6, "poor": 0.4}, vocabulary()).toPandas()
    assert abs(got.copies.sum() - got.rate.sum()) < 4 * np.sqrt(len(got))


def test_repeating_drops_nothing(fitted):
    docs, domains = fitted
    many = mixing.remixed(docs, domains, {"good": 0.5, "poor": 0.5}, vocabulary(), repeat_only=True).collect()
    have = {}
    for r in many:
        have[(r.doc_id, r.text, r.rate)] = have.get((r.doc_id, r.text, r.rate), 0) + 1
    assert set(have) == set(rows()) and have[(7, "meadow lantern", "x")] % 2 == 0


def test_targets_out_of_reach_are_told(fitted, spark):
    docs, domains = fitted
    only = docs.where("doc_id % 6 <> 0")
    hard = mixing.Domains(["good", "poor"], lexical.Listed(np.zeros(0, np.uint64)), np.zeros((0, 2)), np.array([0.0, -80.0]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        got = mixing.mixed(only, hard, {"good": 0.5, "poor": 0.5}, vocabulary()).toPandas()
    assert not got.targets_met.any()


def test_empty_tables(fitted, spark):
    docs, domains = fitted
    nothing = docs.where("false")
    assert mixing.mixed(nothing, domains, {"good": 1, "poor": 1}, vocabulary()).count() == 0
    assert mixing.remixed(nothing, domains, {"good": 1, "poor": 1}, vocabulary(), repeat_only=True).columns == docs.columns
    unlabelled = mixing.fit_domains(docs, mixing.domain_labels(spark.createDataFrame([], "doc_id long, quality int, toxic int")), ["good", "poor"])
    assert mixing.mixed(docs, unlabelled, {"good": 1, "poor": 1}, vocabulary()).count() == len(rows())
