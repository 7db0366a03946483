"""Weak supervision: the label model against a plain computation, noisy labels through the query, odd rows."""

import random

import numpy as np
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import lexical, toxicity  # noqa: E402

WORDS = ["river", "stone", "meadow", "lantern", "harbour", "window", "garden", "copper", "thread", "marble"]


def plain_posterior(votes, rate, weight, prior):
    out = []
    for row in votes:
        odds = np.log(prior / (1 - prior))
        for v, no, yes, w in zip(row, rate[0], rate[1], weight):
            odds += w * (np.log(yes / no) if v else np.log((1 - yes) / (1 - no)))
        out.append(1 / (1 + np.exp(-odds)))
    return np.array(out)


def test_label_model_learns_rates_and_correlations():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    flip = lambda p: np.where(rng.random(4000) < p, ~truth, truth)
    twin = flip(0.15)
    votes = np.stack([flip(0.05), flip(0.1), flip(0.1), flip(0.08), twin, twin], 1).astype(float)
    model = toxicity.LabelModel(votes, np.array([[0.2] * 6, [0.7] * 6]), 0.3)
    post = model.posterior(votes)
    assert np.allclose(post, plain_posterior(votes, model.rate, model.weight, model.prior))
    assert ((post > 0.5) == truth).mean() > 0.98 and abs(model.prior - 0.2) < 0.05
    assert model.correlation[4, 5] > 0.95 and model.weight[4] < 0.6 < model.weight[0] and model.accuracy()[0] > model.accuracy()[1]


def test_patterns():
    bit = lambda text, name: bool(toxicity.patterns(text) >> toxicity.PATTERNS.index(name) & 1)
    assert bit("You are such an idiot", "addressed") and not bit("The idiot", "addressed")
    assert bit("what a moron!", "exclaimed") and bit("stupid clown", "several_near") and not bit("stupid " + "word " * 20 + "clown", "several_near")
    assert bit("a LOSER", "shouted_insult") and bit("THIS TEXT SHOUTS", "shouting") and bit("f**k sh##t", "masked") is True
    assert toxicity.patterns("") == 0 and toxicity.patterns("harmless İ text") == 0


def test_lexicons_by_kind():
    terms = ["moron", "zzz", "common"]
    listed = toxicity.Listed(lexical.words_of(terms))
    of = dict(zip(listed.features.tolist(), range(3)))
    counts = np.zeros((3, 2))
    for t, c in zip(terms, ([0, 5], [0, 300], [400, 40])):
        counts[of[lexical.hash_of(t)]] = c
    names, lexicon = toxicity.lexicons(listed, counts, np.array([9000, 600]))
    assert [names[k] if k >= 0 else None for k in (lexicon[of[lexical.hash_of(t)]] for t in terms)] == ["mind", "words_strict", None]


@pytest.fixture(scope="module")
def noisy(spark):
    """A third of the documents have insults or a word of the corpus' own that means as much; one label in ten is wrong."""
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        bad = rng.choice(["moron", "idiot", "grumbleface", "grumbleface"])
        rows.append((k, " ".join(rng.sample(rng.choices(WORDS, k=20) + ([bad, rng.choice(["scum", "grumbleface"])] if toxic else []), 22 if toxic else 20)), "x", 0.5))
        labels.append((k, int(toxic != (rng.random() < 0.1))))
    rows += [(2000, None, None, None), (2001, "", None, None), (None, "such a moron and scum", None, None), (5, rows[5][1], "x", 0.5), (2002, "river " * 50000, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted double").repartition(3)
    return rows, d, spark.createDataFrame(labels + [(None, 1), (5000, None), (7, 0)], "doc_id long, toxic int")


def test_noisy_labels_through_the_query(noisy):
    rows, d, labels = noisy
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 3 == 0) for r in known)
    assert right >= 0.97 * len(known)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2000].score == by_id[2001].score < 0.7 and by_id[None].predicted == 1 and by_id[2002].predicted == 0
    assert len({r.score for r in got if r.doc_id == 5}) == 1


def test_report_tells_the_labels_sway(noisy):
    _, d, labels = noisy
    report = toxicity.train(d, labels).report
    assert 0.05 < report["labels_overruled"] / report["rows"] < 0.2
    voters = {v[0]: v for v in report["voters"]}
    assert voters["mind"][2] > 0.7 and set(toxicity.PATTERNS) < set(voters) and "label" not in voters


def test_stage_and_empty_tables(noisy, spark):
    rows, d, labels = noisy
    model = toxicity.train(d, labels, fold=None)
    left = toxicity.without_toxic(d, model)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} >= {k for k in range(900) if k % 3} | {2000, 2001, 2002}
    assert toxicity.without_toxic(d.where("false"), model).count() == 0
    none = toxicity.toxicity(d, labels.where("false")).collect()
    assert len(none) == len(rows) and all(0 <= r.score <= 1 for r in none)
    assert toxicity.toxicity(d.where("false"), labels).count() == 0


def test_alike_rows_share_a_group():
    """Rows of two vocabularies, without labels; a lone common term does not bring them together."""
    rng = np.random.default_rng(5)
    rows = [np.unique(np.append(rng.choice(20, 12, replace=False) + 20 * (k % 2), 40)) for k in range(300)]
    starts, columns = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    group = toxicity.alike(starts, columns, 42, 2)
    assert len(set(group[::2])) == 1 == len(set(group[1::2])) and group[0] != group[1]
    assert not toxicity.alike(starts, columns, 42, 1).any() and len(toxicity.alike(np.zeros(1, int), np.zeros(0, int), 5, 4)) == 0
    assert not toxicity.alike(np.zeros(4, int), np.zeros(0, int), 5, 4).any()


def test_silence_of_another_group_counts_for_nothing():
    """Voter 0 speaks in group 0 only; in group 1 the posterior is that of voter 1 alone, by a model of that group."""
    rng = np.random.default_rng(6)
    group, label = np.arange(2000) % 2, (rng.random(2000) < 0.15).astype(int)
    cast = np.stack([(label == 1) & (group == 0), np.where(rng.random(2000) < 0.05, 1 - label, label) & (group == 1)], 1).astype(float)
    both = toxicity.GroupedModel(cast, group, label, np.arange(2000) % 4 < 2)
    assert both.target[(group == 1) & (label == 1) & (cast[:, 1] == 1)].min() > 0.6
    assert ((both.target > 0.5) == (label == 1)).mean() > 0.95 and sorted(both.rows.values()) == [1000, 1000]
    one = both.models[1]
    mine = cast[group == 1]
    assert np.allclose(one.posterior(mine), plain_posterior(mine, one.rate, one.weight, one.prior))


def test_a_second_vocabulary_with_few_toxic_rows(spark):
    """Nine tenths of the rows use one vocabulary and insults; the others have words and insults of their own."""
    rng = random.Random(8)
    other = ["fluvo", "petra", "prado", "lumar", "porto", "ventana", "jardo", "cobro", "hilado", "marmol"]
    rows, labels = [], []
    for k in range(2400):
        toxic, mine = rng.random() < 0.15, other if k % 8 == 0 else WORDS
        bad = rng.sample(["tontazo", "basurez", "brutocho"] if mine is other else ["moron", "idiot", "scum"], 2)
        words = rng.choices(mine, k=25) + (bad if toxic else [])
        rows.append((k, " ".join(rng.sample(words, len(words)))))
        labels.append((k, int(toxic)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    held = [r for r in toxicity.toxicity(d, l).collect() if r.held_out]
    for mine in (True, False):
        some = [r for r in held if (r.doc_id % 8 == 0) == mine]
        toxic = [r for r in some if truth[r.doc_id]]
        assert toxic and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
        assert not any(r.predicted for r in some if not truth[r.doc_id])
