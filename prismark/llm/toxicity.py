"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults that are fixed here, lexicons of words and stems that labelled rows suggest, and
patterns (an insult said to somebody, shouted, with others near it, shouting, masked words, no hit at all). A generative model
of the votes estimates how accurate each voter is and which of them err together. A voter whose terms are of one language says
nothing about a text in another, so texts are first put into groups of alike ones, by the frequent words and stems in them, and
each group has a model of its own: where a voter never speaks, its silence counts for nothing. The given labels are no voter:
one half of them suggests terms, the other half a first belief about the voters' rates, which the model revises. All of them
tell when to stop, and how many groups there are: what is kept is the posterior that meets them best. It is the target of a
linear classifier over words and stems, and that classifier scores every text. How far the posteriors part from the labels is
kept in the model's report.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexical, wordhash
from .store import discard, durable, joined

#: Bounds of what is learned from: labelled rows, and features.
SAMPLE_ROWS = 30_000
FEATURES = 1_500
L2 = 1e-4
#: Numbers of groups that are tried, of which the first whose log loss is at most NEARLY times the least is taken, and how many of the most frequent features, in that share of rows or more, tell groups apart.
GROUPS, NEARLY = (1, 4, 8, 16), 1.05
ALIKE, FREQUENT = 256, 0.02
#: A found lexicon has a second voter, which wants so many of its terms.
SEVERAL = 2
#: Rows that the share of toxic labels in all rows weighs in each group's.
SHARE_ROWS = 20
#: Log odds between the labels, less 1.64 standard errors, from which a term joins the found lexicons of each tier.
TIERS = (("hinting", 1.5), ("telling", 2.5), ("strict", 4.0))
THRESHOLD = 0.7

# Insults that vote in every corpus, by kind.
INSULTS = {
    "mind": ("dumb", "fool", "idiot", "idiotic", "imbecile", "moron", "moronic", "stupid"),
    "worth": ("clown", "failure", "loser", "pathetic", "useless", "worthless"),
    "filth": ("disgusting", "filth", "filthy", "garbage", "scum", "trash", "vermin"),
    "coarse": ("asshole", "bastard", "bitch", "crap", "damn", "fuck", "fucking", "shit"),
    "harm": ("despicable", "despise", "hateful", "ugly"),
}
PATTERNS = ("addressed", "exclaimed", "several_near", "shouted_insult", "shouting", "masked", "no_hit")

_INSULT = re.compile(r"\b(?:" + "|".join(w for terms in INSULTS.values() for w in terms) + r")s?\b")
_ADDRESS = re.compile(r"\b(?:you|your|you're|he|she|they|such an?|what an?|total|complete)\b\W*(?:\w+\W+){0,3}$")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_MASKED = re.compile(r"\b[A-Za-z]+[*#@]{2,}[A-Za-z]+\b")


def patterns(text: str) -> int:
    """Which of the first six patterns a text shows, as bits."""
    low, out = text.lower(), 0
    hits = list(_INSULT.finditer(low))
    for k, m in enumerate(hits):
        out |= bool(_ADDRESS.search(low, max(0, m.start() - 40), m.start())) << 0
        out |= (low[m.end() : m.end() + 1] == "!") << 1
        out |= (k > 0 and m.start() - hits[k - 1].end() < 60 and m[0] != hits[k - 1][0]) << 2
        out |= (len(text) == len(low) and text[m.start() : m.end()].isupper()) << 3
    out |= (len(_SHOUT.findall(text)) >= 3) << 4
    return out | bool(_MASKED.search(text)) << 5


class Listed(lexical.Listed):
    """Chosen features, and one more: any fixed insult. So an insult that few labelled rows have counts as the others do."""

    def __init__(self, features: np.ndarray):
        super().__init__(features)
        self.insults = np.sort(lexical.words_of([w for terms in INSULTS.values() for w in terms]))
        self._seen[(self.insults >> np.uint64(48)).astype(np.int64)] = True
        self.width = len(self.features) + 1

    def rows(self, buf: np.ndarray, offsets: np.ndarray, shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
        docs, found = lexical.candidates(buf, offsets, shape)
        maybe = np.flatnonzero(self._seen[(found >> np.uint64(48)).astype(np.int64)])
        docs, found = docs[maybe], found[maybe]
        column = self.columns(found)
        at = np.minimum(np.searchsorted(self.insults, found), len(self.insults) - 1)
        pairs = np.unique(np.concatenate([(docs * self.width + column)[column >= 0], docs[self.insults[at] == found] * self.width + self.width - 1]))
        return pairs // self.width, pairs % self.width


class LabelModel:
    """Votes (rows, voters) in {0, 1} -> posterior of class 1, by expectation and maximisation.

    Given the class, voter j votes 1 with a probability of its own. Voters that err together beyond that are
    discounted: the weight of j is 1 over the sum of its positive correlations with all voters, given the class in which they
    are greater. `belief` (2, voters) and `share` are what is thought of the rates and of class 1 beforehand; they start the
    rounds, and stay as a prior with PRIOR times the weight of the rows. With `label`, the round whose posterior has the least
    log loss against it is kept, else the last.
    """

    PRIOR = 0.5

    def __init__(self, votes: np.ndarray, belief: np.ndarray, share: float, rounds: int = 40, label: np.ndarray | None = None):
        n, strength = len(votes), self.PRIOR * len(votes) * np.array([[1 - share], [share]])
        self.prior, self.rate, self.weight = np.clip(share, 1e-4, 1 - 1e-4), np.clip(belief, 1e-6, 1 - 1e-6), np.ones(votes.shape[1])
        self.correlation, best = np.eye(votes.shape[1]), None
        for step in range(rounds + 1):
            post = self.posterior(votes)
            if label is not None and (best is None or log_loss(post, label) < best[0]):
                best = log_loss(post, label), self.prior, self.rate, self.weight, self.correlation
            if step == rounds or not n:
                break
            self.prior = np.clip((post.sum() + self.PRIOR * n * share) / (n * (1 + self.PRIOR)), 1e-4, 1 - 1e-4)
            mass = np.array([[(1 - post).sum()], [post.sum()]])
            self.rate = np.clip((np.stack([(votes * w[:, None]).sum(0) for w in (1 - post, post)]) + strength * belief + 1e-3) / (mass + strength + 2e-3), 1e-6, 1 - 1e-6)
            rest = votes - ((1 - post)[:, None] * self.rate[0] + post[:, None] * self.rate[1])
            self.correlation = np.maximum(*(self._correlations(rest, w) for w in (1 - post, post)))
            self.weight = 1 / np.maximum(1, np.clip(self.correlation, 0, 1).sum(0))
        if best is not None:
            _, self.prior, self.rate, self.weight, self.correlation = best

    @staticmethod
    def _correlations(rest: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of what votes are off their expectation, by the rows of a class; less than ten rows count for less."""
        total = max(w.sum(), 1e-9)
        spread = np.sqrt((w[:, None] * rest**2).sum(0) / total + 1e-4)
        return (rest * w[:, None]).T @ rest / total / np.outer(spread, spread) * min(1, w.sum() / 10)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        z = (votes * yes + (1 - votes) * no) @ self.weight + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def accuracy(self) -> np.ndarray:
        return self.prior * self.rate[1] + (1 - self.prior) * (1 - self.rate[0])


def log_loss(post: np.ndarray, label: np.ndarray) -> float:
    p = np.clip(post, 0.01, 0.99)
    return float(-np.where(label == 1, np.log(p), np.log(1 - p)).mean()) if len(p) else 0.0


def alike(starts: np.ndarray, columns: np.ndarray, width: int, many: int, rounds: int = 20) -> np.ndarray:
    """A group, 0 to many - 1, for each row, by the cosine of its frequent features with the groups' means; labels play no part.

    The first mean is that of the half of rows with most of those features; each next is the row of that half that is least like
    the means before it. Groups may stay empty.
    """
    n = len(starts) - 1
    row, freq = np.repeat(np.arange(n), np.diff(starts)), np.bincount(columns, minlength=width)
    common = np.argsort(-freq, kind="stable")[:ALIKE]
    common = common[freq[common] >= max(1, FREQUENT * n)]
    if many == 1 or not n or not len(common):
        return np.zeros(n, int)
    place = np.full(width, -1)
    place[common] = np.arange(len(common))
    here = place[columns] >= 0
    x = np.zeros((n, len(common)), np.float32)
    x[row[here], place[columns[here]]] = 1
    size = x.sum(1)
    x /= np.sqrt(np.maximum(1, size))[:, None]
    rich = size >= np.median(size)
    unit = lambda v: v / np.maximum(1e-9, np.sqrt((v * v).sum(1, keepdims=True)))
    mean = x[rich].mean(0, keepdims=True)
    for _ in range(many - 1):
        mean = np.vstack([mean, x[np.where(rich, (x @ unit(mean).T).max(1), 2).argmin()]])
    for _ in range(rounds):
        group = (x @ unit(mean).T).argmax(1)
        mean = np.stack([x[group == k].mean(0) if (group == k).any() else mean[k] for k in range(many)])
    return group


class GroupedModel:
    """A label model for each group of alike rows; `fresh` are the rows whose labels give the beliefs."""

    def __init__(self, cast: np.ndarray, group: np.ndarray, label: np.ndarray, fresh: np.ndarray):
        self.models, self.target, self.rows = {}, np.zeros(len(cast)), {}
        for g in np.unique(group):
            mine = group == g
            of = [mine & fresh & (label == k) for k in (0, 1)]
            belief = np.stack([(cast[m].sum(0) + 0.5) / (m.sum() + 1) for m in of])
            share = (label[mine].sum() + SHARE_ROWS * label.mean()) / (mine.sum() + SHARE_ROWS)
            self.models[g] = LabelModel(cast[mine], belief, float(share), label=label[mine])
            self.target[mine], self.rows[g] = self.models[g].posterior(cast[mine]), int(mine.sum())
        self.loss = log_loss(self.target, label)

    def mean(self, of) -> np.ndarray:
        return sum(self.rows[g] * of(m) for g, m in self.models.items()) / sum(self.rows.values())


def lexicons(listed: Listed, counts: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Names of the lexicons, and which of them each feature belongs to; -1 for none.

    The fixed ones come first. A found one has the terms of one kind, words or stems of one length, and of one tier; the
    fixed insults are in their own lexicons only.
    """
    names = list(INSULTS) + [f"{'words' if not k else f'stems_{lexical.PREFIXES[k - 1]}'}_{s}" for k in range(lexical.KINDS - 1) for s, _ in TIERS]
    out = np.full(listed.width, -1)
    odds = np.log((counts[:, 1] + 0.5) / (sizes[1] + 1)) - np.log((counts[:, 0] + 0.5) / (sizes[0] + 1)) - 1.64 * np.sqrt((1 / (counts + 0.5)).sum(1))
    kind = lexical.kind_of(listed.features)
    tier = sum((odds > least).astype(int) for _, least in TIERS) - 1
    found = (tier >= 0) & (kind < lexical.KINDS - 1)
    out[:-1][found] = (len(INSULTS) + len(TIERS) * kind + tier)[found]
    for k, terms in enumerate(INSULTS.values()):
        out[:-1][np.isin(listed.features, lexical.words_of(terms))] = k
    return names, out


def votes(starts: np.ndarray, columns: np.ndarray, shown: np.ndarray, lexicon: np.ndarray, n_lexicons: int) -> np.ndarray:
    """A column for each lexicon, which votes where a term of it stands, for each found one also where SEVERAL do, and for each pattern."""
    n, fixed = len(starts) - 1, len(INSULTS)
    row = np.repeat(np.arange(n), np.diff(starts))
    mine = lexicon[columns]
    hits = np.bincount(row[mine >= 0] * n_lexicons + mine[mine >= 0], minlength=n * n_lexicons).reshape(n, n_lexicons)
    shows = [shown >> k & 1 for k in range(len(PATTERNS) - 1)]
    return np.column_stack([hits > 0, hits[:, fixed:] >= SEVERAL, *shows, ~hits.any(1)]).astype(float)


class Model:
    """The classifier; report: of each voter its share of votes, accuracy, weight and closest fellow, and how the labels were met."""

    def __init__(self, listed: lexical.Listed, weight: np.ndarray, bias: np.ndarray, report: dict | None = None):
        self.listed, self.weight, self.bias, self.report = listed, weight, bias, report or {}

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for a, b in wordhash.chunks(offsets):
            rows = self.listed.rows(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out[a:b] = lexical.posteriors(rows, b - a, self.weight, self.bias)[:, 1]
        return out


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int] | None, most: int | None) -> DataFrame:
    """(text, kind, half) of about `most` labelled documents; ids of the bounded sample are what is broadcast. If it is None, of all, stored."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if fold is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % fold[0] != fold[1])
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("kind"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    if most is None:
        return joined(docs, known, "text", "kind", half)
    return docs.select("doc_id", "text").join(F.broadcast(lexical.sample_by_hash(known, most, "doc_id", label)), "doc_id").select("text", "kind", half)


def _shown(shared):
    def run(batches):
        listed: Listed = shared.value
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(0))
            shown = [patterns(t or "") for t in batch.column(0).to_pylist()]
            for a, b in wordhash.chunks(offsets):
                docs, column = listed.rows(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.searchsorted(docs, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], pa.array(shown[a:b], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(column.astype(np.int32)))], names=["kind", "half", "shown", "columns"])

    return run


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (3, 1), sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    """A model from the labelled rows outside the fold; about `sample_rows` of them by a hash of their id, which are stored once.

    Null labels and null ids are left out; of several labels of an id the greatest counts. Without rows of both labels every
    text has the score of the labels' share.
    """
    rows = durable(labelled_rows(docs, labels, "toxic", fold, sample_rows), "sample")
    listed, counts, sizes = lexical.choose(rows.where("half = 0"), 2, features, least_docs=4)
    listed = Listed(listed.features)
    if not sizes.all() or not len(counts):
        share = (sizes[1] + 0.5) / (sizes.sum() + 1)
        return Model(listed, np.zeros((listed.width, 2)), np.log([1 - share, share]))
    shared = docs.sparkSession.sparkContext.broadcast(listed)
    found = rows.select("text", "kind", "half").mapInArrow(_shown(shared), "kind int, half int, shown int, columns array<int>").toArrow().to_pandas()
    discard(rows)
    found["columns"] = [tuple(x.tolist()) for x in found["columns"]]
    found = found.sort_values(["kind", "half", "shown", "columns"])
    size = np.array([len(x) for x in found["columns"]], int)
    starts, columns = np.append(0, np.cumsum(size)), np.array([c for x in found["columns"] for c in x], int)
    names, lexicon = lexicons(listed, counts, sizes)
    cast = votes(starts, columns, found["shown"].to_numpy(), lexicon, len(names))
    label, fresh = found["kind"].to_numpy(), found["half"].to_numpy() == 1
    tried = {many: GroupedModel(cast, alike(starts, columns, listed.width, many), label, fresh) for many in GROUPS}
    least = min(m.loss for m in tried.values())
    groups = next(many for many in GROUPS if tried[many].loss <= NEARLY * least)
    model, target = tried[groups], tried[groups].target
    weight, bias = lexical.softmax_regression(np.stack([1 - target, target], 1), starts, columns, listed.width, l2=L2)
    everyone = names + [f"{v}_several" for v in names[len(INSULTS) :]] + list(PATTERNS)
    apart = model.mean(lambda m: m.correlation - np.diag(np.diag(m.correlation)))
    accuracy, heard = model.mean(LabelModel.accuracy), model.mean(lambda m: m.weight)
    report = {
        "voters": [(v, float(cast[:, j].mean()), float(accuracy[j]), float(heard[j]), everyone[int(apart[j].argmax())]) for j, v in enumerate(everyone)],
        "rows": len(label), "groups": sorted(model.rows.values()), "log_loss": model.loss,
        "labels_overruled": int(((target >= 0.5) != (label == 1)).sum()), "mean_distance_to_label": float(np.abs(target - label).mean()),
    }
    return Model(listed, weight, bias, report)


def _score(shared, threshold: float):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            score = model.score(*wordhash.buffers(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row by its whole text.

    Null counts as empty; an empty text has the score of a text without any listed feature. Repeated rows stay; other
    columns are not read.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold), f"doc_id {kind}, score double, predicted int")


def _reject(shared, threshold: float, text: int):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            yield batch.filter(pa.array(model.score(*wordhash.buffers(batch.column(text))) < threshold))

    return run


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns.

    Null and empty texts score as a text without any listed feature; equal texts stay or go together; rows without an id are
    judged as others. An empty table stays empty. Other columns, whatever their names, are carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_reject(shared, threshold, docs.columns.index("text")), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): a model from the labels outside the fold, scores for all."""
    held = (F.crc32(F.col("doc_id").cast("string")) % fold[0] == fold[1]).alias("held_out")
    return score(docs, train(docs, labels, fold), threshold).select("doc_id", held, "score", "predicted")
