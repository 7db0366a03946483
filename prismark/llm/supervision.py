"""Toxicity learned from all labelled rows, by the steps of `toxicity` as passes over stored tables.

Groups of alike rows, the label model of each, and the classifier are fitted to sums over all rows. Rows with the same groups,
votes and label are one pattern with a count; label models see only patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fitting, lexical, toxicity
from .fitting import listed_columns, sliced, summed
from .store import discard, durable
from .toxicity import ALIKE, FREQUENT, GROUPS, INSULTS, L2, NEARLY, PATTERNS, SHARE_ROWS

FIRST = np.cumsum([0, *GROUPS])  # the place of each number's first group among all


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-9, np.sqrt((v * v).sum(1, keepdims=True)))


class Alike:
    """Means of groups of alike rows for each number of groups, as `toxicity.alike` finds them; `means` is empty without frequent features."""

    def __init__(self, rows: DataFrame, width: int, rounds: int = 20):
        freq = summed(rows, lambda batch: np.append(np.bincount(listed_columns(batch.column("columns"))[1], minlength=width), batch.num_rows), width + 1)
        common = np.argsort(-freq[:-1], kind="stable")[:ALIKE]
        common = common[freq[common] >= max(1, FREQUENT * freq[-1])]
        self.k, self.place, self.means = len(common), np.full(width, -1), {}
        self.place[common] = np.arange(self.k)
        if not self.k:
            return
        counts = np.cumsum(summed(rows, lambda batch: np.bincount(self.rows(batch)[1].astype(int), minlength=self.k + 1), self.k + 1))
        self.median = np.searchsorted(counts, [(freq[-1] - 1) // 2, freq[-1] // 2], "right").mean()
        mean = summed(rows, lambda batch: self._rich(batch).sum(0), self.k)[None]  # only its direction counts
        for _ in range(max(GROUPS) - 1):
            mean = np.vstack([mean, self._least_alike(rows, mean)])
        mean = {many: mean[:many] for many in GROUPS if many > 1}
        for _ in range(rounds):
            self.means = mean
            sums = summed(rows, self._sums, sum(mean) * self.k).reshape(-1, self.k)
            parts = np.split(sums, np.cumsum(list(mean))[:-1])
            mean = {many: np.where(s.any(1, keepdims=True), s, old) for (many, old), s in zip(mean.items(), parts)}
            if all(np.allclose(_unit(mean[m]), _unit(self.means[m]), atol=1e-12) for m in mean):
                break

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Frequent features of each row, at length 1, and how many."""
        row, column = listed_columns(batch.column("columns"))
        here = self.place[column] >= 0
        x = np.zeros((batch.num_rows, self.k))
        x[row[here], self.place[column[here]]] = 1
        size = x.sum(1)
        return x / np.sqrt(np.maximum(1, size))[:, None], size

    def _rich(self, batch: pa.RecordBatch) -> np.ndarray:
        x, size = self.rows(batch)
        return x[size >= self.median]

    def _least_alike(self, rows: DataFrame, mean: np.ndarray) -> np.ndarray:
        def run(batches):
            for batch in sliced(batches):
                x = self._rich(batch)
                if len(x):
                    near = np.round((x @ _unit(mean).T).max(1), 12)
                    at = np.flatnonzero(near == near.min())
                    first = min(np.flatnonzero(r).tolist() for r in np.unique(x[at], axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array([near.min()]), pa.array([first], pa.list_(pa.int32()))], names=["near", "places"])

        found = rows.mapInArrow(run, "near double, places array<int>").orderBy("near", "places").limit(1).first()["places"]
        out = np.zeros(self.k)
        out[found] = 1 / np.sqrt(max(1, len(found)))
        return out

    def _sums(self, batch: pa.RecordBatch) -> np.ndarray:
        x, _ = self.rows(batch)
        return np.concatenate([np.eye(many)[(x @ _unit(mean).T).argmax(1)].T @ x for many, mean in self.means.items()]).ravel()

    def groups(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """The group of each row, for each number of groups."""
        if not self.means:
            return [np.zeros(batch.num_rows, int) for _ in GROUPS]
        x, _ = self.rows(batch)
        return [(x @ _unit(self.means[many]).T).argmax(1) if many in self.means else np.zeros(len(x), int) for many in GROUPS]


class Voters:
    """The lexicons and patterns; votes as bits of an integer."""

    def __init__(self, names: list[str], lexicon: np.ndarray):
        self.lexicon, self.n_lexicons = lexicon, len(names)
        self.names = names + [f"{v}_several" for v in names[len(INSULTS) :]] + list(PATTERNS)
        self.bits = np.arange(len(self.names), dtype=np.int64)

    def cast(self, batch: pa.RecordBatch) -> np.ndarray:
        """Votes of each row."""
        size = batch.column("columns").value_lengths().to_numpy(zero_copy_only=False)
        columns = batch.column("columns").flatten().to_numpy()
        return toxicity.votes(np.append(0, np.cumsum(size)), columns, batch.column("shown").to_numpy(), self.lexicon, self.n_lexicons)

    def of_pattern(self, batch: pa.RecordBatch) -> np.ndarray:
        return (batch.column("votes").to_numpy()[:, None] >> self.bits & 1).astype(float)


def _patterns(shared):
    def run(batches):
        alike, voters = shared.value
        for batch in sliced(batches):
            cast = voters.cast(batch).astype(np.int64) @ (np.int64(1) << voters.bits)
            yield pa.RecordBatch.from_arrays([*(pa.array(g.astype(np.int32)) for g in alike.groups(batch)), pa.array(cast), batch.column("kind"), batch.column("half")], names=[*(f"g{i}" for i in range(len(GROUPS))), "votes", "kind", "half"])

    return run


class SummedModel(toxicity.LabelModel):
    """The label model of a group, from sums over its patterns: each step takes the sums under the posterior of the one before."""

    def __init__(self, belief: np.ndarray, share: float, n: int):
        self.n, self.share, self.belief = n, share, belief
        self.prior, self.rate, self.weight = np.clip(share, 1e-4, 1 - 1e-4), np.clip(belief, 1e-6, 1 - 1e-6), np.ones(belief.shape[1])
        self.correlation, self.best = np.eye(belief.shape[1]), None

    @staticmethod
    def width(voters: int) -> int:
        return 2 + 2 * (voters**2 + 2 * voters + 3)

    def sums(self, votes: np.ndarray, label: np.ndarray, count: np.ndarray) -> np.ndarray:
        p = self.posterior(votes)
        q, clipped = 1 - p, np.clip(p, 0.01, 0.99)
        out = [[count @ p, -(count @ np.where(label == 1, np.log(clipped), np.log(1 - clipped)))]]
        for w in (count * q, count * p):
            out += [((votes * w[:, None]).T @ votes).ravel(), (w * q) @ votes, (w * p) @ votes, [w @ (q * q), w @ (q * p), w @ (p * p)]]
        return np.concatenate(out)

    def look(self, sums: np.ndarray) -> None:
        """Keep what the sums were made with, if its loss is the least."""
        if self.best is None or sums[1] / self.n < self.best[0]:
            self.best = sums[1] / self.n, self.prior, self.rate, self.weight, self.correlation

    def step(self, sums: np.ndarray) -> None:
        """As a round of `LabelModel`; what votes are off their expectation is multiplied out, for it depends on the new rates."""
        v = self.belief.shape[1]
        yes = sums[0]
        mass = np.array([self.n - yes, yes])
        parts = [np.split(x, np.cumsum([v * v, v, v])) for x in np.split(sums[2:], 2)]
        voted = np.stack([np.diag(a[0].reshape(v, v)) for a in parts])
        strength = self.PRIOR * self.n * np.array([[1 - self.share], [self.share]])
        self.prior = np.clip((yes + self.PRIOR * self.n * self.share) / (self.n * (1 + self.PRIOR)), 1e-4, 1 - 1e-4)
        self.rate = np.clip((voted + strength * self.belief + 1e-3) / (mass[:, None] + strength + 2e-3), 1e-6, 1 - 1e-6)
        no, yes = self.rate
        found = []
        for (both, with_no, with_yes, square), total in zip(parts, mass):
            cross = np.outer(with_no, no) + np.outer(with_yes, yes)
            off = both.reshape(v, v) - cross - cross.T + square[0] * np.outer(no, no) + square[1] * (np.outer(no, yes) + np.outer(yes, no)) + square[2] * np.outer(yes, yes)
            spread = np.sqrt(np.maximum(np.diag(off), 0) / max(total, 1e-9) + 1e-4)
            found.append(off / max(total, 1e-9) / np.outer(spread, spread) * min(1, total / 10))
        self.correlation = np.maximum(*found)
        self.weight = 1 / np.maximum(1, np.clip(self.correlation, 0, 1).sum(0))

    def settle(self) -> None:
        self.loss, self.prior, self.rate, self.weight, self.correlation = self.best


def _by_group(batch: pa.RecordBatch, voters: Voters, width: int, sums, numbers=range(len(GROUPS))) -> np.ndarray:
    """`sums(place of the group, votes, kind, half, count)` of each group's patterns, at the group's place."""
    cast, count = voters.of_pattern(batch), batch.column("n").to_numpy().astype(float)
    kind, half = batch.column("kind").to_numpy(), batch.column("half").to_numpy()
    out = np.zeros((FIRST[-1], width))
    for i in numbers:
        place = FIRST[i] + batch.column(f"g{i}").to_numpy()
        for g in np.unique(place):
            mine = place == g
            out[g] = sums(g, cast[mine], kind[mine], half[mine], count[mine])
    return out.ravel()


def label_models(patterns: DataFrame, voters: Voters, rounds: int = 40) -> dict[int, SummedModel]:
    """The model of each group that has rows, by its place; all numbers of groups at once."""
    v, groups = len(voters.names), int(FIRST[-1])

    def first(_, cast, kind, half, count):
        fresh = [count * ((half == 1) & (kind == k)) for k in (0, 1)]
        return np.concatenate([[count.sum(), count @ (kind == 1), fresh[0].sum(), fresh[1].sum()], fresh[0] @ cast, fresh[1] @ cast])

    known = summed(patterns, lambda batch: _by_group(batch, voters, 4 + 2 * v, first), groups * (4 + 2 * v)).reshape(groups, -1)
    toxic = known[0, 1] / max(known[0, 0], 1)  # GROUPS begins with one group of all rows
    models = {}
    for g in np.flatnonzero(known[:, 0]).tolist():
        n, label, fresh, cast = known[g, 0], known[g, 1], known[g, 2:4], known[g, 4:].reshape(2, v)
        models[g] = SummedModel((cast + 0.5) / (fresh[:, None] + 1), float((label + SHARE_ROWS * toxic) / (n + SHARE_ROWS)), int(n))
    width = SummedModel.width(v)
    for step in range(rounds + 1):
        sums = summed(patterns, lambda batch: _by_group(batch, voters, width, lambda g, cast, kind, _, count: models[g].sums(cast, kind, count)), groups * width).reshape(groups, -1)
        before = {g: m.rate for g, m in models.items()}
        for g, m in models.items():
            m.look(sums[g])
            if step < rounds:
                m.step(sums[g])
        if all(np.abs(m.rate - before[g]).max() < 1e-7 for g, m in models.items()):
            break
    for m in models.values():
        m.settle()
    return models


def _targets(shared, number: int):
    def run(batches):
        alike, voters, models = shared.value
        for batch in sliced(batches):
            group, cast, target = FIRST[number] + alike.groups(batch)[number], voters.cast(batch), np.zeros(batch.num_rows)
            for g in np.unique(group):
                target[group == g] = models[g].posterior(cast[group == g])
            yield pa.RecordBatch.from_arrays([pa.array(target), batch.column("columns")], names=["target", "columns"])

    return run


def _soft(batch: pa.RecordBatch) -> np.ndarray:
    target = batch.column("target").to_numpy()
    return np.stack([1 - target, target], 1)


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (3, 1), features: int = toxicity.FEATURES) -> toxicity.Model:
    """A model from all labelled rows outside the fold; nulls, several labels and lone kinds are taken as in `toxicity.train`."""
    spark = docs.sparkSession
    rows = toxicity.labelled_rows(docs, labels, "toxic", fold, None)
    listed, counts, sizes = lexical.choose(rows.where("half = 0"), 2, features, least_docs=4)
    listed = toxicity.Listed(listed.features)
    if not sizes.all() or not len(counts):
        discard(rows)
        share = (sizes[1] + 0.5) / (sizes.sum() + 1)
        return toxicity.Model(listed, np.zeros((listed.width, 2)), np.log([1 - share, share]))
    found = durable(rows.select("text", "kind", "half").mapInArrow(toxicity._shown(spark.sparkContext.broadcast(listed)), "kind int, half int, shown int, columns array<int>"), "features")
    discard(rows)
    alike, voters = Alike(found, listed.width), Voters(*toxicity.lexicons(listed, counts, sizes))
    names = [f"g{i}" for i in range(len(GROUPS))]
    patterns = found.mapInArrow(_patterns(spark.sparkContext.broadcast((alike, voters))), ", ".join([*(f"{g} int" for g in names), "votes long, kind int, half int"]))
    patterns = durable(patterns.groupBy(*names, "votes", "kind", "half").agg(F.count("*").alias("n")), "patterns")
    models = label_models(patterns, voters)
    of = [{g: m for g, m in models.items() if FIRST[i] <= g < FIRST[i + 1]} for i in range(len(GROUPS))]
    mean = lambda i, get: sum(m.n * get(m) for m in of[i].values()) / sum(m.n for m in of[i].values())
    loss = [mean(i, lambda m: m.loss) for i in range(len(GROUPS))]
    number = next(i for i in range(len(GROUPS)) if loss[i] <= NEARLY * min(loss))

    def report(g, cast, kind, _, count):
        post = models[g].posterior(cast)
        return np.concatenate([count @ cast, [count @ ((post >= 0.5) != (kind == 1)), count @ np.abs(post - kind)]])

    v = len(voters.names)
    told = summed(patterns, lambda batch: _by_group(batch, voters, v + 2, report, [number]), int(FIRST[-1]) * (v + 2)).reshape(-1, v + 2).sum(0)
    target = durable(found.mapInArrow(_targets(spark.sparkContext.broadcast((alike, voters, of[number])), number), "target double, columns array<int>"), "targets")
    discard(found)
    discard(patterns)
    weight, bias = fitting.softmax_regression(target, _soft, listed.width, 2, l2=L2)
    discard(target)
    n, apart = sum(m.n for m in of[number].values()), mean(number, lambda m: m.correlation - np.diag(np.diag(m.correlation)))
    accuracy, heard = mean(number, lambda m: m.accuracy()), mean(number, lambda m: m.weight)
    return toxicity.Model(listed, weight, bias, {
        "voters": [(x, float(told[j] / n), float(accuracy[j]), float(heard[j]), voters.names[int(apart[j].argmax())]) for j, x in enumerate(voters.names)],
        "rows": n, "groups": sorted(m.n for m in of[number].values()), "log_loss": float(loss[number]),
        "labels_overruled": int(told[-2]), "mean_distance_to_label": float(told[-1] / n),
    })
