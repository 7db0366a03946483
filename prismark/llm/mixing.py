"""Mixing documents to target weights of domains that are known only softly.

A classifier, fitted to a labelled table, gives every document a posterior over domains. A document counts towards each
domain with its tokens times that posterior. Rates, one per document and nonnegative, are fitted so that the domains'
expected token totals meet their targets: least squares by projected gradient steps.

The loss weighs the K residuals by the inverse of M = sum of n p p' over the documents (n tokens, p posterior), and steps
are taken in the metric 1 / n, which makes the largest curvature 1; so a step of length 1 is safe at every size. One
step is one pass over the narrow table of (tokens, posterior), summed where it lies: K numbers go to the driver and K
come back.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fitting, lexical, wordhash
from .store import discard, durable, joined
from .tokens import Encoder

SAMPLE_ROWS = 12_000
FEATURES = 600
STEPS = 60
TOLERANCE = 1e-6
#: Targets missed by more than this share of all tokens are told (our choice).
MISSED = 1e-3


class Domains:
    """The classifier: names of the domains, listed features, weights."""

    def __init__(self, names: Sequence[str], listed: lexical.Listed, weight: np.ndarray, bias: np.ndarray):
        self.names, self.listed, self.weight, self.bias = list(names), listed, weight, bias


def fit_domains(docs: DataFrame, labelled: DataFrame, names: Sequence[str], sample_rows: int | None = SAMPLE_ROWS, features: int = FEATURES) -> Domains:
    """From `labelled` (doc_id, domain), about `sample_rows` rows of it by a hash of their id, or all if it is None.

    Labels of other domains, null labels and null ids are left out; of several labels of an id the one named last counts. The
    rows are written once, and everything is learned from them there.
    """
    place = F.coalesce(*[F.when(F.col("domain") == x, k) for k, x in enumerate(names)])
    known = labelled.select("doc_id", place.alias("kind")).where("kind is not null and doc_id is not null").groupBy("doc_id").agg(F.max("kind").alias("kind"))
    if sample_rows is None:
        rows = joined(docs, known, "text", "kind")
    else:
        rows = docs.select("doc_id", "text").join(F.broadcast(lexical.sample_by_hash(known, sample_rows, "doc_id", "domain")), "doc_id").select("text", "kind")
        rows = durable(rows, "sample")
    listed, _, sizes = lexical.choose(rows, len(names), features, shape=True)
    if not len(listed.features):
        share = (sizes + 0.5) / (sizes + 0.5).sum()
        discard(rows)
        return Domains(names, listed, np.zeros((0, len(names))), np.log(share))
    if sample_rows is None:
        weight, bias = fitting.fit(rows, listed, len(names), shape=True)
        discard(rows)
        return Domains(names, listed, weight, bias)
    kind, starts, columns = lexical.matrix(rows, listed, shape=True)
    discard(rows)
    return Domains(names, listed, *lexical.softmax_regression(np.eye(len(names))[kind], starts, columns, len(listed.features)))


def _posteriors(shared, vocabulary: str):
    def run(batches):
        domains: Domains = shared.value
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(1))
            for a, b in wordhash.chunks(offsets):
                own, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                p = lexical.posteriors(domains.listed.rows(own, at, shape=True), b - a, domains.weight, domains.bias)
                n = encoder.counts(own, at)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n.astype(np.int64)), *(pa.array(np.round(p[:, k], 6)) for k in range(p.shape[1]))], names=["doc_id", "n_tokens", *(f"p_{x}" for x in domains.names)])

    return run


def memberships(docs: DataFrame, domains: Domains, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>...): tokens of the vocabulary and posterior, to six decimals, of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "n_tokens long", *(f"p_{x} double" for x in domains.names)])
    return docs.select("doc_id", "text").mapInArrow(_posteriors(docs.sparkSession.sparkContext.broadcast(domains), vocabulary), schema)


def rates(p: np.ndarray, moves: np.ndarray, low: float, high: float) -> np.ndarray:
    """The rates after all steps so far: from 1, each step moves against the posterior's share of it, then clips."""
    out = np.full(len(p), min(max(1.0, low), high))
    for move in moves:
        out = np.clip(out - p @ move, low, high)
    return out


def _posterior_of(batch: pa.RecordBatch, first: int, k: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy() for i in range(k)], 1) if batch.num_rows else np.zeros((0, k))


def _totals(k: int, moves: np.ndarray, low: float, high: float):
    """Expected tokens of each domain in each batch; the columns are n_tokens and the posteriors."""

    def run(batches):
        for batch in batches:
            p = _posterior_of(batch, 1, k)
            sums = (batch.column(0).to_numpy() * rates(p, moves, low, high)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in sums], names=[f"s{i}" for i in range(k)])

    return run


def _with_rates(k: int, moves: np.ndarray, low: float, high: float):
    """The rows (doc_id, n_tokens, posteriors) with their rates."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(rates(_posterior_of(batch, 2, k), moves, low, high), 6))], names=[*batch.schema.names, "rate"])

    return run


def misses(reached: np.ndarray, wanted: np.ndarray) -> bool:
    return bool(np.abs(reached - wanted).max() > MISSED * max(wanted.sum(), 1))


def fit_rates(members: DataFrame, names: Sequence[str], targets: Mapping[str, float], total: float | None = None, low: float = 0.0, high: float = math.inf, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps taken, reached totals, wanted totals); `rates` turns the steps into a row's rate.

    `targets` are shares of the domains, any positive scale; `total` is the number of tokens wanted, that of the rows if
    not given. It ends when all totals are met, or a step changes none, to within TOLERANCE of all tokens. Where it ends
    with a total off by more than MISSED of the tokens wanted, a warning names what is reached and what is wanted.
    """
    k = len(names)
    p = [F.col(f"p_{x}") for x in names]
    n = F.col("n_tokens")
    first = members.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), *[F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    whole = float(first["n"])
    m = np.array([[first[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(m, rcond=1e-9)
    share = np.array([float(targets[x]) for x in names])
    wanted = share / share.sum() * (whole if total is None else total)
    moves, reached = np.zeros((0, k)), np.zeros(k)
    narrow = members.select("n_tokens", *p)
    for _ in range(steps):
        sums = narrow.mapInArrow(_totals(k, moves, low, high), ", ".join(f"s{i} double" for i in range(k)))
        row = sums.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()
        before, reached = reached, np.array([row[f"s{i}"] for i in range(k)])
        off = reached - wanted
        if np.abs(off).max() <= TOLERANCE * max(whole, 1) or (len(moves) and np.abs(reached - before).max() <= TOLERANCE * max(whole, 1)):
            break
        moves = np.vstack([moves, np.round(inverse @ off, 12)])
    if misses(reached, wanted):
        told = ", ".join(f"{x} {r:.0f} of {w:.0f}" for x, r, w in zip(names, reached, wanted))
        warnings.warn(f"mixing misses its targets: expected tokens reached of wanted: {told}", RuntimeWarning, stacklevel=2)
    return moves, reached, wanted


def repeating_total(members: DataFrame, names: Sequence[str], targets: Mapping[str, float]) -> float:
    """The least number of tokens at which the targets are met by repeating alone."""
    row = members.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{x}")), F.lit(0.0)).alias(x) for x in names]).first()
    whole = sum(float(targets[x]) for x in names)
    return max(row[x] * whole / float(targets[x]) for x in names)


def mixed(docs: DataFrame, domains: Domains, targets: Mapping[str, float], vocabulary: str, low: float = 0.0, high: float = math.inf, repeat_only: bool = False) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies, targets_met) for every row; with `repeat_only` no rate is below 1.

    copies is the rate, rounded down or up by a hash of the id so that its expectation is the rate. targets_met tells, alike in
    all rows, whether every domain's expected tokens are within MISSED of what was wanted. Null counts as empty: no
    tokens, and a rate from its posterior as any text. Rows that are repeated, and rows with a null id and one text, have
    the same rate. Without rows or tokens all rates are 1, within the bounds. Other columns are not read.
    """
    members = durable(memberships(docs, domains, vocabulary), "members")
    low = max(low, 1.0) if repeat_only else low
    total = repeating_total(members, domains.names, targets) if repeat_only else None
    moves, reached, wanted = fit_rates(members, domains.names, targets, total, low, high)
    rated = members.mapInArrow(_with_rates(len(domains.names), moves, low, high), ", ".join([*(f"{n} {t}" for n, t in members.dtypes), "rate double"]))
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("copies", copies).withColumn("targets_met", F.lit(bool(not misses(reached, wanted))))


def remixed(docs: DataFrame, domains: Domains, targets: Mapping[str, float], vocabulary: str, **options) -> DataFrame:
    """The rows of `docs` as often as their copies say, with all their columns.

    Rows with one id, and all rows without one, share the greatest of their rates; no row is lost when `repeat_only` is set. An
    empty table stays empty. Columns of any name may be there; they are carried whole.
    """
    copies = mixed(docs, domains, targets, vocabulary, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own")
    many = docs.select(own).join(copies, F.col("__own.doc_id").eqNullSafe(F.col("__id")))
    return many.select("__own", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__copy")).select("__own.*")


#: Domains of the labelled table of the driver: what a text is, by its two labels.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.92, "poor": 0.06, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled rows."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select("doc_id", kind.alias("domain"))
