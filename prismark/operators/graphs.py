"""Matching and tracks: mutual nearest neighbours, connected components, joins on intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, durable


def connected(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) of links (a, b): the least node that each can reach.

    Minimum labels with pointer jumping: a round takes the least label among the neighbours, then the label of that
    label, so a chain of length n needs about log n rounds. Every round is written to the shared folder and the one before it
    deleted; only whether anything changed reaches the driver. Loops, repeated links and both directions are fine.
    """
    ends = links.select("a", "b").where("a <> b")
    both = durable(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = durable(step.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("far", "next")).alias("to")), "labels")
        discard(labels)
        labels = moved.select("node", F.col("to").alias("component"))
        if not moved.where("to < component").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, d: s + d)


def match_views(left: DataFrame, right: DataFrame, block: str = "pair_id", ratio: float | None = None, mutual: bool = True) -> DataFrame:
    """(block, a_id, b_id, distance): features (block, feat_id, desc) of one view and their nearest of the other.

    All pairs are compared within a block only, and only the least survive each step. Mutual and ratio tests are our choice.
    """
    a, b = left.select(block, F.col("feat_id").alias("a_id"), F.col("desc").alias("a_desc")), right.select(block, F.col("feat_id").alias("b_id"), F.col("desc").alias("b_desc"))
    pairs = a.join(b, block).select(block, "a_id", "b_id", F.sqrt(squared_distance("a_desc", "b_desc")).alias("distance"))
    mine = pairs.groupBy(block, "a_id").agg(F.min(F.struct("distance", "b_id")).alias("m"))
    if ratio is not None:
        second = pairs.join(mine.select(block, "a_id", F.col("m.b_id").alias("best")), [block, "a_id"]).where("b_id <> best").groupBy(block, "a_id").agg(F.min("distance").alias("second"))
        mine = mine.join(second, [block, "a_id"], "left").where(F.col("second").isNull() | (F.col("m.distance") < ratio * F.col("second"))).drop("second")
    mine = mine.select(block, "a_id", F.col("m.b_id").alias("b_id"), F.col("m.distance").alias("distance"))
    if not mutual:
        return mine
    theirs = pairs.groupBy(block, "b_id").agg(F.min(F.struct("distance", "a_id")).alias("m")).select(block, "b_id", F.col("m.a_id").alias("a_id"))
    return mine.join(theirs, [block, "a_id", "b_id"])


def match_views_lsh(left: DataFrame, right: DataFrame, most: float, bucket: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """(a_id, b_id, distance) within `most` for views too large for a block: random projections, then exact distances."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    a, b = (df.select("feat_id", array_to_vector("desc").alias("v")) for df in (left, right))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(a)
    return model.approxSimilarityJoin(a, b, most, "distance").select(F.col("datasetA.feat_id").alias("a_id"), F.col("datasetB.feat_id").alias("b_id"), "distance")


def tracks(matches: DataFrame, least_views: int = 3) -> DataFrame:
    """(track_id, view_id, feat_id): matches (view_a, a_id, view_b, b_id) closed into tracks over enough views.

    A track that meets one view twice is inconsistent and goes, which is our choice.
    """
    node = lambda v, f: F.struct(F.col(v).cast("long").alias("v"), F.col(f).cast("long").alias("f"))
    links = matches.select(node("view_a", "a_id").alias("a"), node("view_b", "b_id").alias("b"))
    found = connected(links).select("component", F.col("node.v").alias("view_id"), F.col("node.f").alias("feat_id"))
    good = found.groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("view_id").alias("views")).where((F.col("views") >= least_views) & (F.col("n") == F.col("views")))
    return found.join(good, "component").select(F.xxhash64("component").alias("track_id"), "view_id", "feat_id")


def reassociate(tracks: DataFrame, most_gap: int, most_distance: float, session: str = "session_id", cells: int = 2, rounds: int = 200) -> DataFrame:
    """(session, track_id, whole_id): tracks (session, track_id, first_view, last_view, first_desc, last_desc) joined to those that they continue after a gap.

    A track may continue one that was last seen up to `most_gap` views before it was first seen, if its first descriptor is within `most_distance` of the
    other's last. Of all such pairs the best are taken, one after another by distance, gap and ids, so that a track continues one other at most and is
    continued by one: in rounds, each of which takes all pairs that are the best of both their tracks. `whole_id` is the least track_id of a chain.

    Pairs meet by session, a bucket of views, and cells of the first `cells` components of their descriptors, which are as wide as `most_distance`; later tracks
    are dealt to the neighbouring cells too, so no pair is missed. Tracks without a descriptor stay alone. Every round is stored.
    """
    bucket = F.floor(F.col("last_view") / most_gap)
    cell = lambda desc, k: F.coalesce(F.floor(F.get(desc, F.lit(k)) / most_distance), F.lit(0))
    ends = tracks.where("size(last_desc) > 0").select(session, F.col("track_id").alias("a"), F.col("last_view"), F.col("last_desc"), bucket.alias("__t"), *[cell("last_desc", k).alias(f"__c{k}") for k in range(cells)])
    starts = tracks.where("size(first_desc) > 0").select(session, F.col("track_id").alias("b"), "first_view", "first_desc", *[cell("first_desc", k).alias(f"__c{k}") for k in range(cells)])
    reach = F.sequence(F.floor((F.col("first_view") - most_gap) / most_gap), F.floor((F.col("first_view") - 1) / most_gap))
    starts = starts.withColumn("__t", F.explode(reach))
    for k in range(cells):
        starts = starts.withColumn(f"__c{k}", F.explode(F.array(*[F.col(f"__c{k}") + d for d in (-1, 0, 1)])))
    gap = F.col("first_view") - F.col("last_view")
    pairs = ends.join(starts, [session, "__t", *[f"__c{k}" for k in range(cells)]]).where((gap > 0) & (gap <= most_gap) & (F.size("last_desc") == F.size("first_desc")))
    pairs = pairs.select(session, "a", "b", F.sqrt(squared_distance("last_desc", "first_desc")).alias("distance"), gap.alias("gap")).where(F.col("distance") <= most_distance)
    left, taken = durable(pairs, "pairs"), None
    for _ in range(rounds):
        order = F.struct("distance", "gap", "a", "b")
        best = left.select(session, "a", "b", order.alias("o"))
        mine, theirs = (best.groupBy(session, end).agg(F.min("o").alias("o")).select(session, "o.a", "o.b") for end in ("a", "b"))
        found = durable(mine.join(theirs, [session, "a", "b"]), "taken")
        if not found.limit(1).count():
            break
        taken = found if taken is None else taken.unionByName(found)
        rest = durable(left.join(found.select(session, "a"), [session, "a"], "left_anti").join(found.select(session, "b"), [session, "b"], "left_anti"), "pairs")
        discard(left)
        left = rest
    else:
        raise RuntimeError(f"pairs are left after {rounds} rounds")
    discard(left)
    ids = tracks.select(session, "track_id")
    if taken is None:
        return ids.withColumn("whole_id", F.col("track_id"))
    node = lambda end: F.struct(F.col(session).alias("s"), F.col(end).alias("t"))
    chains = connected(taken.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.s").alias(session), F.col("node.t").alias("track_id"), F.col("component.t").alias("whole_id"))
    return ids.join(chains, [session, "track_id"], "left").withColumn("whole_id", F.coalesce("whole_id", "track_id"))


def interval_join(samples: DataFrame, frames: DataFrame, keys: tuple[str, ...], ts: str = "ts", start: str = "t0", stop: str = "t1", width: float = 1.0) -> DataFrame:
    """Samples within [start, stop] of frames with the same keys; times in seconds as doubles.

    Both sides are dealt into buckets of `width` seconds, a frame into each that it touches, so it is an equi-join.
    """
    a = samples.withColumn("__b", F.floor(F.col(ts) / width))
    b = frames.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return a.join(b, [*keys, "__b"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(stop))).drop("__b")


def as_of(left: DataFrame, right: DataFrame, keys: tuple[str, ...], ts: str, value: str, tie: str) -> DataFrame:
    """Each left row with the latest right `value` at or before it, by one sort of both sides; ties of time by `tie`."""
    only = [c for c in left.columns if c not in keys and c != ts]
    a = left.select(*keys, ts, F.lit(1).alias("__side"), F.struct(*only).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"))
    b = right.select(*keys, ts, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"), F.col(tie).alias("__tie"))
    w = Window.partitionBy(*keys).orderBy(ts, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("__value", ignorenulls=True).over(w)).where("__side = 1").select(*keys, ts, "__row.*", value)


def corrections(predicted: DataFrame, confirmed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, predicted, confirmed, change) where they differ, null-safe; what only one side has differs."""
    both = predicted.select(key, F.col(value).alias("predicted")).join(confirmed.select(key, F.col(value).alias("confirmed")), key, "full_outer")
    change = F.when(F.col("predicted").isNull(), "added").when(F.col("confirmed").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("predicted").eqNullSafe(F.col("confirmed"))).withColumn("change", change)


def manifest_audit(manifest: DataFrame, registry: DataFrame, key: str = "dataset") -> DataFrame:
    """Manifest rows whose data set the license registry does not have."""
    return manifest.join(registry.select(key).distinct(), key, "left_anti")
