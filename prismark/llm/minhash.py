"""Near-duplicate detection: b-bit MinHash signatures joined by a multi-index over their chunks.

A document's set is its distinct n-word shingles. `SLOTS` minima of the hashed set, `BITS` bits each, are its
signature; the number of slots in which two signatures differ is their distance. Signatures are cut into
`CHUNKS` chunks of `WIDTH` slots. By the pigeonhole principle two signatures within distance
CHUNKS * (ERRORS + 1) - 1 agree in all but ERRORS slots of at least one chunk, so every chunk is indexed once
for each choice of the slots that may be wrong (ERRORS = 1: each slot left out in turn). All pairs under that
distance therefore share a bucket.

Links are decided on the full sets, never on signatures. A bucket is not expanded into pairs:

1. Documents with equal sets are one class; a class takes part once.
2. Buckets with the same members count once. Each member is compared with its bucket's smallest member.
   Confirmed links give components.
3. Only in buckets whose other members still lie in several components are members of different components compared. Of two
   such members one at least is outside the bucket's largest component, so those are held against the whole bucket, in a
   grid of blocks of about `BLOCK` by `BLOCK` members. Members of one component need no comparison: a link between them
   changes nothing.

Before the sets of two members are fetched they are held against each other by their profiles: how many members of a set fall
into each of `CELLS` cells of their hashes. The sum of the lesser counts bounds the intersection from above, so pairs that it
rules out are no links, and no link is lost by it.

Large groups of near copies so cost one comparison per member and bucket, unless they fall apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .membership import filter_of
from .store import discard, durable, looked_up, rows_kept

CHUNKS, WIDTH, ERRORS, BITS = 13, 5, 1, 16
SLOTS = CHUNKS * WIDTH
#: All pairs within this distance share a bucket.
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Cells of a profile.
CELLS = 128
#: Members of a bucket, about, on each side of a block of comparisons.
BLOCK = 2048

_SEEDS = np.random.default_rng(7).integers(0, 2**63, SLOTS, dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of SLOTS b-bit minima for each non-empty set; zeros for an empty one."""
    out = np.zeros((len(starts) - 1, SLOTS), np.uint16)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        for k in range(SLOTS):
            low = np.minimum.reduceat(((hashes ^ _SEEDS[k]) * _MULT) >> np.uint64(8), starts[full])
            out[full, k] = (wordhash.mix(low) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return out


def profiles(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of CELLS counts for each set; 255 all over where a count does not fit, which rules nothing out."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    cell = (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    out = np.bincount(doc * CELLS + cell, minlength=(len(starts) - 1) * CELLS).reshape(-1, CELLS)
    out[(out >= 255).any(1)] = 255
    return out.astype(np.uint8)


def possible(s: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these profiles may be similar; the arrays broadcast against each other but for the last axis."""
    most = np.minimum(s, t).sum(-1, dtype=np.int32)
    both = s.sum(-1, dtype=np.int32) + t.sum(-1, dtype=np.int32)
    return (100 * most >= percent * (both - most)) | (s[..., 0] == 255) | (t[..., 0] == 255)


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """The keys of each row: for each chunk and each slot left out, a hash of the rest."""
    keys = []
    for c in range(CHUNKS):
        for out in range(WIDTH):
            key = np.full(len(signature), c * WIDTH + out + 1, np.uint64)
            for j in range(WIDTH):
                if j != out:
                    key = wordhash.mix(key * _MULT + signature[:, c * WIDTH + j])
            keys.append(key)
    return np.stack(keys, 1)


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _stand_in(digest: bytes) -> int:
    """The node of a class whose rows have no id."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _sketch(n: int):
    def run(batches):
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(1))
            for a, b in wordhash.chunks(offsets):
                hashes, starts = wordhash.shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                sig = signatures(hashes, starts)
                digests = [_digest(hashes[x:y]) for x, y in zip(starts[:-1], starts[1:])]
                ids = batch.column(0)[a:b]
                named = [None if known else _stand_in(d) for known, d in zip(ids.is_valid().to_pylist(), digests)]
                prof = profiles(hashes, starts)
                yield pa.RecordBatch.from_arrays([ids, batch.column(2)[a:b], pa.array(named, pa.int64()), pa.array(np.diff(starts), pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, [r.tobytes() for r in sig], [r.tobytes() for r in prof]))], names=["doc_id", "given", "stand_in", "n_shingles", "digest", "signature", "profile"])

    return run


def _keys(batches):
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            keys = bucket_keys(sig).view(np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "node"])


def _sets(n: int, wanted):
    def run(batches):
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(~known | wanted.value.maybe(batch.column(0).fill_null(0).to_numpy())))
            buf, offsets = wordhash.buffers(batch.column(1))
            for a, b in wordhash.chunks(offsets):
                hashes, starts = wordhash.shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                members = [hashes[x:y] for x, y in zip(starts[:-1], starts[1:])]
                nodes = np.array([_stand_in(_digest(m)) if i is None else i for i, m in zip(batch.column(0)[a:b].to_pylist(), members)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([m.tobytes() for m in members], pa.binary())], names=["node", "members"]).filter(pa.array(wanted.value.maybe(nodes)))

    return run


def _profiles_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _unlikely_out(percent: int):
    """Pairs (a, b, s, t) that the profiles s and t do not rule out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(possible(_profiles_of(batch.column(2)), _profiles_of(batch.column(3)), percent)))

    return run


def _partnered(percent: int):
    """The members of a block that have a possible partner on the other side, in another component."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        comp, prof = table.column("component").to_numpy(), _profiles_of(table.column("profile"))
        keep = np.zeros(len(comp), bool)
        step = max(1, (1 << 16) // max(1, len(right)))
        for k in range(0, len(left), step):
            rows = left[k : k + step]
            near = possible(prof[rows][:, None, :], prof[right][None, :, :], percent) & (comp[rows][:, None] != comp[right][None, :])
            keep[rows] |= near.any(1)
            keep[right] |= near.any(0)
        return table.select(["key", "node", "component"]).filter(pa.array(keep))

    return run


def _similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                keep.append(bool(_similar(int((t[at] == s).sum()), len(s), len(t), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int):
    """Links between the sides of a block, of members in different components: rows (left, node, component, members)."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy(zero_copy_only=False)
        node, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        sizes = np.array([len(s) for s in sets])
        right = np.flatnonzero(~side)
        a, b = [], []
        if len(right):
            universe, flat = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
            starts = np.cumsum(sizes[right]) - sizes[right]
            has = np.zeros(len(universe), np.int64)
            for i in np.flatnonzero(side):
                other = (comp[right] != comp[i]) & (np.minimum(sizes[right], sizes[i]) * 100 >= percent * np.maximum(sizes[right], sizes[i]))
                if not other.any():
                    continue
                at = np.minimum(np.searchsorted(universe, sets[i]), len(universe) - 1)
                own = at[universe[at] == sets[i]]
                has[own] = 1
                inter = np.add.reduceat(has[flat], starts)
                has[own] = 0
                hit = right[other & _similar(inter, sizes[right], sizes[i], percent)]
                _, first = np.unique(comp[hit], return_index=True)  # one link to each other component is enough
                a += [node[i]] * len(first)
                b += node[hit[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _contested(placed: DataFrame) -> DataFrame:
    """Rows (key, node, component, left, block) of the buckets that hold several components, dealt into a grid of blocks.

    The left side has the members outside the bucket's largest component, the right side all; a block has about BLOCK members
    of each, whatever the bucket's size.
    """
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    split = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    split = split.select("key", F.col("top.component").alias("largest"), F.ceil((F.col("n") - F.col("top.m")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("columns"))
    part = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(of)).cast("int")
    up_to = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    block = lambda left, i, j: F.struct(F.lit(left).alias("left"), (i * F.col("columns") + j).alias("block"))
    as_left = F.when(F.col("component") != F.col("largest"), F.transform(up_to("columns"), lambda j: block(True, part("row", "rows"), j))).otherwise(F.array().cast("array<struct<left:boolean,block:int>>"))
    as_right = F.transform(up_to("rows"), lambda i: block(False, i, part("column", "columns")))
    return looked_up(placed, split, ["key"], ["node"]).withColumn("at", F.explode(F.concat(as_left, as_right))).select(*placed.columns, "at.left", "at.block")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`; with `row_col`, a key of the rows, that too.

    Words are runs of bytes other than space and 9-13, A-Z lower-cased. Two documents are linked if their sets'
    Jaccard similarity is at least percent / 100; component_id is the smallest id reachable over links.

    Null and empty texts and texts without words have no shingles and are linked with nothing. Texts shorter than
    a shingle have their whole sequence as their only one. Rows with the same id count as one document (their
    rows all stay). Each row without an id is a document of its own: an id in its component goes before it; where there is
    none, component_id is null and one of the rows stays. Their nodes are 64-bit hashes of their sets. An empty table gives
    an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(row_col) if row_col else F.lit(None).cast("string")).alias("given"))
    sketches = docs.mapInArrow(_sketch(shingle), f"doc_id long, given {docs.schema['given'].dataType.simpleString()}, stand_in long, n_shingles long, digest binary, signature binary, profile binary")
    sketches = durable(sketches.withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", "stand_in").alias("node"), "signature", "profile")).alias("x")
    classes = durable(sketches.where("n_shingles > 0").groupBy("digest").agg(least).select("digest", "x.unnamed", "x.node", "x.signature", "x.profile"), "classes")

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: a signature becomes 65 rows
    keyed = classes.select("node", "signature").repartition(tasks, "node").mapInArrow(_keys, "key long, node long")
    mixed = F.xxhash64("node")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.bit_xor(mixed).alias("x"), F.sum(F.shiftright(mixed, 20)).alias("s")).where("n > 1")
    buckets = buckets.groupBy("n", "leader", "x", "s").agg(F.min("key").alias("key")).select("key", "n", "leader")
    live = durable(keyed.join(buckets, "key").where("node <> leader").distinct(), "buckets")

    profiled = classes.select("node", "profile").distinct()  # several of a node whose rows have different texts
    pairs = live.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(profiled.select(F.col("node").alias("a"), F.col("profile").alias("s")), "a").join(profiled.select(F.col("node").alias("b"), F.col("profile").alias("t")), "b")
    pairs = durable(pairs.select("a", "b", "s", "t").mapInArrow(_unlikely_out(percent), "a long, b long").distinct(), "pairs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, members) of the documents that are asked for; the filter keeps most others out of the shuffle."""
        nodes = durable(nodes.distinct(), "involved")
        wanted = docs.sparkSession.sparkContext.broadcast(filter_of(nodes))
        return durable(docs.select("doc_id", "text").mapInArrow(_sets(shingle, wanted), "node long, members binary").join(nodes, "node").where(F.length("members") > 0).distinct(), "sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("s")), sets.select(F.col("node").alias("b"), F.col("members").alias("t"))
    first = durable(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(_confirm(percent), "a long, b long"), "links")

    found = components(first)
    placed = live.where("n > 2").join(found.withColumnRenamed("component", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("component"))
    open_ = durable(_contested(placed).join(profiled, "node").groupBy("key", "block").applyInArrow(_partnered(percent), "key long, node long, component long").distinct(), "open")
    more = sets_of(open_.select("node"))
    second = _contested(open_).join(more, "node").groupBy("key", "block").applyInArrow(_across(percent), "a long, b long")
    links = durable(first.unionByName(second).distinct(), "links")

    labels = components(links)
    of_class = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "given", "row", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    if sketches.where("doc_id is null").limit(1).count():
        out = _renamed(out, classes, labels)
    else:
        out = out.select("doc_id", "given", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    for used in (live, pairs, first, open_, sets, more, links, found):
        discard(used)
    return out.select(*([F.col("given").alias(row_col)] if row_col else []), "doc_id", "n_shingles", "component_id", "kept")


def _renamed(out: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """`out` with component_id and kept where some rows have no id: components are named after the least id that they have."""
    nodes = classes.select("node", "unnamed").distinct().join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = nodes.groupBy("component").agg(F.min(F.when(~F.col("unnamed"), F.col("node"))).alias("component_id"))
    named = names.where("component_id is null or component_id <> component").withColumn("other", F.lit(True))
    # a label that is an id is its component's name already, so only the components of other labels are looked up
    looked = durable(out.join(named, "component", "left").select("doc_id", "given", "row", "n_shingles", "component", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("other"), F.col("component_id")).otherwise(F.col("component")).alias("component_id")), "looked")
    with_id = looked.where("doc_id is not null").withColumn("kept", F.col("doc_id") == F.col("component_id"))
    without = looked.where("doc_id is null")
    firsts = without.where("component_id is null and n_shingles > 0").groupBy("component").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    without = without.join(firsts, "row", "left").withColumn("kept", F.coalesce("first", F.col("n_shingles") == 0))
    columns = ["doc_id", "given", "n_shingles", "component_id", "kept"]
    return with_id.select(*columns).unionByName(without.select(*columns))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, one document of each component, with all their columns.

    Null and empty texts are linked with nothing and stay. Of rows without an id that are alike one stays, and none where a
    row with an id is like them; rows with one id are one document and stay or go together. An empty table stays empty.
    """
    return rows_kept(docs, lambda named: near_duplicates(named, shingle, percent, row_col="name").where("kept"))
