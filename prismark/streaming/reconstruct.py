"""Sessions reconstructed while they are captured: tracks of features, their points, and what is known of each so far.

A session's captures come in order of their views. Its open tracks are Spark's state: each new view is matched with them, extends some, opens
others, and closes those that were not seen for a while; only open tracks stay in the state. A point is intersected anew from
its track's rays and held against parallax and reprojection error whenever the track grows.

Spark deals the work by session; a session is one device's, so its views and open tracks are bounded by what the device captures. Within a view
features are compared with open tracks by grid cells, or in blocks where there is no pixel gate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINTS = (
    "session_id long, version long, track_id long, state string, first_view long, last_view long, views long, x double, y double, z double, parallax double, max_error double, "
    "accepted boolean, late long, first_desc array<double>, last_desc array<double>"
)
_STATE = "version long, last long, next long, late long, until long, width long, tracks array<long>, first_desc array<double>, last_desc array<double>, seen array<long>, place array<double>"
#: Open tracks that are compared with a view's features at a time.
BLOCK = 1024


def triangulate(track: np.ndarray, n: int, u: np.ndarray, v: np.ndarray, origin: np.ndarray, rotation: np.ndarray, k: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, greatest angle in degrees between two rays, greatest reprojection error) of n tracks, numbered by `track`; nan where rays are parallel."""
    fx, fy, cx, cy = k
    # column by column, in the order in which `geometry.intersect_rays` sums and solves: where all rays leave one camera its centre is found but for rounding, and both round alike
    r, o = rotation.reshape(-1, 9).T, origin.T
    a, b = (u - cx) / fx, (v - cy) / fy
    size = np.sqrt(a * a + b * b + 1)
    s = (a / size, b / size, 1 / size)
    d = [r[3 * i] * s[0] + r[3 * i + 1] * s[1] + r[3 * i + 2] * s[2] for i in range(3)]
    sums = lambda x: np.bincount(track, x, n)
    m00, m11, m22 = (sums(1 - x * x) for x in d)
    m01, m02, m12 = (sums(-d[i] * d[j]) for i, j in ((0, 1), (0, 2), (1, 2)))
    along = d[0] * o[0] + d[1] * o[1] + d[2] * o[2]
    b0, b1, b2 = (sums(o[i] - d[i] * along) for i in range(3))
    det = m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02)
    det = np.where(det == 0, np.nan, det)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b0 * (m11 * m22 - m12 * m12) - m01 * (b1 * m22 - m12 * b2) + m02 * (b1 * m12 - m11 * b2)) / det
        y = (m00 * (b1 * m22 - m12 * b2) - b0 * (m01 * m22 - m12 * m02) + m02 * (m01 * b2 - b1 * m02)) / det
        z = (m00 * (m11 * b2 - b1 * m12) - m01 * (m01 * b2 - b1 * m02) + b0 * (m01 * m12 - m11 * m02)) / det
    point = np.stack([x, y, z], 1)
    order = np.argsort(track, kind="stable")
    t, e = track[order], [c[order] for c in d]
    least = np.full(n, 1.0)
    for lag in range(1, int(np.bincount(track, minlength=1).max(initial=0))):
        same = np.flatnonzero(t[lag:] == t[:-lag])
        np.minimum.at(least, t[same], e[0][same] * e[0][same + lag] + e[1][same] * e[1][same + lag] + e[2][same] * e[2][same + lag])
    q = [point[track, i] - o[i] for i in range(3)]
    own = [r[i] * q[0] + r[3 + i] * q[1] + r[6 + i] * q[2] for i in range(3)]
    with np.errstate(divide="ignore", invalid="ignore"):
        eu, ev = fx * own[0] / own[2] + cx - u, fy * own[1] / own[2] + cy - v
        error = np.where(own[2] > 1e-9, np.sqrt(eu * eu + ev * ev), np.inf)
    most = np.zeros(n)
    np.maximum.at(most, track, error)
    return point, np.degrees(np.arccos(np.clip(least, -1, 1))), most


def _near(place: np.ndarray, at: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of place, row of at) within neighbouring cells of the size of the gate."""
    cell, own = np.floor(place / gate).astype(np.int64), np.floor(at / gate).astype(np.int64)
    name = lambda c: c[:, 0] * (1 << 32) + c[:, 1]
    order = np.argsort(name(own), kind="stable")
    names, left, right = name(own)[order], [], []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            wanted = name(cell + np.array([dx, dy]))
            a, b = np.searchsorted(names, wanted, "left"), np.searchsorted(names, wanted, "right")
            i = np.repeat(np.arange(len(place)), b - a)
            left.append(i)
            right.append(order[np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[i]])
    return np.concatenate(left), np.concatenate(right)


def match(desc: np.ndarray, place: np.ndarray, new_desc: np.ndarray, at: np.ndarray, most: float, gate: float | None) -> np.ndarray:
    """For each new feature the open track that it continues, or -1: mutual nearest descriptors within `most` and within the gate; ties go to the first."""
    best = np.full(len(desc), -1)
    near, back, back_near = np.full(len(desc), np.inf), np.full(len(at), -1), np.full(len(at), np.inf)
    for a in range(0, len(desc), BLOCK):
        block = slice(a, a + BLOCK)
        if gate is None:
            i, j = (x.ravel() for x in np.indices((len(desc[block]), len(at))))
        else:
            i, j = _near(place[block], at, gate)
            inside = np.hypot(*(place[block][i] - at[j]).T) <= gate
            i, j = i[inside], j[inside]
        d = np.sqrt(((desc[block][i] - new_desc[j]) ** 2).sum(1))
        keep = d <= most
        i, j, d = i[keep] + a, j[keep], d[keep]
        order = np.lexsort((j, d, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        best[i[first]], near[i[first]] = j[first], d[first]
        order = np.lexsort((i, d, j))
        first = order[np.unique(j[order], return_index=True)[1]]
        better = first[d[first] < back_near[j[first]]]
        back[j[better]], back_near[j[better]] = i[better], d[better]
    return np.where((back >= 0) & (best[back] == np.arange(len(at))), back, -1)


class Session:
    """The open tracks of one session. An observation is a track's row, a view, a place u, v, and the camera's origin and rotation."""

    def __init__(self, state: tuple | None = None):
        self.version, self.last, self.next, self.late, self.until, width = state[:6] if state else (0, -(1 << 62), 0, 0, 0, 0)
        tracks, first, last, seen, place = (np.asarray(x) for x in state[6:]) if state else ((),) * 5
        self.tracks = np.asarray(tracks, np.int64)
        self.first_desc, self.last_desc = (np.asarray(x, float).reshape(len(self.tracks), width) for x in (first, last))
        self.seen = np.asarray(seen, np.int64).reshape(-1, 2)  # row of the track, view
        self.place = np.asarray(place, float).reshape(-1, 14)  # u, v, origin, rotation
        self.changed = np.zeros(len(self.tracks), bool)

    def dump(self) -> tuple:
        flat = lambda x: x.ravel().tolist()
        return (self.version, self.last, self.next, self.late, self.until, self.first_desc.shape[1], flat(self.tracks), flat(self.first_desc), flat(self.last_desc), flat(self.seen), flat(self.place))

    def views(self, how) -> np.ndarray:
        out = np.full(len(self.tracks), -(1 << 62) if how is np.maximum else 1 << 62)
        how.at(out, self.seen[:, 0], self.seen[:, 1])
        return out

    def open(self, ids: np.ndarray, desc: np.ndarray) -> np.ndarray:
        at = len(self.tracks) + np.arange(len(ids))
        self.tracks = np.concatenate([self.tracks, ids])
        wide = lambda x: x if len(x) else np.zeros((0, desc.shape[1]))
        self.first_desc, self.last_desc = np.concatenate([wide(self.first_desc), desc]), np.concatenate([wide(self.last_desc), desc])
        self.changed = np.concatenate([self.changed, np.ones(len(ids), bool)])
        return at

    def extend(self, row: np.ndarray, view: np.ndarray, place: np.ndarray) -> None:
        self.seen = np.concatenate([self.seen, np.stack([row, view], 1)])
        self.place = np.concatenate([self.place, place])
        self.changed[row] = True

    def told(self, ids: np.ndarray, view: np.ndarray, place: np.ndarray) -> None:
        """Observations whose tracks are known; their order does not matter."""
        fresh = np.setdiff1d(ids, self.tracks)
        self.open(fresh, np.zeros((len(fresh), 0)))
        order = np.argsort(self.tracks)
        self.extend(order[np.searchsorted(self.tracks[order], ids)], view, place)
        self.last = max(self.last, int(view.max()))

    def capture(self, view: int, desc: np.ndarray, place: np.ndarray, most: float, gate: float | None) -> None:
        """A view's features, in the order of their ids."""
        if view <= self.last:
            self.late += len(desc)
            return
        latest = np.zeros(len(self.tracks), np.int64)
        latest[self.seen[:, 0]] = np.arange(len(self.seen))  # observations stand in the order of their views
        row = match(self.last_desc, self.place[latest, :2], desc, place[:, :2], most, gate) if len(self.tracks) else np.full(len(desc), -1)
        new = row < 0
        row[new] = self.open(self.next + np.arange(new.sum()), desc[new])
        self.next += int(new.sum())
        self.last_desc[row] = desc
        self.extend(row, np.full(len(desc), view), place)
        self.last = view

    def rows(self, which: np.ndarray, state: np.ndarray, k: tuple, least_views: int, least_parallax: float, most_pixels: float):
        import pandas as pd

        number = np.cumsum(which) - 1
        own = which[self.seen[:, 0]]
        p = self.place[own]
        point, parallax, error = triangulate(number[self.seen[own, 0]], int(which.sum()), p[:, 0], p[:, 1], p[:, 2:5], p[:, 5:].reshape(-1, 3, 3), k)
        n = np.bincount(self.seen[:, 0], minlength=len(self.tracks))[which]
        fine = (n >= least_views) & np.isfinite(point).all(1) & (parallax >= least_parallax) & (error <= most_pixels)
        return pd.DataFrame({
            "version": self.version, "track_id": self.tracks[which], "state": state[which], "first_view": self.views(np.minimum)[which], "last_view": self.views(np.maximum)[which], "views": n, "x": point[:, 0], "y": point[:, 1], "z": point[:, 2],
            "parallax": parallax, "max_error": error, "accepted": fine, "late": self.late, "first_desc": list(self.first_desc[which]), "last_desc": list(self.last_desc[which]),
        })

    def forget(self, gone: np.ndarray) -> None:
        number = np.cumsum(~gone) - 1
        own = ~gone[self.seen[:, 0]]
        self.seen, self.place = self.seen[own], self.place[own]
        self.seen[:, 0] = number[self.seen[:, 0]]
        self.tracks, self.first_desc, self.last_desc, self.changed = self.tracks[~gone], self.first_desc[~gone], self.last_desc[~gone], np.zeros(int((~gone).sum()), bool)


def live_reconstruction(
    features: DataFrame, k: tuple[float, float, float, float], most_distance: float = 0.5, gate_pixels: float | None = None, most_gap: int | None = 2, least_views: int = 3, least_parallax: float = 1.0, most_pixels: float = 2.0, idle: str | None = None, time_col: str = "ts", delay: str = "10 seconds"
) -> DataFrame:
    """Rows of `POINTS` over a stream of features (session_id, view_id, feat_id, u, v, desc, origin, rotation): a row for each track that a batch changed.

    Of a track the row with the greatest `version` holds; `state` is open or closed. A view is matched with the open tracks: mutual nearest
    descriptors within `most_distance`, and within `gate_pixels` of where the track was last seen. A track that was not seen in the
    last `most_gap` views is closed and leaves the state, and a later feature opens a new one; `reassociate` joins those. A view that is not after the session's
    last one is late: its features are left out and counted in `late`, which a row of track -1 tells (state late). With a column `track_id` nothing is matched, no view is late, and no gap closes a track.
    `accepted` tells that a point has enough views, parallax and a small reprojection error. Rows with a null id, place or pose are left out.

    With `idle` (an interval) the column `time_col` gets a watermark of `delay`, and a session without rows for that long is closed. Thresholds are parameters; their defaults are our
    choice. Use output mode append; state is Spark's, so a query goes on from its checkpoint after a loss.
    """
    known = "track_id" in features.columns
    narrow = features.select(
        "session_id", "view_id", F.col("track_id" if known else "feat_id").alias("item"), "u", "v", (F.array().cast("array<double>") if known else F.col("desc").cast("array<double>")).alias("desc"), F.col("origin").cast("array<double>").alias("origin"), F.col("rotation").cast("array<double>").alias("rotation"), *([time_col, F.unix_millis(time_col).alias("ms")] if idle else [])
    ).dropna()
    quiet = int(features.sparkSession.sql(f"select unix_millis(timestamp'2000-01-01 00:00:00' + interval {idle}) - unix_millis(timestamp'2000-01-01 00:00:00') as ms").first()["ms"]) if idle else 0

    def fold(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        s = Session(state.get if state.exists else None)
        s.version, late = s.version + 1, s.late
        if state.hasTimedOut:
            s.changed[:] = True
            gone = np.ones(len(s.tracks), bool)
        else:
            f = pd.concat(list(frames)).sort_values(["view_id", "item"], kind="stable")
            view = f["view_id"].to_numpy(np.int64)
            place = np.column_stack([f["u"].to_numpy(float), f["v"].to_numpy(float), np.stack(f["origin"].to_list()), np.stack(f["rotation"].to_list())])
            if known:
                s.told(f["item"].to_numpy(np.int64), view, place)
            else:
                desc = np.stack(f["desc"].to_list())
                bounds = np.flatnonzero(np.diff(view, prepend=view[0] - 1, append=view[-1] + 1))
                for a, b in zip(bounds, bounds[1:]):
                    stale = s.views(np.maximum) < view[a] - most_gap if most_gap is not None and view[a] > s.last else np.zeros(0, bool)
                    if stale.any():
                        yield from closed(key, s, stale)
                    s.capture(int(view[a]), desc[a:b], place[a:b], most_distance, gate_pixels)
            gone = np.zeros(len(s.tracks), bool)
        if s.changed.any():
            yield shown(key, s, s.changed.copy(), gone)
        if s.late > late:
            nothing = dict.fromkeys(("first_view", "last_view", "views", "x", "y", "z", "parallax", "max_error"), 0)
            yield pd.DataFrame([{"session_id": key[0], "version": s.version, "track_id": -1, "state": "late", **nothing, "accepted": False, "late": s.late, "first_desc": [], "last_desc": []}])
        if state.hasTimedOut:
            state.remove()
            return
        s.changed[:] = False
        if idle:
            s.until = max(s.until, int(f["ms"].max()) + quiet)
        state.update(s.dump())
        if idle:
            state.setTimeoutTimestamp(max(s.until, state.getCurrentWatermarkMs() + 1))

    def shown(key: tuple, s: Session, which: np.ndarray, gone: np.ndarray):
        out = s.rows(which, np.where(gone, "closed", "open"), k, least_views, least_parallax, most_pixels)
        out.insert(0, "session_id", key[0])
        return out

    def closed(key: tuple, s: Session, gone: np.ndarray) -> Iterator:
        changed = s.changed[~gone]
        yield shown(key, s, gone, gone)
        s.forget(gone)
        s.changed = changed

    timed = narrow.withWatermark(time_col, delay) if idle else narrow
    return timed.groupBy("session_id").applyInPandasWithState(fold, POINTS, _STATE, "append", "EventTimeTimeout" if idle else "NoTimeout")


def latest(rows: DataFrame) -> DataFrame:
    """Of rows of `POINTS` each track's last, without those that tell of late features; closed rows win over open ones of one version."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("session_id", "track_id")]), F.struct("version", F.col("state") == "closed"))
    return rows.where("state <> 'late'").groupBy("session_id", "track_id").agg(last.alias("x")).select("session_id", "track_id", "x.*")


#: Rows that one partition of the state gets in all, about, and what the state's memory needs: no version is kept in memory for a next batch, as each query starts from the checkpoint.
PARTITION = 200_000
_MEMORY = {"spark.sql.streaming.maxBatchesToRetainInMemory": "0"}


def fed(batches: list[DataFrame], run, schema: str) -> DataFrame:
    """What `run` (a stream of DataFrames of one schema to a stream) gives when the batches come one after another, as a table.

    Each batch is written to the shared folder and taken by a query that starts from the checkpoint of the one before, as after a restart. An executor holds the
    state of the partitions that it works on and no other, and there are as many partitions as rows ask for.
    """
    import uuid

    from ..storage import shared_root

    spark = batches[0].sparkSession
    root = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    rows = 0
    for k, batch in enumerate(batches):
        batch.write.parquet(f"{root}/ready/batch={k}")
        rows += spark.read.schema(batch.schema).parquet(f"{root}/ready/batch={k}").count()
    wanted = _MEMORY | {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PARTITION + 1))}
    before = {c: spark.conf.get(c, None) for c in wanted}
    jvm = spark.sparkContext._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{root}/{x}")
    files = path("ready").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path("in"))
    try:
        for c, x in wanted.items():
            spark.conf.set(c, x)
        for k, batch in enumerate(batches):
            if not files.rename(path(f"ready/batch={k}"), path(f"in/batch={k}")):
                raise OSError(f"cannot rename {root}/ready/batch={k}")
            stream = run(spark.readStream.schema(batch.schema).parquet(f"{root}/in/batch=*"))
            query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for c, x in before.items():
            spark.conf.unset(c) if x is None else spark.conf.set(c, x)
    return spark.read.schema(schema).parquet(f"{root}/out")
