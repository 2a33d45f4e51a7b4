"""Structured Streaming versions of the ordered-series operators. Event times are TIMESTAMP, not TIMESTAMP_NTZ, for watermarks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ringframe.sources.scratch import checkpointed, remove, shared_folder


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder (those that match `pattern`) as a stream of events, with `ts` as a timestamp."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and return its rows, cut off in the shared folder.

    Rows are appended to Parquet there, with progress and state beside; both go once the rows are read back. Only windows and
    frames that the watermark has closed are in it: those still open are lost with the state, so a stream that is to go on
    is run by `run_stream` with a folder of its own.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}_{uuid4().hex}"
    try:
        run_stream(stream, base)
        return checkpointed(spark.read.schema(stream.schema).parquet(f"{base}/rows"))
    finally:
        remove(spark, base)


def run_stream(stream: DataFrame, base: str) -> None:
    """Take in what is there since the last run with the folder `base`, append to base/rows, and end."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # arbitrary keyed state asks for it
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress")
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def dealt(rows: DataFrame, part, folder: str) -> None:
    """Write `rows` as a stream's files, one after the other by `part` (few numbers), so that a stream meets them in that order."""
    marked = rows.withColumn("_part", part)
    for number in sorted(r[0] for r in marked.select("_part").distinct().collect()):
        marked.where(F.col("_part") == number).drop("_part").coalesce(1).write.mode("append").parquet(folder)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per event type and window: count and sum in cents; rows later than the watermark are left out."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"))


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Per user the sessions that a pause of `gap` ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


# Pairs of two frames' hotspots that share cells: as many meet in a band, and are compared at a time.
PAIRS = 8_000_000
CHUNK = 500_000
# Width of the first band of costs above the least that areas allow.
BAND = 0.25


class Tracker(StatefulProcessor):
    """Hotspots of a sequence, matched with the frame before; a frame is settled once the watermark has passed its end.

    State of a sequence: the hotspots of frames that are still open, by frame, and the last settled frame's hotspots with
    their tracks. A timer at each frame's end settles it and all earlier ones. A track that the next frame does not go on
    with is lost with that frame; rows of settled frames come too late and are left out.
    """

    def __init__(self, reach: float, max_ratio: float) -> None:
        self.reach, self.max_ratio = reach, max_ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        spots = "array<struct<hotspot_id:bigint,hole:bigint,x:double,y:double,area:double,score:double>>"
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame_id int", f"ends bigint, spots {spots}")
        self.last = handle.getValueState("last", f"frame_id int, next_track bigint, spots {spots}, tracks array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        found: dict[int, tuple[int, list]] = {}
        for r in rows:
            if last is None or r.frame_id > last:
                found.setdefault(r.frame_id, (r.ends, []))[1].append((r.hotspot_id, r.nearest_hole_id, r.x, r.y, r.area_px, r.score))
        for frame, (ends, spots) in found.items():
            if self.waiting.containsKey((frame,)):
                spots = [tuple(s) for s in self.waiting.getValue((frame,))[1]] + spots
            else:
                self.handle.registerTimer(ends)
            self.waiting.updateValue((frame,), (ends, spots))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k[0], [tuple(s) for s in v[1]]) for k, v in self.waiting.iterator() if v[0] <= now)
        last, next_track, old, tracks = self.last.get() if self.last.exists() else (None, 0, [], [])
        for frame, spots in ready:
            spots.sort()
            links = self.links([tuple(s) for s in old], spots) if last == frame - 1 else {}
            mine = []
            for s in spots:
                if s[0] in links:
                    mine.append(tracks[links[s[0]]])
                else:
                    mine.append(next_track)
                    next_track += 1
            for s, track in zip(spots, mine, strict=True):
                yield Row(sequence=key[0], frame_id=frame, hotspot_id=s[0], track_id=track)
            last, old, tracks = frame, spots, mine
            self.waiting.removeKey((frame,))
        if ready:
            self.last.update((last, next_track, old, tracks))

    def links(self, old: list[tuple], new: list[tuple]) -> dict[int, int]:
        """Hotspot -> place of its match in `old`: by ascending cost (unknown last), each at most once.

        Hotspots meet by cells of place and score, in bands of cost that are about twice as wide each time: a band's pairs count
        only if the bands before left both ends free. A band is narrowed, to a point, while more than PAIRS of them would meet.
        """
        import numpy as np

        if not old or not new:
            return {}
        a, b = ({c: np.array([s[k] for s in spots], dtype=float) for k, c in ((2, "x"), (3, "y"), (4, "area"), (5, "score"))} for spots in (old, new))
        for side, spots in ((a, old), (b, new)):
            side["id"] = np.array([s[0] for s in spots], dtype=np.int64)
            side["hole"] = np.array([0 if s[1] is None else s[1] for s in spots], dtype=np.int64)
            side["none"] = np.array([s[1] is None for s in spots])
        areas, scores = (np.concatenate([a[c], b[c]]) for c in ("area", "score"))
        least = 0.5 * min(1.0, np.nanmin(areas)) if not np.isnan(areas).all() else 0.5
        apart = np.nanmax(scores) - np.nanmin(scores) if not np.isnan(scores).all() else 0.0
        most = self.reach + 0.5 * self.max_ratio + 0.25 * apart - least + 1e-6
        names = np.unique(b["id"], return_inverse=True)[1]
        used, gone, out = np.zeros(len(old), bool), np.zeros(len(names), bool), {}
        done, width = 0.0, BAND if np.isfinite(most) else math.inf
        while True:
            i, j = np.flatnonzero(~used), np.flatnonzero(~gone[names])
            left, right = ({c: v[at] for c, v in side.items()} for side, at in ((a, i), (b, j)))
            if len(i) * len(j) <= PAIRS or width > most:
                width = math.inf
            met, n = self.meetings(left, right, width)
            while n > PAIRS and math.isfinite(width) and width - done > max(BAND, done) / 8:
                width = (done + width) / 2
                met, n = self.meetings(left, right, width)
            p, q, cost = self.near(left, right, met, least + width)
            p, q = i[p], j[q]
            for k in np.lexsort((b["id"][q], a["id"][p], cost)).tolist():
                if not used[p[k]] and not gone[names[q[k]]]:
                    used[p[k]] = gone[names[q[k]]] = True
                    out[int(b["id"][q[k]])] = int(p[k])
            if not math.isfinite(width):
                return out
            done, width = width, 2 * width

    def meetings(self, a: dict, b: dict, width: float):
        """The orders of `a` and `b` by cell, where in its order each of `b` finds those of `a` in the cells around its own, and how many they are."""
        import numpy as np

        near = min(self.reach, width + 1e-6)
        spans = {"x": near, "y": near} | ({"score": 4 * width + 1e-6} if math.isfinite(width) else {})
        factors = {"x": 73_856_093, "y": 19_349_663, "score": 83_492_791}  # cells that share a number only meet in vain
        with np.errstate(invalid="ignore", over="ignore"):
            cells, asked = (sum(np.floor(side[c] / s).astype(np.int64) * factors[c] for c, s in spans.items()) for side in (a, b))
            orders, found = (np.argsort(cells, kind="stable"), np.argsort(asked, kind="stable")), []
            cells, asked = cells[orders[0]], asked[orders[1]]
            for steps in itertools.product((-1, 0, 1), repeat=len(spans)):
                there = asked + sum(k * factors[c] for k, c in zip(steps, spans, strict=True))
                begin = np.searchsorted(cells, there)
                found.append((begin, np.searchsorted(cells, there, "right") - begin))
        return (*orders, found), sum(int(n.sum()) for _, n in found)

    def near(self, a: dict, b: dict, met, limit: float):
        """Of the pairs that meet those that may be linked and cost less than `limit` (any if it is infinite), compared CHUNK at a time."""
        import numpy as np

        order, turn, found = met
        kept = []
        for begin, n in found:
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                m = n[at:to]
                q = np.repeat(np.arange(at, to), m)
                p = order[np.repeat(begin[at:to], m) + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)]
                q = turn[q]
                fits = a["none"][p] | b["none"][q] | (a["hole"][p] == b["hole"][q])
                p, q = p[fits], q[fits]
                dx, dy = a["x"][p] - b["x"][q], a["y"][p] - b["y"][q]
                away = np.sqrt(dx * dx + dy * dy)
                ratio = np.fmax(a["area"][p], b["area"][q]) / np.fmax(np.fmin(a["area"][p], b["area"][q]), 1.0)
                cost = np.floor((away + 0.5 * ratio + 0.25 * np.abs(a["score"][p] - b["score"][q])) * 1e9 + 0.5) / 1e9
                fits = (away <= self.reach) & (ratio <= self.max_ratio) & ((cost < limit) | (limit == math.inf))
                kept.append((p[fits], q[fits], cost[fits]))
                at = to
        return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def tracked(hotspots: DataFrame, reach: float = 10.0, max_ratio: float = 3.0, late: str = "1 day") -> DataFrame:
    """Track ids carried from frame to frame of each sequence: sequence, frame_id, hotspot_id, track_id (from 0 in each sequence).

    `hotspots` is a stream with sequence, frame_id, ts (any time within the frame), ends (its end, in ms), hotspot_id,
    nearest_hole_id (may be null), x, y, area_px and score. Frames come out once the watermark (`late` behind the latest ts)
    has passed their end, in order; rows later than that are left out. Sequences are spread over tasks; one
    sequence's frames follow each other, so its matching is as serial as the frames are.
    """
    named = hotspots.withWatermark("ts", late).select(
        "sequence", F.col("frame_id").cast("int").alias("frame_id"), "ts", F.col("ends").cast("long").alias("ends"), F.col("hotspot_id").cast("long").alias("hotspot_id"), F.col("nearest_hole_id").cast("long").alias("nearest_hole_id"),
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area_px", "score")],
    )
    return named.groupBy("sequence").transformWithState(Tracker(reach, max_ratio), "sequence string, frame_id int, hotspot_id bigint, track_id bigint", "Append", "EventTime")


def added(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of `value` by `keys` within each task, before a stream's rows are dealt to their state: fewer rows meet under a key."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(keys).aggregate([(value, "sum")]).select([*keys, f"{value}_sum"]).rename_columns([*keys, value]).to_batches()

    return rows.select(*keys, value).mapInArrow(run, rows.select(*keys, value).schema)


class Histograms(StatefulProcessor):
    """Grey histograms of a sequence's frames and the jump from each frame to the next one, revised when a frame gets more pixels.

    State: each frame's counts by bin, and how often it was told. Frames more than `keep` before the latest are dropped from
    the state (none if it is null), and rows for them are left out.
    """

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "frame_id int", "revision int, bins array<int>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: dict[int, dict[int, int]] = {}
        for r in rows:
            of = fresh.setdefault(r.frame_id, {})
            of[r.bin] = of.get(r.bin, 0) + r.n
        known = sorted(k[0] for k in self.frames.keys())
        oldest = max([*known, *fresh]) - self.keep if self.keep is not None else None
        fresh = {f: b for f, b in fresh.items() if oldest is None or f >= oldest}
        for frame, bins in fresh.items():
            if self.frames.containsKey((frame,)):
                _, old, counts = self.frames.getValue((frame,))
                for b, n in zip(old, counts, strict=True):
                    bins[b] = bins.get(b, 0) + n
                revision = self.frames.getValue((frame,))[0]
            else:
                revision = 0
            self.frames.updateValue((frame,), (revision, list(bins), list(bins.values())))
        order = sorted({*known, *fresh})
        for before, frame in zip([None, *order], order, strict=False):
            if frame in fresh or before in fresh:
                revision, bins, counts = self.frames.getValue((frame,))
                self.frames.updateValue((frame,), (revision + 1, list(bins), list(counts)))
                now = dict(zip(bins, counts, strict=True))
                jump = None if before is None else self.distance(now, dict(zip(*self.frames.getValue((before,))[1:], strict=True)))
                yield Row(sequence=key[0], frame_id=frame, revision=revision + 1, jump=jump)
        for frame in order:
            if oldest is not None and frame < oldest:
                self.frames.removeKey((frame,))

    def distance(self, a: dict[int, int], b: dict[int, int]) -> float:
        """Between the histograms, each scaled to unit length."""
        size = lambda h: math.sqrt(sum(n * n for n in h.values()))
        dot = sum(n / size(a) * (b[k] / size(b)) for k, n in a.items() if k in b)
        return math.sqrt(max(2 - 2 * dot, 0.0))


def histogram_jumps(pixels: DataFrame, bins: int = 64, keep: int | None = None) -> DataFrame:
    """Jumps between consecutive frames of a stream of pixels (sequence, frame_id, r, g, b), in whatever order they come.

    A frame is told anew, with a higher revision, when it or the frame before gets more pixels; `latest` has the last word.
    """
    grey = F.expr(f"CAST((CAST((299 * r + 587 * g + 114 * b) div 1000 AS INT)) * {bins} div 256 AS INT)").alias("bin")
    counts = added(pixels.select("sequence", F.col("frame_id").cast("int").alias("frame_id"), grey, F.lit(1).cast("long").alias("n")), ["sequence", "frame_id", "bin"], "n")
    return counts.groupBy("sequence").transformWithState(Histograms(keep), "sequence string, frame_id int, revision int, jump double", "Append", "None")


class Baselines(StatefulProcessor):
    """Sums of a cell's values by frame, and each frame's change against the cell's first frame; all frames are told anew when
    an earlier one comes late or the first one gets more rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value for all frames: each access to the state is a call from Python to the JVM
        self.frames = handle.getValueState("frames", "frame_ids array<int>, revisions array<int>, totals array<bigint>, ns array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.frames.get()
        known = {f: (r, t, n) for f, r, t, n in zip(*state, strict=True)} if state else {}
        first, touched = min(known, default=None), set()
        for r in rows:
            revision, total, n = known.get(r.frame_id, (0, 0, 0))
            known[r.frame_id] = (revision, total + r.total, n + r.n)
            touched.add(r.frame_id)
        base = min(known)
        told = sorted(known if base != first or base in touched else touched)
        for frame in told:
            revision, total, n = known[frame]
            known[frame] = (revision + 1, total, n)
        self.frames.update((list(known), *(list(c) for c in zip(*known.values(), strict=True))))
        value = lambda f: known[f][1] / (100 * known[f][2])
        for frame in told:
            yield Row(hole_id=key[0], annulus_id=key[1], frame_id=frame, revision=known[frame][0], baseline_frame_id=base, descriptor_value=value(frame), baseline_descriptor_value=value(base), delta_descriptor_value=value(frame) - value(base))


def first_frame_deltas(rows: DataFrame) -> DataFrame:
    """Change of each (hole, annulus, frame) against the cell's first frame, from a stream of measures (hole_id, annulus_id, frame_id,
    cents) in whatever order they come; a frame's value is the mean of its cents / 100. Null cents are left out.

    A frame is told anew, with a higher revision, when its value or the baseline changes; `latest` has the last word. A cell's
    state has two numbers for each of its frames.
    """
    keys = ["hole_id", "annulus_id", "frame_id"]
    sums = rows.where("cents IS NOT NULL").select(*[F.col(k).cast("int").alias(k) for k in keys], F.col("cents").cast("long").alias("total"), F.lit(1).cast("long").alias("n"))
    schema = "hole_id int, annulus_id int, frame_id int, revision int, baseline_frame_id int, descriptor_value double, baseline_descriptor_value double, delta_descriptor_value double"
    return sums.groupBy("hole_id", "annulus_id").transformWithState(Baselines(), schema, "Append", "None")


def latest(told: DataFrame, keys: list[str]) -> DataFrame:
    """The last revision of each key."""
    rest = [c for c in told.columns if c not in keys]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest if c != "revision"])
