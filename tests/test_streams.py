"""Links and tracks on literal rows, and the streams with keyed state: parts out of order, late rows, restarts."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ringframe.operators import hotspots, reshape
from ringframe.streaming import stateful

@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition of keyed state starts a Python worker for every file."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    yield
    spark.conf.set(name, before)


SPOTS = "frame_id int, hotspot_id long, nearest_hole_id long, x double, y double, area_px double, score double"


def walked(rows, reach, ratio, reaches=None):
    """The greedy walk over all pairs of consecutive frames."""
    out = []
    for frame in sorted({r[0] for r in rows}):
        costs = []
        for a, b in itertools.product([r for r in rows if r[0] == frame - 1], [r for r in rows if r[0] == frame]):
            d = ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5
            q = max(a[5], b[5]) / max(min(a[5], b[5]), 1)
            if d <= min(reach, (reaches or {}).get(frame, reach)) and q <= ratio and (a[2] is None or b[2] is None or a[2] == b[2]):
                costs.append((round(d + 0.5 * q + 0.25 * abs(a[6] - b[6]), 9), a[1], b[1]))
        used, gone = set(), set()
        for _, p, h in sorted(costs):
            if p not in used and h not in gone:
                used.add(p)
                gone.add(h)
                out.append((frame, p, h))
    return sorted(out)


def spots(seed, n=120, frames=6):
    rng = random.Random(seed)
    return [(rng.randrange(frames), i, rng.choice([None, 1, 2]), rng.randrange(40) / 2, rng.randrange(40) / 2, rng.choice([0.0, 0.5, 1.0, 2.0, 5.0]), rng.randrange(3) / 1.0) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_links(spark, seed):
    rows = spots(seed)
    got = hotspots.link_greedy(spark.createDataFrame(rows, SPOTS), 6.0, 3.0).collect()
    assert sorted((r.frame_id, r.prev_hotspot_id, r.hotspot_id) for r in got) == walked(rows, 6.0, 3.0)
    reaches = {1: 1.0, 3: 4.0}
    got = hotspots.link_greedy(spark.createDataFrame(rows, SPOTS), 6.0, 3.0, spark.createDataFrame(list(reaches.items()), "frame_id int, reach double")).collect()
    assert sorted((r.frame_id, r.prev_hotspot_id, r.hotspot_id) for r in got) == walked(rows, 6.0, 3.0, reaches)


def test_links_of_chains_and_ties(spark):
    """Each pair waits for the one before it, and equal costs go by ids."""
    chain = [(i % 2, i, None, i * (i + 41) / 20.0, 0.0, 1.0, 0.0) for i in range(16)]
    got = hotspots.link_greedy(spark.createDataFrame(chain, SPOTS), 10.0).collect()
    assert sorted((r.frame_id, r.prev_hotspot_id, r.hotspot_id) for r in got) == walked(chain, 10.0, 3.0)
    same = [(f, 10 * f + i, None, 1.0, 1.0, 1.0, 0.0) for f in range(2) for i in range(4)]
    got = hotspots.link_greedy(spark.createDataFrame(same, SPOTS)).collect()
    assert sorted((r.prev_hotspot_id, r.hotspot_id) for r in got) == [(i, 10 + i) for i in range(4)]
    assert hotspots.link_greedy(spark.createDataFrame([], SPOTS)).count() == 0


@pytest.mark.parametrize(("least_area", "limit"), [(-1.0, 500), (1.0, 0)])
def test_links_by_bands(spark, monkeypatch, least_area, limit):
    """Costs searched by bands give the same walk, with holes met by bands or at once."""
    rng = random.Random(5)
    rows = [(*r[:5], rng.choice([least_area, 1.5, 2.0]), rng.choice([0.0, 0.1, 3.0])) for r in spots(4, 90, 4)]
    want = walked(rows, 6.0, 3.0, {2: 2.5})
    reaches = spark.createDataFrame([(2, 2.5)], "frame_id int, reach double")
    monkeypatch.setattr(hotspots, "PAIRS_AT_ONCE", limit)
    monkeypatch.setattr(hotspots, "BAND", 2.0)
    got = hotspots.link_greedy(spark.createDataFrame(rows, SPOTS), 6.0, 3.0, reaches).collect()
    assert sorted((r.frame_id, r.prev_hotspot_id, r.hotspot_id) for r in got) == want


@pytest.mark.parametrize("limit", [0, 20_000_000])
def test_nearest_regions_by_places(spark, monkeypatch, limit):
    """Regions of one place are met once, whatever the number of cells it takes; ties go to the least id."""
    written, keep = [], hotspots.Scratch.keep

    def counted(self, label, df):
        out = keep(self, label, df)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(hotspots.Scratch, "keep", counted)
    monkeypatch.setattr(hotspots, "PAIRS_AT_ONCE", limit)
    rng = random.Random(3)
    rows = [(i % 3, i, *((rng.randrange(30) / 4, rng.randrange(30) / 4) if i < 600 else (rng.randrange(400) / 1.0, 50.0))) for i in range(660)]
    rows += [(1, 1000 + i, 7.0, -4.0) for i in range(200)] + [(0, 2000 + i, 0.0, 0.0) for i in range(200)] + [(0, 3000, 8.0, -3.0), (0, 2999, 8.0, -5.0), (1, 9000, None, 1.0), rows[5]]
    got = hotspots.link_nearest(spark.createDataFrame(rows, "frame_id int, region_id long, x double, y double"), 12.0).collect()
    want = {}
    for f, i, x, y in rows:
        near = [(((x - c) ** 2 + (y - d) ** 2) ** 0.5, p) for g, p, c, d in rows if x is not None and c is not None and g == f - 1]
        d, p = min((n for n in near if n[0] < 12.0), default=(None, None))
        want[f, i] = (p, d)
    assert len(got) == len(want) and {(r.frame_id, r.region_id): (r.prev_region_id, r.distance) for r in got} == want
    assert any(label.startswith("within") for label, _ in written) == (limit == 0) and max(n for _, n in written) < 700  # places, of 1,063 regions


def test_links_without_scores_come_last(spark):
    blank = [(0, 1, 1, 0.0, 0.0, 1.0, None), (1, 2, 1, 0.0, 0.0, 1.0, 1.0), (0, 3, 1, 0.0, 0.0, 1.0, 9.0), (1, 4, None, None, 0.0, 1.0, 1.0), (1, 5, 1, 3.0, 0.0, 1.0, float("nan"))]
    got = hotspots.link_greedy(spark.createDataFrame(blank, SPOTS)).collect()
    assert sorted((r.prev_hotspot_id, r.hotspot_id, r.cost) for r in got) == [(1, 5, None), (3, 2, 2.5)]


def test_links_write_few_pairs(spark, monkeypatch):
    """Frames of hotspots that may all be linked with each other don't have all their pairs written."""
    written = []
    keep = hotspots.Scratch.keep

    def counted(self, label, df):
        out = keep(self, label, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(hotspots.Scratch, "keep", counted)
    monkeypatch.setattr(hotspots, "PAIRS_AT_ONCE", 1000)
    monkeypatch.setattr(hotspots, "BAND", 1.0)
    rng = random.Random(1)
    rows = [(i % 2, i, None, rng.random() * 18, rng.random() * 18, 1.0, rng.random() * 20) for i in range(800)]
    got = hotspots.link_greedy(spark.createDataFrame(rows, SPOTS), 18.0).collect()
    assert sorted((r.frame_id, r.prev_hotspot_id, r.hotspot_id) for r in got) == walked(rows, 18.0, 3.0)
    assert max(written) < 12_000  # of about 130,000


def test_areas_count_one_at_least(spark):
    near = [(0, 1, None, 0.0, 0.0, 0.1, 0.0), (1, 2, None, 0.0, 0.0, 2.9, 0.0)]
    assert hotspots.link_greedy(spark.createDataFrame(near, SPOTS)).count() == 1
    far = [(0, 1, None, 0.0, 0.0, 0.1, 0.0), (1, 2, None, 0.0, 0.0, 3.1, 0.0)]
    assert hotspots.link_greedy(spark.createDataFrame(far, SPOTS)).count() == 0


def test_frame_reach(spark):
    holes = spark.createDataFrame([(1, 4.0), (1, 6.0), (2, 100.0), (3, 20.0)], "frame_id int, radius_outer_px double")
    assert {r.frame_id: r.reach for r in hotspots.frame_reach(holes).collect()} == {1: 6.0, 2: 18.0, 3: 15.0}


def numbered(rows, links):
    track, number = {}, 0
    before = {(f, h): p for f, p, h in links}
    for f, h in sorted((r[0], r[1]) for r in rows):
        if (f, h) in before:
            track[f, h] = track[f - 1, before[f, h]]
        else:
            track[f, h], number = number, number + 1
    return track


def test_track_ids(spark):
    rows = spots(7, 200, 20)
    df = spark.createDataFrame(rows, SPOTS)
    got = hotspots.track_ids(df, hotspots.link_greedy(df, 6.0)).collect()
    assert {(r.frame_id, r.hotspot_id): r.track_id for r in got} == numbered(rows, walked(rows, 6.0, 3.0)) and len(got) == len(rows)
    assert hotspots.track_ids(df.limit(0), hotspots.link_greedy(df.limit(0))).count() == 0


def test_ordered_places(spark):
    rows = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(200)], "k int, v string").repartition(7)
    got = sorted((r.place, r.k, r.v) for r in reshape.ordered_places(rows, ["k", "v"], "place").collect())
    assert [(k, v) for _, k, v in got] == sorted((i * 7 % 50, str(i)) for i in range(200)) and [p for p, _, _ in got] == list(range(200))


STREAM = "sequence string, ts timestamp, frame_id int, ends long, hotspot_id long, nearest_hole_id long, x double, y double, area_px double, score double"
DAY = 86_400


def timed(spark, rows):
    """A frame is a day; sequences a and b."""
    made = [("ab"[r[1] % 2], r[0] * DAY + r[1], r[0], (r[0] + 1) * DAY * 1000, *r[1:]) for r in rows]
    return spark.createDataFrame(made, STREAM.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))


def wanted(rows, last):
    out = {}
    for s in (0, 1):
        own = [r for r in rows if r[1] % 2 == s and r[0] <= last]
        out |= {("ab"[s], f, h): t for (f, h), t in numbered(own, walked(own, 6.0, 3.0)).items()}
    return out


def read(spark, folder):
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(folder)


def test_tracks_over_restarts_and_late_rows(spark, tmp_path):
    rows = [(r[0] + 1, *r[1:]) for r in spots(11, 160, 10)]
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    part = F.expr("(frame_id + hotspot_id % 2) div 3")  # rows of a frame come in two files
    full = timed(spark, rows)
    stateful.dealt(full.where(part < 2), part, folder)
    stateful.run_stream(stateful.tracked(read(spark, folder), 6.0, 3.0, "2 days"), base)
    once = spark.read.parquet(f"{base}/rows").count()
    assert once
    # the run goes on from its state; a row of a settled frame comes too late
    stateful.dealt(full.where(part >= 2), part, folder)
    late = timed(spark, [(1, 999, None, 1.0, 1.0, 1.0, 0.0)])
    late.coalesce(1).write.mode("append").parquet(folder)
    stateful.run_stream(stateful.tracked(read(spark, folder), 6.0, 3.0, "2 days"), base)
    got = spark.read.parquet(f"{base}/rows").collect()
    assert len(got) > once
    last = max(r.frame_id for r in got)
    assert last >= 7 and {(r.sequence, r.frame_id, r.hotspot_id): r.track_id for r in got} == wanted(rows, last) and len(got) == len({(r.sequence, r.frame_id, r.hotspot_id) for r in got})


@pytest.mark.parametrize("most", [50, 500, 8_000_000])
def test_matches_of_a_stream_by_bands(monkeypatch, most):
    """Whatever number of pairs is compared at a time, the matches are the walk's; unknown places never match, unknown scores last."""
    monkeypatch.setattr(stateful, "PAIRS", most)
    monkeypatch.setattr(stateful, "CHUNK", min(most, 100))
    for seed in range(4):
        rows = [r for r in spots(seed, 150, 2)]
        old, new = ([tuple(r[1:]) for r in rows if r[0] == f] for f in (0, 1))
        links = stateful.Tracker(6.0, 3.0).links(old, new)
        assert sorted((1, old[i][0], h) for h, i in links.items()) == walked(rows, 6.0, 3.0)
    old = [(1, 1, 0.0, 0.0, 1.0, None), (3, 1, 0.0, 0.0, 1.0, 9.0), (6, None, None, 0.0, 1.0, 1.0)]
    new = [(2, 1, 0.0, 0.0, 1.0, 1.0), (4, None, math.nan, 0.0, 1.0, 1.0), (5, 1, 3.0, 0.0, 1.0, math.nan)]
    assert stateful.Tracker(10.0, 3.0).links(old, new) == {2: 1, 5: 0}


def test_matches_of_dense_frames_are_quick():
    """Two frames of 20,000 hotspots that could nearly all be linked with each other (a loop over their pairs takes minutes)."""
    rng = random.Random(9)
    old, new = ([(k + f, None, rng.random() * 40, rng.random() * 40, 1.0, rng.random() * 50) for k in range(0, 40_000, 2)] for f in (0, 1))
    began = time.monotonic()
    assert len(stateful.Tracker(18.0, 3.0).links(old, new)) > 19_000
    assert time.monotonic() - began < 60


def test_a_missing_frame_ends_tracks(spark, tmp_path):
    rows = [(f, f, None, 1.0, 1.0, 1.0, 0.0) for f in (2, 4, 8)] + [(12, 12, None, 1.0, 1.0, 1.0, 0.0)]
    rows = [(f, 2 * h, *rest) for f, h, *rest in rows]  # one sequence
    stateful.dealt(timed(spark, rows), F.lit(0), str(tmp_path / "in"))
    got = stateful.to_table(stateful.tracked(read(spark, str(tmp_path / "in")), 6.0), "t").collect()
    assert {(r.frame_id, r.track_id) for r in got} == {(2, 0), (4, 1), (8, 2)}


def test_baselines_correct_themselves(spark, tmp_path):
    schema = "hole_id int, annulus_id int, frame_id int, cents long"
    folder = str(tmp_path / "in")
    files = [[(1, 0, 5, 300), (1, 0, 6, 400), (2, 0, 1, 100)], [(1, 0, 3, 100)], [(1, 0, 3, 300), (1, 0, 7, 900)], [(2, 0, 2, None), (2, 0, 3, 150)]]
    for k, rows in enumerate(files):
        stateful.dealt(spark.createDataFrame(rows, schema), F.lit(k), folder)
    told = stateful.to_table(stateful.first_frame_deltas(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), "b")
    got = {(r.hole_id, r.frame_id): (r.baseline_frame_id, r.delta_descriptor_value) for r in stateful.latest(told, ["hole_id", "annulus_id", "frame_id"]).collect()}
    assert got == {(1, 3): (3, 0.0), (1, 5): (3, 1.0), (1, 6): (3, 2.0), (1, 7): (3, 7.0), (2, 1): (1, 0.0), (2, 3): (1, 0.5)}
    assert told.where("hole_id = 1 AND frame_id = 5").count() == 3  # first, after the earlier frame, after that frame's second row


def test_baselines_ask_the_state_twice_a_batch():
    """However many frames a cell has, its state is read once and written once for all rows of a batch."""
    calls, held = [], []

    class Value:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    baselines = stateful.Baselines()
    baselines.init(Handle())
    row = lambda f, total: Row(frame_id=f, total=total, n=1)
    assert len(list(baselines.handleInputRows((1, 2), iter([row(f, 100 * f) for f in range(5, 30)]), None))) == 25
    out = list(baselines.handleInputRows((1, 2), iter([row(4, 300), row(29, 100)]), None))
    assert calls == ["get", "update"] * 2 and len(out) == 26 and [(r.revision, r.baseline_frame_id) for r in out] == [(1, 4)] + [(2, 4)] * 25
    assert out[-1].descriptor_value == 15.0 and out[-1].delta_descriptor_value == 12.0


def test_jumps_in_any_order(spark, tmp_path):
    schema = "sequence string, frame_id int, r int, g int, b int"
    rng = random.Random(2)
    rows = [(s, f, *(rng.randrange(256) for _ in "rgb")) for s in "ab" for f in range(6) for _ in range(30)]
    folder = str(tmp_path / "in")
    for k, f in enumerate([3, 0, 5, 1, 4, 2]):
        stateful.dealt(spark.createDataFrame([r for i, r in enumerate(rows) if (r[1] + i) % 6 == f], schema), F.lit(k), folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r.sequence, r.frame_id): r.jump for r in stateful.latest(stateful.to_table(stateful.histogram_jumps(stream, 16), "h"), ["sequence", "frame_id"]).collect()}

    def unit(s, f):
        h = [0] * 16
        for _, _, r, g, b in (x for x in rows if x[:2] == (s, f)):
            h[(299 * r + 587 * g + 114 * b) // 1000 * 16 // 256] += 1
        size = sum(n * n for n in h) ** 0.5
        return [n / size for n in h]

    for s, f in itertools.product("ab", range(6)):
        want = None if f == 0 else max(0.0, 2 - 2 * sum(x * y for x, y in zip(unit(s, f), unit(s, f - 1), strict=True))) ** 0.5
        assert got[s, f] == (want if want is None else pytest.approx(want))
    # frames far behind the latest are dropped from the state, and their rows left out
    kept = stateful.latest(stateful.to_table(stateful.histogram_jumps(spark.readStream.schema(schema).parquet(folder), 16, 2), "h"), ["sequence", "frame_id"])
    assert {r.frame_id for r in kept.collect()} == {3, 4, 5}
