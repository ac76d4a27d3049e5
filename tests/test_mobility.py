import math
import random
from datetime import datetime, timedelta

import numpy as np

from lumenlake.operators.mobility import _candidates, _circle, _hull, low_movability, stops_and_trips, stops_of, valid_pings

_T0 = datetime(2024, 5, 1, 8)
_PHOTO = "id long, device_id long, capture_at timestamp_ntz, capture_source string, latitude double, longitude double, stretch string, pings int"


def _at(north_m: float, east_m: float, lat0: float = 47.0, lon0: float = 8.0) -> tuple[float, float]:
    return lat0 + math.degrees(north_m / 6371008.8), lon0 + math.degrees(east_m / (6371008.8 * math.cos(math.radians(lat0))))


def _frame(spark, pings):
    return spark.createDataFrame([(i, d, None if m is None else _T0 + timedelta(minutes=m), s, la, lo, "", 0) for i, d, m, s, la, lo in pings], _PHOTO)


def _found(df):
    return sorted((r.kind, r.device_id, r.first_photo_id, r.last_photo_id) for r in df.collect())


def test_stop_trip_stop(spark):
    a, b = (0.0, 0.0), (20_000.0, 0.0)
    pings, i = [], 0
    for place, start in ((a, 0), (b, 90)):
        for k in range(4):
            i += 1
            pings.append((i, 1, start + 12 * k, "exif", *_at(place[0] + 40 * k, place[1])))
    pings.append((50, 1, 60, "exif", *_at(9000, 0)))
    got = stops_and_trips(_frame(spark, pings))
    assert _found(got) == [("stop", 1, 1, 4), ("stop", 1, 5, 8), ("trip", 1, 4, 5)]
    trip = got.filter("kind = 'trip'").first()
    assert trip.duration_s == 54 * 60 and abs(trip.distance_m - 20_000) < 50 and trip.path_m >= trip.distance_m - 200


def test_wrong_positions_and_silences(spark):
    here, far = _at(0, 0), _at(80_000, 5_000)
    short = [(1, 1, 0, "exif", *here), (2, 1, 15, "exif", *here), (3, 1, 18, "exif", *far), (4, 1, 22, "exif", *here), (5, 1, 40, "exif", *here)]
    assert _found(stops_and_trips(_frame(spark, short))) == [("stop", 1, 1, 5)]
    long = [(1, 1, 0, "exif", *here), (2, 1, 15, "exif", *here), (3, 1, 31, "exif", *here), (4, 1, 35, "exif", *far), (5, 1, 42, "exif", *here), (6, 1, 60, "exif", *here), (7, 1, 80, "exif", *here)]
    assert _found(stops_and_trips(_frame(spark, long))) == [("stop", 1, 1, 3), ("stop", 1, 5, 7), ("trip", 1, 3, 5)]
    night = [(i, 1, m, "exif", *here) for i, m in enumerate((0, 20, 40, 40 + 481, 550, 580), 1)]
    assert _found(stops_and_trips(_frame(spark, night))) == [("stop", 1, 1, 3), ("stop", 1, 4, 6)]
    nap = [(i, 1, m, "exif", *here) for i, m in enumerate((0, 20, 40, 40 + 480, 550, 580), 1)]
    assert _found(stops_and_trips(_frame(spark, nap))) == [("stop", 1, 1, 6)]


def test_what_is_no_ping(spark):
    here = _at(0, 0)
    rows = [(1, 1, 0, "exif", *here), (2, 1, 20, "exif", *here), (9, 1, 20, "exif", *_at(5000, 0)), (3, 1, 40, "filename", *here), (4, 1, 50, "mtime", *here), (5, None, 55, "exif", *here), (6, 1, None, "exif", *here),
            (7, 1, 60, "exif", float("nan"), 8.0), (8, 1, 61, "exif", 91.0, 8.0), (10, 1, 62, "exif", None, 8.0), (11, 1, 63, None, *here)]
    assert _found(stops_and_trips(_frame(spark, rows))) == [("stop", 1, 1, 3)]
    assert stops_and_trips(_frame(spark, [])).count() == 0


def test_across_the_date_line_and_the_pole(spark):
    line = [(i, 1, 20 * i, "exif", 10.0, lon) for i, lon in enumerate((179.9995, -179.9995, 179.9999, -179.9999))]
    pole = [(10 + i, 2, 20 * i, "exif", 89.9995, lon) for i, lon in enumerate((0.0, 90.0, 180.0, -90.0))]
    got = _found(stops_and_trips(_frame(spark, line + pole)))
    assert ("stop", 1, 0, 3) in got


def _brute(pings, radius=300.0, patience=600e6, least_us=1800e6):
    """Longest run from each start by trying every ping, then the largest runs first."""
    lat0, lon0 = pings[0][1], pings[0][2]
    xy = [(math.radians(p[2] - lon0) * math.cos(math.radians(lat0)) * 6371008.8, math.radians(p[1] - lat0) * 6371008.8) for p in pings]

    def run(i, end):
        got = [i]
        for j in range(i + 1, end):
            if j > got[-1] + 1 and pings[j][0] - pings[got[-1]][0] >= patience:
                break
            if _circle(_hull([xy[k] for k in [*got, j]]))[2] <= radius:
                got.append(j)
        return got

    def search(lo, hi):
        runs = [r for i in range(lo, hi) if len(r := run(i, hi)) >= 3 and pings[r[-1]][0] - pings[r[0]][0] >= least_us]
        if not runs:
            return []
        first = min(runs, key=lambda r: r[0])
        near = [r for r in runs if r[0] <= first[-1]]
        best = max(near, key=lambda r: (len(r), pings[r[-1]][0] - pings[r[0]][0], -r[0]))
        return search(lo, best[0]) + [(best[0], best[-1])] + search(best[-1] + 1, hi)

    return search(0, len(pings))


def test_detector_against_brute_force():
    rng = random.Random(11)
    same = 0
    for _ in range(120):
        t, place, pings = 0, (0.0, 0.0), []
        for _ in range(rng.randint(3, 45)):
            t += rng.choice([60, 180, 420, 900, 1500]) * 1_000_000
            if rng.random() < 0.15:
                place = (place[0] + rng.uniform(-4000, 4000), place[1] + rng.uniform(-4000, 4000))
            off = (30_000.0, 0.0) if rng.random() < 0.08 else (rng.gauss(0, 60), rng.gauss(0, 60))
            pings.append((t, *_at(place[0] + off[0], place[1] + off[1])))
        got = [(r.at, r.last) for r in stops_of(*map(np.array, zip(*pings, strict=True)))]
        want = _brute(pings)
        same += got == want
        # every stop keeps the rule, whatever the choice among overlapping runs
        for a, z in got:
            assert pings[z][0] - pings[a][0] >= 1800e6
    assert same >= 116


def test_hot_device_is_cut_into_partitions(spark):
    pings = [(i, 1, 4 * i, "exif", *_at(0 if (i // 40) % 2 else 9000, (i % 5) * 20)) for i in range(4000)]
    got = stops_and_trips(_frame(spark, pings))
    assert got.filter("kind = 'stop'").count() == 100 and got.filter("kind = 'trip'").count() == 99


def _line(rng, n):
    """Pings of one device with stops, journeys and wrong positions, as arrays."""
    t, place, rows = 0, (0.0, 0.0), []
    while len(rows) < n:
        if rng.random() < 0.4:  # under way
            for _ in range(rng.randint(3, 30)):
                place = (place[0] + rng.uniform(500, 1500), place[1] + rng.uniform(-200, 200))
                t += rng.choice([60, 120]) * 1_000_000
                rows.append((t, *_at(*place)))
        for _ in range(rng.randint(3, 25)):
            t += rng.choice([60, 180, 420, 900]) * 1_000_000
            off = (40_000.0, 0.0) if rng.random() < 0.08 else (rng.gauss(0, 60), rng.gauss(0, 60))
            rows.append((t, *_at(place[0] + off[0], place[1] + off[1])))
    return tuple(map(np.array, zip(*rows, strict=True)))


def test_windows_reject_journeys_and_keep_stops():
    rng, rejected, all_pings = random.Random(5), 0, 0
    for _ in range(20):
        t, la, lo = _line(rng, 300)
        step = np.r_[0.0, [math.hypot(*d) for d in zip(np.diff(la) * 111_195, np.diff(lo) * 75_800, strict=True)]]
        # two days of silence around, so that no window leaves the rows
        t2, la2, lo2 = np.r_[t[0] - 10**11, t, t[-1] + 10**11], np.r_[0.0, la, 0.0], np.r_[0.0, lo, 0.0]
        line = np.r_[0, np.ones(len(t), dtype=int), 2]
        low = low_movability(t2, line, la2, lo2, np.r_[0.0, np.cumsum(step), 0.0], 900 * 10**6, 600 * 10**6, 300.0)[1:-1]
        rejected, all_pings = rejected + int((~low).sum()), all_pings + len(low)
        keep = np.flatnonzero(low)
        whole = [(r.at, r.last) for r in stops_of(t, la, lo)]
        assert [(int(keep[r.at]), int(keep[r.last])) for r in stops_of(t[keep], la[keep], lo[keep], keep)] == whole
    assert 0.1 * all_pings < rejected < 0.9 * all_pings


def test_a_year_of_minutes_is_many_stretches(spark):
    """One device that pings each minute and never rests eight hours: home, way, work, way, each day."""
    minutes = 60 * 24 * 60
    day = "pmod(id, 1440)"
    north = f"case when {day} < 420 then 0 when {day} < 480 then ({day} - 420) * 400 when {day} < 1000 then 24000 when {day} < 1060 then (1060 - {day}) * 400 else 0 end"
    frame = spark.range(minutes).selectExpr("id", "1L AS device_id", "timestampadd(MINUTE, CAST(id AS INT), timestamp_ntz'2024-01-01') AS capture_at", "'exif' AS capture_source",
                                            f"47 + ({north} + pmod(id * 37, 50)) / 111195.0 AS latitude", "8.0 AS longitude")
    got = stops_and_trips(frame)
    assert got.filter("kind = 'stop'").count() == 121 and got.filter("kind = 'trip'").count() == 120
    parts = _candidates(valid_pings(frame), 300.0, 600.0, 1800.0, 8 * 3600.0, 300.0).groupBy("stretch").count().collect()
    assert len(parts) >= 100 and max(r["count"] for r in parts) < 3000


def test_paths_leave_wrong_positions_out(spark):
    pings = [(i, 1, 4 * i, "exif", *(_at(400_000, 0) if i % 4 == 2 else _at(10 * (i % 3), 0))) for i in range(40)]
    pings += [(100 + i, 1, 300 + 10 * i, "exif", *(_at(900_000, 0) if i == 2 else _at(5000.0 * i, 0))) for i in range(6)]
    pings += [(200 + i, 1, 400 + 15 * i, "exif", *_at(30_000, 10 * i)) for i in range(5)]
    rows = {(r.kind, r.first_photo_id): r for r in stops_and_trips(_frame(spark, pings)).collect()}
    stop, trip = rows["stop", 0], rows["trip", 100]
    assert stop.last_photo_id == 100 and stop.path_m <= (stop.pings - 1) * 600 and stop.path_m < 1000
    assert 29_000 < trip.distance_m <= trip.path_m < 32_000
