"""Stops and trips from location pings.

Pings are sorted globally by device and time, so a device of any size is spread over
many tasks. Sliding windows compare net displacement with travelled path length: a ping
that neither begins nor ends a window of low movability is under way and drops out. What
is left falls apart, wherever no stop can reach across, into stretches of merged windows;
in these, runs of bounded extent are grown and checked against the exact rule. Trips are
what lies between successive stops.

Jumps faster than anything travels are wrong positions: they add nothing to a path, and
a single ping that is off is bridged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.geo import haversine_m
from lumenlake.functions.scalars import wall_micros, wall_time
from lumenlake.operators.ordering import PID, ordered_scan, range_sorted
from lumenlake.shared import checkpointed, materialize

_EARTH_M = 6371008.8
_MICROS = 1_000_000
_PING = ("device_id", "t_us", "latitude", "longitude")
#: Rows whose windows are measured together; a window that leaves them counts as low.
_BLOCK = 100_000


def _metres(la: np.ndarray, lo: np.ndarray, lb: np.ndarray, lob: np.ndarray) -> np.ndarray:
    la, lo, lb, lob = (np.radians(x) for x in (la, lo, lb, lob))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lob - lo) / 2) ** 2
    return 2 * _EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def low_movability(t: np.ndarray, line: np.ndarray, la: np.ndarray, lo: np.ndarray, path: np.ndarray, window_us: int, patience_us: int, radius: float, most: float = 0.5) -> np.ndarray:
    """Whether each ping begins or ends a window of low movability.

    ``line`` numbers the voyages, ``path`` runs along each. A window from a ping ends at the
    first ping ``window_us`` later, or at any other less than ``patience_us`` after that, so that one
    wrong position doesn't hide it. Its movability is net displacement over travelled
    path, the path counting at least the circumscribed back and forth of a stop (4 radii). Ends
    of one stop are at most 2 radii apart, so with ``most`` of 0.5 no ping of a stop of twice
    ``window_us`` is lost: each has half of the stop before or behind it. Windows that reach beyond the
    given rows are taken for low.
    """
    n = len(t)
    begins = np.r_[True, line[1:] != line[:-1]]
    apart = np.where(begins, window_us + patience_us + 1, np.diff(t, prepend=t[0]))
    clock = np.cumsum(apart)
    # planar and spherical distances differ by less than 2 % below 89.5 degrees
    at, least = np.radians(la), 4 * radius * 1.02
    turn = np.radians(lo)
    xyz = _EARTH_M * np.stack([np.cos(at) * np.cos(turn), np.cos(at) * np.sin(turn), np.sin(at)])

    def ahead(clock: np.ndarray, line: np.ndarray, xyz: np.ndarray, path: np.ndarray) -> np.ndarray:
        first = np.searchsorted(clock, clock + window_us, "left")
        last = np.maximum(first, np.searchsorted(clock, clock + window_us + patience_us, "left") - 1)
        ends = np.searchsorted(np.cumsum(np.r_[False, line[1:] != line[:-1]]), np.cumsum(np.r_[False, line[1:] != line[:-1]]), "right") - 1
        low = (ends == n - 1) & (last >= n - 1)
        last = np.minimum(last, ends)
        open_ = np.flatnonzero(~low & (first <= last))
        j = first[open_]
        while len(open_):
            net = np.sqrt(((xyz[:, open_] - xyz[:, j]) ** 2).sum(0))
            is_low = net <= most * np.maximum(np.abs(path[j] - path[open_]), least)
            low[open_[is_low]] = True
            stay = ~is_low & (j < last[open_])
            open_, j = open_[stay], j[stay] + 1
        return low

    low = ahead(clock, line, xyz, path) | ahead(-clock[::-1], line[::-1], xyz[:, ::-1], path[::-1])[::-1]
    return low | (np.abs(la) > 89.5)


class _Line:
    """Scan along the sorted pings: numbers voyages (from silence to silence), sums up their paths, keeps pings of low movability."""

    def __init__(self, radius: float, patience_s: float, silence_s: float, window_s: float, most_speed: float):
        self.radius, self.speed = radius, most_speed / _MICROS
        self.patience, self.silence, self.window = int(patience_s * _MICROS), int(silence_s * _MICROS), int(window_s * _MICROS)

    def _steps(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each row whether a voyage begins with it, and the path from the row before; from that and the one before it."""
        dev, t, la, lo = rows
        n = len(t)
        silent, leg, fast = np.ones(n, dtype=bool), np.zeros(n), np.zeros(n, dtype=bool)
        silent[1:] = (dev[1:] != dev[:-1]) | (t[1:] - t[:-1] > self.silence)
        leg[1:] = np.where(silent[1:], 0.0, _metres(la[:-1], lo[:-1], la[1:], lo[1:]))
        fast[1:] = ~silent[1:] & (leg[1:] > self.speed * (t[1:] - t[:-1]))
        step = np.where(fast, 0.0, leg)
        spike = np.flatnonzero(fast[2:] & fast[1:-1]) + 2
        over = _metres(la[spike - 2], lo[spike - 2], la[spike], lo[spike])
        step[spike] = np.where(over <= self.speed * (t[spike] - t[spike - 2]), over, 0.0)
        return silent, step

    @staticmethod
    def _rows(b: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        return [b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(c).to_numpy() for c in _PING]

    @staticmethod
    def _join(before: list[np.ndarray] | None, rows: list[np.ndarray]) -> tuple[int, list[np.ndarray]]:
        return (0, rows) if before is None else (len(before[0]), [np.concatenate(x) for x in zip(before, rows, strict=True)])

    @staticmethod
    def _voyage_path(silent: np.ndarray, step: np.ndarray, path: float) -> np.ndarray:
        run = np.cumsum(step)
        since = np.maximum.accumulate(np.where(silent, np.arange(len(step)), -1))
        return np.where(since >= 0, run - run[since], run + path)

    def summarise(self, batches: Iterator[pa.RecordBatch]) -> dict:
        first, tail, n, silences, path = None, None, 0, 0, 0.0
        for b in batches:
            at, rows = self._join(tail, self._rows(b))
            silent, step = self._steps(rows)
            seen = max(at, 2 - n + at)  # the first two rows depend on what is before them
            silent, step = silent[seen:], step[seen:]
            if len(step):
                silences, path = silences + int(silent.sum()), float(self._voyage_path(silent, step, path)[-1])
            n += b.num_rows
            tail = [x[-2:] for x in rows]
            if first is None or len(first[0]) < 2:
                first = [x[:2] for x in (self._rows(b) if first is None else rows)]
        return {"first": first, "tail": tail, "n": n, "silences": silences, "path": path}

    def combine(self, parts: list[dict]) -> list:
        out, tail, n, voyages, path = [], None, 0, 0, 0.0
        for p in parts:
            out.append((tail, n, voyages, path))
            at, rows = self._join(tail, p["first"])
            silent, step = self._steps(rows)
            voyages, path = voyages + int(silent[at:].sum()), float(self._voyage_path(silent[at:], step[at:], path)[-1])
            path = p["path"] if p["silences"] else path + p["path"]
            voyages, n = voyages + p["silences"], n + p["n"]
            tail = [x[-2:] for x in self._join(tail, p["tail"])[1]]
        return out

    def emit(self, batches: Iterator[pa.RecordBatch], carry: tuple) -> Iterator[pa.RecordBatch]:
        tail, n, voyages, path = carry

        def blocks() -> Iterator[pa.Table]:
            held, many = [], 0
            for b in batches:
                held.append(b)
                many += b.num_rows
                if many >= _BLOCK:
                    yield pa.Table.from_batches(held)
                    held, many = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for block in blocks():
            at, rows = self._join(tail, self._rows(block))
            silent, step = self._steps(rows)
            silent, step = silent[at:], step[at:]
            dev, t, la, lo = (x[at:] for x in rows)
            line, run = voyages + np.cumsum(silent), self._voyage_path(silent, step, path)
            low = low_movability(t, line, la, lo, run, self.window, self.patience, self.radius)
            keep = np.flatnonzero(low)
            p, q = keep[:-1], keep[1:]
            cut = np.ones(len(keep), dtype=bool)
            # No stop reaches from q back to p: both its pings stand next to each other, or it skips some within the patience.
            far = (q - p > 1) | (_metres(la[p], lo[p], la[q], lo[q]) > 2.04 * self.radius) & (np.abs(la[p]) < 89.5)
            cut[1:] = (line[p] != line[q]) | ((t[q] - t[p] >= self.patience) & far)
            if at:  # the row before is kept as well
                pt, pla, plo = (x[at - 1 : at] for x in rows[1:])
                cut[0] = silent[0] or bool((t[0] - pt[0] >= self.patience) and _metres(pla, plo, la[:1], lo[:1])[0] > 2.04 * self.radius and abs(la[0]) < 89.5)
            names = [c for c in block.schema.names if c != PID]
            kept = block.select(names).take(pa.array(keep))
            for name, x in (("voyage", line[keep]), ("pos", n + keep), ("path_m", run[keep]), ("cut", cut)):
                kept = kept.append_column(name, pa.array(x))
            yield from kept.combine_chunks().to_batches()
            n, voyages, path, tail = n + block.num_rows, int(line[-1]), float(run[-1]), [x[-2:] for x in rows]


class _Stretches:
    """Numbers the stretches that the cuts begin."""

    def summarise(self, batches: Iterator[pa.RecordBatch]) -> dict:
        return {"cuts": sum(int(b.column("cut").to_numpy(zero_copy_only=False).sum()) for b in batches)}

    def combine(self, parts: list[dict]) -> list:
        return [int(x) for x in np.cumsum([0, *(p["cuts"] for p in parts)])[:-1]]

    def emit(self, batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[pa.RecordBatch]:
        n = carry
        for b in batches:
            number = n + np.cumsum(b.column("cut").to_numpy(zero_copy_only=False))
            n = int(number[-1])
            names = [x for x in b.schema.names if x not in (PID, "cut")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(number)], names=[*names, "stretch"])


def _circle(points: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Smallest circle around a few points (incremental construction)."""

    def two(a: tuple, b: tuple) -> tuple[float, float, float]:
        x, y = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
        return x, y, math.hypot(a[0] - x, a[1] - y)

    def three(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float]:
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-9:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda q: q[2])
        ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
        uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return a[0] + ux, a[1] + uy, math.hypot(ux, uy)

    def out(p: tuple, c: tuple) -> bool:
        return math.hypot(p[0] - c[0], p[1] - c[1]) > c[2] + 1e-6

    c = (points[0][0], points[0][1], 0.0)
    for i, p in enumerate(points):
        if out(p, c):
            c = (p[0], p[1], 0.0)
            for j in range(i):
                if out(points[j], c):
                    c = two(p, points[j])
                    for k in range(j):
                        if out(points[k], c):
                            c = three(p, points[j], points[k])
    return c


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull; they alone decide about the smallest circle."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq) -> list:
        h: list = []
        for p in seq:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) <= (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]):
                h.pop()
            h.append(p)
        return h[:-1]

    return half(pts) + half(reversed(pts))


class _Run:
    """A growing run of pings; it holds hull corners, first and last ping and the path."""

    __slots__ = ("at", "circle", "corners", "cos0", "count", "lat0", "last", "lon0", "near", "path", "tip")

    def __init__(self, la: np.ndarray, lo: np.ndarray, i: int):
        self.at, self.last, self.count, self.near, self.path = i, i, 1, False, 0.0
        self.lat0, self.lon0 = float(la[i]), float(lo[i])
        self.cos0 = math.cos(math.radians(self.lat0))
        self.tip = (0.0, 0.0, i)
        self.corners, self.circle = [self.tip], (0.0, 0.0, 0.0)

    def takes(self, lat: float, lon: float, j: int, radius: float) -> None:
        """Add ping ``j`` if all then lie within ``radius`` of one point."""
        dlon = (lon - self.lon0 + 180.0) % 360.0 - 180.0
        p = (math.radians(dlon) * self.cos0 * _EARTH_M, math.radians(lat - self.lat0) * _EARTH_M, j)
        x, y, r = self.circle
        far = math.hypot(p[0] - x, p[1] - y)
        if far - r > 2 * radius:
            return
        corners, circle = _hull([*self.corners, p]), self.circle
        if far > r + 1e-6:
            circle = _circle(corners)
            if circle[2] > radius:
                self.near = True
                return
        self.path += math.hypot(p[0] - self.tip[0], p[1] - self.tip[1])
        self.corners, self.circle, self.tip, self.last, self.count = corners, circle, p, j, self.count + 1

    def takes_block(self, t: np.ndarray, la: np.ndarray, lo: np.ndarray, pos: np.ndarray, j: int, end: int, patience_us: float) -> int:
        """Add the pings from ``j`` on that lie in the circle as it is and follow without a break; returns how many."""
        dlon = (lo[j:end] - self.lon0 + 180.0) % 360.0 - 180.0
        x, y = np.radians(dlon) * (self.cos0 * _EARTH_M), np.radians(la[j:end] - self.lat0) * _EARTH_M
        ok = np.hypot(x - self.circle[0], y - self.circle[1]) <= self.circle[2] + 1e-6
        follows = (np.diff(pos[j:end], prepend=pos[self.last]) == 1) | (np.diff(t[j:end], prepend=t[self.last]) < patience_us)
        ok &= follows
        many = len(ok) if ok.all() else int(np.argmin(ok))
        if many:
            x, y = x[:many], y[:many]
            self.path += float(np.hypot(np.diff(x, prepend=self.tip[0]), np.diff(y, prepend=self.tip[1])).sum())
            self.corners = _hull([*self.corners, *zip(x.tolist(), y.tolist(), range(j, j + many), strict=True)])
            self.last, self.count, self.tip = j + many - 1, self.count + many, (float(x[-1]), float(y[-1]), j + many - 1)
        return many

    def centre(self) -> tuple[float, float]:
        x, y, _ = self.circle
        lon = self.lon0 + math.degrees(x / (self.cos0 * _EARTH_M)) if self.cos0 > 1e-9 else self.lon0
        return self.lat0 + math.degrees(y / _EARTH_M), (lon + 180.0) % 360.0 - 180.0


def _grow(t: np.ndarray, la: np.ndarray, lo: np.ndarray, pos: np.ndarray, i: int, end: int, radius: float, patience_us: float) -> _Run:
    """The longest run from ping ``i``: pings farther off are skipped within the patience."""
    run, j, single = _Run(la, lo, i), i + 1, 16
    while j < end:
        if single <= 0:
            taken = run.takes_block(t, la, lo, pos, j, min(end, j + 256), patience_us)
            if taken:
                j += taken
                continue
            single = 16
        if pos[j] > pos[run.last] + 1 and t[j] - t[run.last] >= patience_us:
            break
        run.takes(float(la[j]), float(lo[j]), j, radius)
        j, single = j + 1, single - 1
    return run


def stops_of(
    t: np.ndarray, la: np.ndarray, lo: np.ndarray, pos: np.ndarray | None = None, radius: float = 300.0, patience_us: float = 600 * _MICROS, least_us: float = 1800 * _MICROS, least: int = 3
) -> list[_Run]:
    """Stops among the pings of one stretch, in order.

    ``pos`` numbers the pings among all of the device: where it skips, some under way were taken out.
    A run is a stop if it has ``least`` pings, lasts ``least_us`` and keeps within ``radius`` of
    one point. Of runs that overlap, the one with most pings wins,
    then the longer, then the earlier; what is left on either side is searched again.
    """
    pos = np.arange(len(t)) if pos is None else pos
    grow = lambda i, end: _grow(t, la, lo, pos, i, end, radius, patience_us)

    def good(r: _Run) -> bool:
        return r.count >= least and t[r.last] - t[r.at] >= least_us

    def size(r: _Run) -> tuple:
        return r.count, t[r.last] - t[r.at], -r.at

    out, todo = [], [(0, len(t))]
    while todo:
        i, end = todo.pop()
        while i <= end - least:
            best = grow(i, end)
            if not good(best):
                i += 1
                continue
            begin, other = i, best
            while other.near:  # a ping nearby was left out: a run without the first corner may be longer
                s = min(c[2] for c in other.corners) + 1
                if s > best.last:
                    break
                other = grow(s, end)
                if good(other) and size(other) > size(best):
                    best = other
            if best.at - begin >= least:
                todo.append((begin, best.at))
            out.append(best)
            i = best.last + 1
    return sorted(out, key=lambda r: r.at)


def _detect(radius: float, patience_us: float, least_us: float, least: int):
    """Stops of the stretches of a partition that is sorted by stretch and position; one stretch is held at once."""

    def flush(held: list[pa.RecordBatch], into: list) -> None:
        rows = pa.Table.from_batches(held)
        t = rows.column("t_us").to_numpy()
        if len(t) < least or t[-1] - t[0] < least_us:
            return
        la, lo, pos, ids, path = (rows.column(c).to_numpy() for c in ("latitude", "longitude", "pos", "id", "path_m"))
        key = tuple(rows.column(c)[0].as_py() for c in ("voyage", "device_id"))
        for r in stops_of(t, la, lo, pos, radius, patience_us, least_us, least):
            a, z, (lat, lon) = r.at, r.last, r.centre()
            into.append((*key, int(ids[a]), int(ids[z]), int(t[a]), int(t[z]), r.count, lat, lon, r.path, float(path[a]), float(path[z])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, found = [], None, []
        for b in batches:
            if not b.num_rows:
                continue
            stretch = b.column("stretch").to_numpy()
            starts = np.r_[0, np.flatnonzero(stretch[1:] != stretch[:-1]) + 1, len(stretch)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if held and stretch[s] != key:
                    flush(held, found)
                    held = []
                held.append(b.slice(int(s), int(e - s)))
                key = stretch[s]
            if len(found) > 5000:
                yield _stop_batch(found)
                found = []
        if held:
            flush(held, found)
        if found:
            yield _stop_batch(found)

    return run


_STOPS = "voyage long, device_id long, first_photo_id long, last_photo_id long, start_us long, end_us long, pings long, latitude double, longitude double, path_m double, path_at_start double, path_at_end double"


def _stop_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _STOPS.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def valid_pings(photos: DataFrame) -> DataFrame:
    """Pings ``device_id, t_us, latitude, longitude, id``: trusted time, position in range.

    Of pings of a device at the same time the smallest id stands for all.
    """
    within = lambda c, top: F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(-top, top)
    rows = photos.filter(
        F.col("device_id").isNotNull() & F.col("capture_at").isNotNull() & F.col("id").isNotNull()
        & F.col("capture_source").isin("exif", "filename") & within("latitude", 90.0) & within("longitude", 180.0)
    )
    t = wall_micros("capture_at").alias("t_us")
    first = F.min(F.struct(F.col("id").cast("long").alias("id"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))).alias("p")
    return rows.groupBy(F.col("device_id").cast("long").alias("device_id"), t).agg(first).select("device_id", "t_us", "p.latitude", "p.longitude", "p.id")


def stops_and_trips(
    photos: DataFrame,
    radius_m: float = 300.0,
    patience_s: float = 600.0,
    least_s: float = 1800.0,
    silence_s: float = 8 * 3600.0,
    least_pings: int = 3,
    most_speed: float = 300.0,
) -> DataFrame:
    """Stops of each device and the trips between successive stops.

    A stop is a longest run of at least ``least_pings`` pings over ``least_s`` seconds
    within ``radius_m`` of one point. Farther pings are skipped while less than
    ``patience_s`` lies between the stop's pings around them; a silence of more than
    ``silence_s`` ends it. A trip joins two successive stops with no such silence
    between them. Result: ``kind, device_id, first_photo_id, last_photo_id, started_at,
    ended_at, duration_s, distance_m, path_m, latitude, longitude, pings``. A stop's distance is 0 and
    its path runs over its own pings. A trip's distance is the straight line between the two
    stops' centres; its path is the sum over the pings between, without jumps faster than
    ``most_speed`` metres a second, and never shorter than that line. Latitude, longitude and
    pings describe stops (null for trips). Nulls, NaN and positions out of range are no pings.
    """
    pings = valid_pings(photos)
    found = _candidates(pings, radius_m, patience_s, least_s, silence_s, most_speed).repartition("stretch").sortWithinPartitions("stretch", "pos")
    stops = materialize(found.mapInArrow(_detect(radius_m, patience_s * _MICROS, least_s * _MICROS, least_pings), _STOPS), "stops")
    back = wall_time
    # A device has at most two stops an hour, so a window by device stays small.
    order = Window.partitionBy("device_id", "voyage").orderBy("start_us")
    following = {c: F.lead(c).over(order).alias(f"next_{c}") for c in ("first_photo_id", "start_us", "latitude", "longitude", "path_at_start")}
    legs = stops.select("*", *following.values()).filter("next_first_photo_id is not null")
    legs = legs.withColumn("line_m", haversine_m("latitude", "longitude", "next_latitude", "next_longitude"))
    trips = legs.select(
        F.lit("trip").alias("kind"), "device_id", F.col("last_photo_id").alias("first_photo_id"), F.col("next_first_photo_id").alias("last_photo_id"),
        back("end_us").alias("started_at"), back("next_start_us").alias("ended_at"), ((F.col("next_start_us") - F.col("end_us")) / _MICROS).alias("duration_s"),
        F.col("line_m").alias("distance_m"), F.greatest("line_m", F.col("next_path_at_start") - F.col("path_at_end")).alias("path_m"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("long").alias("pings"),
    )
    return stops.select(
        F.lit("stop").alias("kind"), "device_id", "first_photo_id", "last_photo_id", back("start_us").alias("started_at"), back("end_us").alias("ended_at"),
        ((F.col("end_us") - F.col("start_us")) / _MICROS).alias("duration_s"), F.lit(0.0).alias("distance_m"), "path_m", "latitude", "longitude", "pings",
    ).unionByName(trips)


def _candidates(pings: DataFrame, radius_m: float, patience_s: float, least_s: float, silence_s: float, most_speed: float) -> DataFrame:
    """Pings of low movability, with ``voyage, pos, path_m`` and the stretch of merged windows they belong to."""
    ordered = range_sorted(pings, [F.col("device_id"), F.col("t_us")])
    line = _Line(radius_m, patience_s, silence_s, least_s / 2, most_speed)
    schema = pings.schema.add("voyage", "long").add("pos", "long").add("path_m", "double")
    low = ordered_scan(ordered, line.summarise, line.combine, line.emit, T.StructType([*schema.fields, T.StructField("cut", T.BooleanType())]))
    low, scan = checkpointed(low.withColumn(PID, F.spark_partition_id())), _Stretches()
    return ordered_scan(low, scan.summarise, scan.combine, scan.emit, T.StructType([*schema.fields, T.StructField("stretch", T.LongType())]))
