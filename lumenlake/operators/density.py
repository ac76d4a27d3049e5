"""Density clustering of places and faces (DBSCAN's rules as relations)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.geo import EARTH_RADIUS_KM, haversine_km
from lumenlake.operators.curation import union_find
from lumenlake.shared import materialize

_KM_DEGREE = math.pi * EARTH_RADIUS_KM / 180


def _geo_pairs(asking: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """Pairs ``a, b`` of a row of ``asking`` and a different one of ``points`` within ``km`` (both ``id, lat, lon``).

    A grid join: cells are ``km`` high and, by their band of latitude, wide enough; a point looks
    into the cells that its circle can touch, around the date line too.
    """
    deg = km / _KM_DEGREE * 1.000001
    band = F.floor((F.col("lat") + 90) / deg).cast("long")

    def width(b):
        top = F.least(F.lit(90.0), F.greatest(F.abs(b * deg - 90), F.abs((b + 1) * deg - 90)))
        return F.least(F.lit(360.0), deg / F.greatest(F.cos(F.radians(top)), F.lit(1e-4)))

    def cells(b):
        return F.greatest(F.lit(1), F.ceil(360.0 / width(b))).cast("long")

    base = points.select("id", "lat", "lon", band.alias("b")).withColumn("c", F.pmod(F.floor((F.col("lon") + 180) / width(F.col("b"))).cast("long"), cells(F.col("b"))))
    reach = F.least(F.lit(180.0), 1.001 * deg / F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + deg))), F.lit(1e-4)))
    asks = asking.select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"), "lat", band.alias("b0"), reach.alias("reach"))
    asks = asks.withColumn("b", F.explode(F.sequence(F.col("b0") - 1, F.col("b0") + 1)))
    low = F.floor((F.col("lo") - F.col("reach") + 180) / width(F.col("b"))).cast("long")
    high = F.floor((F.col("lo") + F.col("reach") + 180) / width(F.col("b"))).cast("long")
    span = F.least(high - low, cells(F.col("b")) - 1)
    asks = asks.select("a", "la", "lo", "b", F.explode(F.array_distinct(F.transform(F.sequence(low, low + span), lambda c: F.pmod(c, cells(F.col("b")))))).alias("c"))
    met = asks.join(base, ["b", "c"]).filter((F.col("a") != F.col("id")) & (haversine_km("la", "lo", "lat", "lon") <= km))
    return met.select("a", F.col("id").alias("b"))


def _touching(points: DataFrame, km: float) -> DataFrame:
    """Pairs ``a, b`` of dense cells (``cell``) that have points within ``km`` of each other.

    A cell's points are boxed in 64 parts. Boxes that lie within ``km`` as wholes settle a pair
    of cells; only for pairs that none settles are the points of boxes at the edge compared.
    """
    part = lambda x, low, high: F.least(F.lit(7), F.floor((F.col(x) - F.col(low)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-12)) * 8)).cast("int")
    spans = points.groupBy("cell").agg(F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"))
    parted = materialize(points.join(spans, "cell").select("id", "cell", "lat", "lon", (part("lat", "y0", "y1") * 8 + part("lon", "x0", "x1")).alias("part")), "parted")
    boxes = parted.groupBy("cell", "part").agg(F.min("id").alias("id"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"))
    boxes = boxes.withColumns({"lat": (F.col("y0") + F.col("y1")) / 2, "lon": (F.col("x0") + F.col("x1")) / 2})
    corners = [haversine_km("lat", "lon", y, x) for y in ("y0", "y1") for x in ("x0", "x1")]
    boxes = materialize(boxes.select("id", "cell", "part", "lat", "lon", (F.greatest(*corners) * 1.0001 + 1e-9).alias("r")), "boxes")
    # a box is at most as large as its cell, whose diagonal is km
    near = _geo_pairs(boxes.select("id", "lat", "lon"), boxes.select("id", "lat", "lon"), km * 2.01).filter("a < b")
    side = lambda s: boxes.select(*[F.col(c).alias(f"{c}_{s}") for c in boxes.columns]).withColumnRenamed(f"id_{s}", s)
    met = near.join(side("a"), "a").join(side("b"), "b").filter("cell_a != cell_b")
    apart, slack = haversine_km("lat_a", "lon_a", "lat_b", "lon_b"), F.col("r_a") + F.col("r_b")
    met = met.withColumns({"sure": apart + slack <= km, "perhaps": apart - slack <= km}).filter("perhaps")
    met = materialize(met.select(F.least("cell_a", "cell_b").alias("p"), F.greatest("cell_a", "cell_b").alias("q"), "cell_a", "part_a", "cell_b", "part_b", "sure"), "met")
    sure = met.filter("sure").select("p", "q").distinct()
    open_ = met.join(sure, ["p", "q"], "left_anti")
    end = lambda s: parted.select(F.col("cell").alias(f"cell_{s}"), F.col("part").alias(f"part_{s}"), F.col("lat").alias(f"y_{s}"), F.col("lon").alias(f"x_{s}"))
    edge = open_.join(end("a"), ["cell_a", "part_a"]).join(end("b"), ["cell_b", "part_b"]).filter(haversine_km("y_a", "x_a", "y_b", "x_b") <= km)
    return sure.unionByName(edge.select("p", "q").distinct()).select(F.col("p").alias("a"), F.col("q").alias("b"))


def _geo_labels(points: DataFrame, km: float, least: int) -> DataFrame:
    """``id, label`` of positions (``id, lat, lon, w``) in clusters.

    Positions are sorted into cells whose diagonal is ``km``. All points of a cell with weight
    enough are cores of one cluster, so such a cell is one vertex and its points are never paired;
    what lies in thinner cells, a few points each, is compared with everything around it.
    """
    side = km / math.sqrt(2) / _KM_DEGREE * 0.9999
    band = F.floor((F.col("lat") + 90) / side)
    flat = F.when((band * side <= 90) & ((band + 1) * side >= 90), 0.0).otherwise(F.least(F.abs(band * side - 90), F.abs((band + 1) * side - 90)))
    column = F.floor((F.col("lon") + 180) / F.least(F.lit(360.0), side / F.greatest(F.cos(F.radians(flat)), F.lit(1e-6))))
    celled = points.withColumns({"_y": band, "_x": column})
    weights = celled.groupBy("_y", "_x").agg(F.sum("w").alias("_w"), F.min("id").alias("_first"))
    celled = celled.join(weights, ["_y", "_x"]).select("id", "lat", "lon", "w", F.when(F.col("_w") >= least, F.col("_first")).alias("cell"))
    celled = materialize(celled, "celled")
    dense, thin = celled.filter("cell is not null"), celled.filter("cell is null")
    pairs = materialize(_geo_pairs(thin, points, km), "near-thin")
    around = pairs.join(points.select(F.col("id").alias("b"), "w"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("near"))
    lone = thin.join(around, "id").filter(F.col("w") + F.col("near") >= least).select("id", F.col("id").alias("vertex"))
    cores = materialize(dense.select("id", F.col("cell").alias("vertex")).unionByName(lone), "cores")
    to_core = materialize(pairs.join(cores.withColumnsRenamed({"id": "b", "vertex": "vb"}), "b").select("a", "vb"), "to-core")
    links = to_core.join(lone.select(F.col("id").alias("a")), "a", "left_semi").select("a", F.col("vb").alias("b")).unionByName(_touching(dense, km)).filter("a != b").distinct()
    roots = union_find(links, "a", "b")
    named = materialize(cores.select("vertex").distinct().join(roots, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("label")), "vertex-labels")
    inner = cores.join(named, "vertex").select("id", "label")
    border = to_core.join(lone.select(F.col("id").alias("a")), "a", "left_anti").join(named.withColumnRenamed("vertex", "vb"), "vb").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
    return inner.unionByName(border)


def place_clusters(photos: DataFrame, km: float = 25.0, least: int = 5) -> DataFrame:
    """``id, cluster_id`` of located photos in clusters, named by the cluster's smallest photo.

    A photo with ``least`` photos (itself included) within ``km`` is a core; cores within ``km`` of
    each other are one cluster, other photos join the cluster of the lowest-numbered core near
    them; the rest is noise. Photos at one position are one point with a weight. Positions that
    are missing, NaN or out of range take no part.
    """
    rows = photos.filter("latitude between -90 and 90 and longitude between -180 and 180 and not isnan(latitude) and not isnan(longitude)")
    points = materialize(rows.groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(F.min("id").alias("id"), F.count("*").alias("w")), "positions")
    labels = _geo_labels(points, km, least).join(points, "id")
    found = rows.select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).join(labels.select("lat", "lon", "label"), ["lat", "lon"]).select("id", "label")
    found = materialize(found, "place-labels")
    names = found.groupBy("label").agg(F.min("id").alias("cluster_id"))
    return found.join(names, "label").select("id", "cluster_id")


def _unit(raw: bytes, dim: int) -> np.ndarray:
    """Vectors of a block as float64 of length 1."""
    x = np.frombuffer(raw, np.float32).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _gathered(x: np.ndarray, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``x`` by group, and the groups' sizes.

    A row joins the leader it is most alike if their cosine is ``alike`` or more, else it becomes a leader.
    """
    group, leaders, n = np.empty(len(x), np.int64), np.empty_like(x), 0
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        best = np.full(len(part), -2, np.float32)
        mine = group[at : at + 512]
        if n:
            to = part @ leaders[:n].T
            mine[:] = to.argmax(1)
            best = to[np.arange(len(part)), mine]
        while (best < alike).any():
            new = int(np.flatnonzero(best < alike)[0])
            leaders[n] = part[new]
            to = part @ part[new]
            to[new] = 2
            mine[to > best], best = n, np.maximum(best, to)
            n += 1
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=n)
    return order, sizes[sizes > 0]


def _packed(rows: DataFrame, block: int, dim: int, alike: float = 0.8) -> DataFrame:
    """Blocks ``k, ids, xs, sizes`` of rows (``id, v``): one row for up to ``block`` vectors, as bytes in order of groups.

    Vectors next to the same two pivots are near each other in the order that blocks are cut from, so
    that faces of a person share a block and a group. Where they don't, only time is lost.
    """
    few = max(1, math.ceil(rows.count() / block))
    # one pivot a block
    pivots = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(max(2, few)).select("v").collect()], np.float32)
    if len(pivots):
        pivots = _unit(pivots.tobytes(), dim).astype(np.float32)

    def flat(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = _unit(flat(batch).tobytes(), dim).astype(np.float32) @ pivots.T
                first = to.argmax(1)
                to[np.arange(len(to)), first] = -2
                near = first * len(pivots) + to.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int64))], names=["id", "v", "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, held = [], [], 0

        def out() -> pa.RecordBatch:
            own, raw = np.concatenate(ids), np.concatenate(vs)
            order, sizes = _gathered(_unit(raw.tobytes(), dim).astype(np.float32), alike)
            own, raw = own[order], raw[order]
            names = ["k", "ids", "xs", "sizes"]  # ids are unique, so any one names its block
            return pa.RecordBatch.from_arrays([pa.array([int(own.min())]), *[pa.array([x.tobytes()], pa.binary()) for x in (own, raw, sizes.astype(np.int64))]], names=names)

        for batch in batches:
            own, raw = batch.column("id").to_numpy(), flat(batch)
            for at in range(0, len(own), block):
                if held and held + len(own[at : at + block]) > 1.5 * block:
                    yield out()
                    ids, vs, held = [], [], 0
                ids.append(own[at : at + block])
                vs.append(raw[at : at + block])
                held += len(ids[-1])
        if held:
            yield out()

    ranged = rows.select("id", "v").mapInArrow(placed, "id long, v array<float>, near long").repartitionByRange(few, "near", "id")
    return materialize(ranged.mapInArrow(pack, "k long, ids binary, xs binary, sizes binary"), "face-blocks")


class _Linked:
    """Links met so far between the vertices of two blocks: neighbours counted, cores joined.

    A vertex with ``least - 1`` links here is a core whatever the other blocks hold. Links of two such cores are
    joined at once and forgotten; any other link has an end with fewer links, so few are kept.
    """

    def __init__(self, n: int, least: int):
        self.count, self.root, self.least = np.zeros(n, np.int64), np.arange(n), least
        self.open: list[np.ndarray] = []

    def _find(self, u: np.ndarray) -> np.ndarray:
        r = self.root[u]
        while (up := self.root[r]).tobytes() != r.tobytes():
            r = up
        self.root[u] = r
        return r

    def _join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self._find(u), self._find(v)
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def add(self, u: np.ndarray, v: np.ndarray, both: bool) -> None:
        """Links from ``u`` to ``v``; with ``both`` they count for ``v`` too, else each comes a second time, turned."""
        self.count += np.bincount(u, minlength=len(self.count))
        if both:
            self.count += np.bincount(v, minlength=len(self.count))
        core = self.count >= self.least - 1
        sure = core[u] & core[v]
        self._join(u[sure], v[sure])
        self.open.append(np.stack([u[~sure], v[~sure]]))

    def rest(self) -> np.ndarray:
        """The links with an end that isn't known to be a core; all others are joined."""
        u, v = np.concatenate([np.empty((2, 0), np.int64), *self.open], axis=1)
        core = self.count >= self.least - 1
        sure = core[u] & core[v]
        self._join(u[sure], v[sure])
        self._find(np.arange(len(self.root)))
        return np.stack([u[~sure], v[~sure]])


def _near(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``x`` and ``y`` with a cosine of ``least`` or more, in parts; ``y`` comes in groups of ``sizes``.

    A row that is farther from a group's centre than the group's radius and the limit together has none of
    it near (angles obey the triangle inequality), so only other groups are looked into. Float32 decides
    what it can for certain, float64 the rest.
    """
    slack = 1e-5
    starts = np.cumsum(sizes) - sizes
    centre = np.add.reduceat(y, starts, axis=0)
    centre /= np.maximum(np.linalg.norm(centre, axis=1), 1e-9)[:, None]
    cosine = np.minimum.reduceat(np.einsum("ij,ij->i", y, np.repeat(centre, sizes, axis=0)), starts)
    reach = np.arccos(np.clip(cosine, -1, 1)) + math.acos(max(-1.0, min(1.0, least))) + 1e-4
    bound = np.where(reach < math.pi, np.cos(np.minimum(reach, math.pi)), -2) - slack
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    # groups up to a multiple of eight, so that eight comparisons are looked at as one number
    full = -len(sizes) % 8
    centre = np.concatenate([centre, np.zeros((full, centre.shape[1]))]).astype(np.float32)
    bound = np.concatenate([bound, np.full(full, 3)]).astype(np.float32)

    def checked(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = s >= least - slack
        u, v, s = u[ok], v[ok], s[ok]
        close = np.flatnonzero(s < least + slack)
        ok = np.ones(len(u), bool)
        for at in range(0, len(close), 1 << 16):
            some = close[at : at + (1 << 16)]
            ok[some] = np.einsum("ij,ij->i", x[u[some]], y[v[some]]) >= least
        if same:
            ok &= u != v
        return u[ok], v[ok]

    tile = max(64, min(2048, (1 << 22) // len(bound)))
    for at in range(0, len(x), tile):
        met = (x32[at : at + tile] @ centre.T >= bound).reshape(-1, 8)
        eights = np.flatnonzero(met.view(np.uint64))
        which, g = np.nonzero(met[eights])
        r, g = np.divmod(eights[which] * 8 + g, len(bound))
        r += at
        large = sizes[g] > 64
        for one in np.unique(g[large]):
            mine = r[large & (g == one)]
            members = np.arange(starts[one], starts[one] + sizes[one])
            step = max(1, (1 << 21) // len(members))
            for k in range(0, len(mine), step):
                s = x32[mine[k : k + step]] @ y32[members].T
                a, b = np.nonzero(s >= least - slack)
                yield checked(mine[k : k + step][a], members[b], s[a, b])
        r, g = r[~large], g[~large]
        for k in range(0, len(r), 1024):
            rs, n, first = r[k : k + 1024], sizes[g[k : k + 1024]], starts[g[k : k + 1024]]
            u = np.repeat(rs, n)
            v = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            yield checked(u, v, np.einsum("ij,ij->i", x32[u], y32[v]))


def _face_links(rows: DataFrame, eps: float, least: int, block: int, dim: int) -> DataFrame:
    """``what, u, v`` of faces (``id, v``) within ``eps``: neighbour counts, forests of cores, and links that are open.

    Each pair of blocks is one row of a product of the blocks with themselves, which reads both where they
    lie and copies neither to disk. It gives ``count`` rows (a face and its neighbours in this pair), ``core`` rows (links of faces that
    are cores by these alone, as a forest), and ``open`` rows (all links with another end).
    """
    blocks = _packed(rows, block, dim)
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns])
    pairs = side("a").join(side("b").hint("shuffle_replicate_nl"), F.expr("k_a <= k_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda c: batch.column(c)[at].as_buffer()  # noqa: E731, B023
                same = batch.column("k_a")[at].as_py() == batch.column("k_b")[at].as_py()
                ids = {s: np.frombuffer(get(f"ids_{s}"), np.int64) for s in "ab"}
                sizes = {s: np.frombuffer(get(f"sizes_{s}"), np.int64) for s in "ab"}
                x = {s: _unit(get(f"xs_{s}"), dim) for s in ("a" if same else "ab")}
                own = ids["a"] if same else np.concatenate([ids["a"], ids["b"]])
                linked = _Linked(len(own), least)
                if same:
                    for u, v in _near(x["a"], x["a"], sizes["a"], 1 - eps, True):
                        linked.add(u, v, False)
                else:
                    # whichever side has larger groups is searched by group
                    p, q = ("a", "b") if len(ids["a"]) * len(sizes["b"]) <= len(ids["b"]) * len(sizes["a"]) else ("b", "a")
                    shift = {"a": 0, "b": len(ids["a"])}
                    for u, v in _near(x[p], x[q], sizes[q], 1 - eps, False):
                        linked.add(u + shift[p], v + shift[q], True)
                u, v = linked.rest()
                counted, joined = np.flatnonzero(linked.count), np.flatnonzero(linked.root != np.arange(len(own)))
                parts = [("count", own[counted], linked.count[counted]), ("core", own[joined], own[linked.root[joined]]), ("open", own[u], own[v])]
                for what, first, second in parts:
                    if len(first):
                        yield pa.RecordBatch.from_arrays([pa.array([what] * len(first)), pa.array(first), pa.array(second)], names=["what", "u", "v"])

    return materialize(pairs.mapInArrow(compare, "what string, u long, v long"), "face-links")


def face_clusters(faces: DataFrame, eps: float = 0.38, least: int = 3, block: int = 32_000, dim: int = 128) -> DataFrame:
    """``face_id, photo_id, cluster_id``: DBSCAN of faces by cosine distance, named by the smallest face.

    Vectors that are null, of wrong length, zero or not finite take no part, nor do negative or
    null ids. Every pair of faces is compared or ruled out by the distance of one to the other's group
    (``_near``), block against block of up to ``block`` faces and once; a task hands on neighbour counts, a spanning forest and
    the few links of faces that may not be cores, never its pairs. The work still grows with the square of the faces, divided by
    the size of a group.
    """
    c = F.col("embedding")
    ok = (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    good = faces.filter(F.coalesce(ok, F.lit(False)) & (F.col("id") >= 0))
    rows = materialize(good.select(F.col("id").cast("long").alias("id"), "photo_id", c.cast("array<float>").alias("v")).dropDuplicates(["id"]), "faces")
    found = _face_links(rows, eps, least, block, dim)
    counts = found.filter("what = 'count'").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("n"))
    if least <= 1:
        counts = rows.select("id").join(counts, "id", "left").fillna(0, ["n"])
    core = materialize(counts.filter(F.col("n") + 1 >= least).select("id"), "core-faces")
    end = lambda s: core.select(F.col("id").alias(s), F.lit(True).alias(f"core_{s}"))
    open_ = materialize(found.filter("what = 'open'").join(end("u"), "u", "left").join(end("v"), "v", "left").select("u", "v", F.col("core_u").isNotNull().alias("cu"), F.col("core_v").isNotNull().alias("cv")), "open-links")
    links = found.filter("what = 'core'").select("u", "v").unionByName(open_.filter("cu and cv").select("u", "v"))
    roots = union_find(links, "u", "v")
    labelled = materialize(core.join(roots.withColumnRenamed("vertex", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("label")), "face-cores")
    at_border = open_.filter("cu != cv").select(F.when(F.col("cu"), F.col("v")).otherwise(F.col("u")).alias("at"), F.when(F.col("cu"), F.col("u")).otherwise(F.col("v")).alias("id"))
    border = at_border.join(labelled, "id").groupBy(F.col("at").alias("id")).agg(F.min("label").alias("label"))
    labels = materialize(labelled.unionByName(border), "face-labels")
    names = labels.groupBy("label").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return labels.join(names, "label").join(rows.select("id", "photo_id"), "id").select(F.col("id").alias("face_id"), "photo_id", "cluster_id")
