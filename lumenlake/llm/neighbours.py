"""Most similar vectors for every vector by multiprobe p-stable hashing.

Vectors are compared by cosine, so they are brought to unit length; then closeness in
angle is closeness in Euclidean distance, for which Gaussian projections cut into cells of a
width are a locality-sensitive (p-stable) hash. Several projections make a bucket. A
query looks into its own bucket and into perturbed ones, in the order in which they
are expected to hold near vectors: those across the nearest cell borders first.

Within a bucket similarities are taken on 8-bit codes (exact integer products of one
task's arrays). Where the error of the codes leaves a query too many candidates, the whole
bucket is searched again on the full vectors. The candidates of each query over all tables
and probes are then ranked again by the exact similarity of the full vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.shared import materialize

#: Error of a similarity on 8-bit codes, some five standard deviations.
_CODE_ERROR = 0.006

#: More than the rounding of a similarity of full vectors.
_ROUNDING = 1e-12


def collision(distance: float, width: float) -> float:
    """Probability that two points at a distance share a cell of one Gaussian projection."""
    r = width / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def perturbations(k: int, many: int) -> list[tuple[int, ...]]:
    """Sets of border ranks to cross, in order of estimated success.

    Rank j is the j-th nearest of the 2k cell borders; the expected squared distance to it
    is known for points spread evenly in their cells, and the two borders of one
    projection (ranks j and 2k - 1 - j) can't both be crossed.
    """
    rise = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    fall = [1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
    cost, ranks = rise + fall, range(min(2 * k, 12))
    sets = [(sum(cost[x] for x in c), c) for n in range(1, 5) for c in itertools.combinations(ranks, n) if not any(2 * k - 1 - x in c for x in c)]
    return [c for _, c in sorted(sets)[:many]]


def _cells(projected: np.ndarray, many: int) -> np.ndarray:
    """Cell numbers (n, 1 + probes, k): the own bucket first, then the perturbed ones."""
    own = np.floor(projected)
    inside = projected - own
    n, k = projected.shape
    order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1)
    sets = perturbations(k, many)
    out = np.repeat(own[:, None, :], len(sets) + 1, axis=1)
    for t, ranks in enumerate(sets, 1):
        for r in ranks:
            border = order[:, r]
            out[np.arange(n), t, border % k] += np.where(border < k, -1, 1)
    return out.astype(np.int64)


def _mix(cells: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (cells * salt).sum(-1)
        h ^= h >> 29
        return h * np.int64(0x1B873593CC9E2D51)


class Plan:
    """Hash functions for a collection: the same on every executor, drawn from a seed."""

    def __init__(self, dim: int, size: int, width: float, far: float, bucket: int, tables: int, seed: int, probes: int | None = None):
        rng = np.random.default_rng(seed)
        share = -math.log(collision(far, width))
        self.k = max(1, round(math.log(max(1.0, size / bucket)) / share))
        self.probes = probes or (max(5, 2 * (self.k - 3)) if tables > 1 else max(2, 2 * self.k - 4))
        self.width, self.tables = width, tables
        spare = 12  # drawn and not used: the functions stay those for which recall was measured
        self.a = rng.standard_normal((tables, dim, self.k + spare))[:, :, : self.k]
        self.b = rng.random((tables, self.k + spare))[:, : self.k]
        self.salt = (rng.integers(1, 2**61, (tables, self.k + spare)) | 1)[:, : self.k]

    def own(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """Each table's own buckets."""
        for t in range(self.tables):
            cells = np.floor((unit @ self.a[t] + self.b[t] * self.width) / self.width).astype(np.int64)
            yield _mix(cells, self.salt[t]) ^ np.int64(t)

    def buckets(self, ids: np.ndarray, unit: np.ndarray, probing: np.ndarray, hot: dict[int, tuple[int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
        """``(bucket, part, row, own, asks, wants)`` for all vectors' own buckets and the probes of those in ``probing``.

        ``hot`` has for crowded buckets the number of shares and of blocks. The queries of a crowded
        bucket are shared out, its vectors are cut into blocks, and each share meets each block in
        a part of its own. A query of the bucket that is a guest in another block there doesn't want.
        """
        for t in range(self.tables):
            projected = unit @ self.a[t] + self.b[t] * self.width
            home = _mix(np.floor(projected / self.width).astype(np.int64), self.salt[t]) ^ np.int64(t)
            asking = np.flatnonzero(probing)
            keys = _mix(_cells(projected[asking] / self.width, self.probes), self.salt[t]) ^ np.int64(t)
            step = max(1, 20_000 // max(1, len(asking)))
            for p in [0, *range(1, keys.shape[1], step)]:
                rows = np.arange(len(unit)) if p == 0 else np.repeat(asking, len(range(keys.shape[1])[p : p + step]))
                key, mine = home if p == 0 else keys[:, p : p + step].ravel(), np.full(len(rows), p == 0)
                crowded = np.isin(key, self._hot(hot)) if hot else np.zeros(len(rows), dtype=bool)
                calm = ~crowded
                yield key[calm], np.zeros(int(calm.sum()), dtype=np.int32), rows[calm], mine[calm], probing[rows[calm]], probing[rows[calm]]
                for h in np.unique(key[crowded]):
                    at = rows[key == h]
                    shares, blocks = hot[int(h)]
                    turn, block = ids[at] % shares, ids[at] // shares % blocks
                    for share, part in itertools.product(range(shares), range(blocks)):
                        asks, lives = probing[at] & (turn == share), (block == part) & (p == 0)
                        here = asks | lives
                        n = int(here.sum())
                        yield np.full(n, h), np.full(n, share * blocks + part, dtype=np.int32), at[here], lives[here], asks[here], probing[at[here]] & (lives[here] | (p > 0))

    @staticmethod
    def _hot(hot: dict) -> np.ndarray:
        return np.fromiter(hot, dtype=np.int64, count=len(hot))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Indices of each owner's candidates for the ``k`` most similar others, each other once.

    All that the error of the codes can't bar from the first ``k`` stay, in order of
    similarity and then of the smaller identifier.
    """
    order = np.lexsort((other, -sim, owner))
    o, x = owner[order], other[order]
    fresh = np.ones(len(o), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    order, o = order[fresh], o[fresh]
    if not len(o):
        return order
    at = np.arange(len(o))
    start = np.maximum.accumulate(np.where(np.r_[True, o[1:] != o[:-1]], at, 0))
    kth = np.minimum(start + k - 1, len(o) - 1)
    edge = np.where(o[kth] == o, sim[order[kth]], -np.inf) - 2 * _CODE_ERROR
    return order[sim[order] >= edge]


def _crowded(owner: np.ndarray, keep: int) -> bool:
    """Whether anyone of the sorted ``owner`` has more than ``keep`` rows."""
    return bool(len(owner) > keep and (owner[keep:] == owner[: len(owner) - keep]).any())


def _search(ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, own: np.ndarray, asks: np.ndarray, wants: np.ndarray, least: float, k: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Candidates ``(query, other, similarity)`` of one bucket: ``asks`` says who queries here, ``wants`` who does at all.

    None if the codes leave a query more than ``keep`` candidates.
    """
    base, query = np.flatnonzero(own), np.flatnonzero(asks)
    if not len(base) or not len(query):
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    b, sb = codes[base].astype(np.float32).T.copy(), scale[base]
    found: list[tuple] = []
    back: list[tuple] = []
    rows = max(1, min(len(query), 8_000_000 // len(base)))
    for at in range(0, len(query), rows):
        q = query[at : at + rows]
        # exact integers times a product that is the same both ways, so a pair has one value wherever it meets
        sim = (codes[q].astype(np.float32) @ b) * (scale[q][:, None] * sb[None, :])
        hits = sim >= least
        back_from = ~own[q]
        if len(base) > 4 * (k + 1) and np.count_nonzero(hits) > 0.05 * sim.size:
            # Crowded: only what can be among the best of its row, or for probes of its column, is looked at.
            edge = np.partition(sim, -(k + 1), axis=1)[:, -(k + 1)] - 2 * _CODE_ERROR  # the query itself may be among them
            near = sim >= np.maximum(edge, least)[:, None]
            if (np.count_nonzero(near, axis=1) > keep + 1).any():
                return None
            if back_from.sum() > k:
                column = np.partition(sim[back_from], -k, axis=0)[-k] - 2 * _CODE_ERROR
                near[back_from] |= sim[back_from] >= np.maximum(column, least)[None, :]
            else:
                near[back_from] = hits[back_from]
            hits = near
        i, j = np.nonzero(hits)
        other = ids[q[i]] != ids[base[j]]
        i, j = i[other], j[other]
        s, qi, bj = sim[i, j], q[i], base[j]
        best = _best(ids[qi], ids[bj], s, k)
        if _crowded(ids[qi[best]], keep):
            return None
        found.append((ids[qi[best]], ids[bj[best]], s[best]))
        turned = wants[bj] & ~own[qi]  # what a probe meets may have missed the probe's owner
        back.append((ids[bj[turned]], ids[qi[turned]], s[turned]))
        if sum(len(x[0]) for x in back) > 2_000_000:
            o, x, v = (np.concatenate(c) for c in zip(*back, strict=True))
            best = _best(o, x, v, k)
            back = [(o[best], x[best], v[best])]
            if len(best) > 1_000_000:
                return None
    o, x, v = (np.concatenate(c) for c in zip(*found, *back, strict=True))
    best = _best(o, x, v, k)
    return None if _crowded(o[best], keep) else (o[best], x[best], v[best])


def _top(ids: np.ndarray, x: np.ndarray, query: np.ndarray, base: np.ndarray, least: float, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query, other, similarity)`` of the ``k`` most similar others in ``base`` of each ``query``, on full vectors."""
    base = base[np.unique(ids[base], return_index=True)[1]]
    if not len(base) or not len(query):
        return []
    # Of equal vectors only the smallest identifiers can be among the first: one more than k, as the query may be one of them.
    view = np.ascontiguousarray(x[base]).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    group = np.unique(view, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    g = group[order]
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
    base = base[np.sort(order[place <= k])]
    named, b = ids[base], _unit(x[base])
    found = []
    rows = max(1, 4_000_000 // len(base))
    for at in range(0, len(query), rows):
        q = query[at : at + rows]
        a = _unit(x[q])
        sim = a @ b.T
        spot = np.minimum(np.searchsorted(named, ids[q]), len(named) - 1)
        itself = np.flatnonzero(named[spot] == ids[q])
        sim[itself, spot[itself]] = -np.inf
        edge = np.partition(sim, -k, axis=1)[:, -k] - _ROUNDING if len(base) > k else np.full(len(q), -np.inf)
        i, j = np.nonzero(sim >= np.maximum(edge, least - _ROUNDING)[:, None])
        # a product of matrices rounds equal vectors differently by their place
        s = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[i[c : c + 50_000]], b[j[c : c + 50_000]]) for c in range(0, len(i), 50_000))])
        order = np.lexsort((named[j], -s, i))
        o = i[order]
        first = order[np.arange(len(o)) - np.searchsorted(o, o) < k]
        found.append((ids[q[i[first]]], named[j[first]], s[first]))
    return found


def _exact(ids: np.ndarray, x: np.ndarray, own: np.ndarray, asks: np.ndarray, wants: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_search`` on full vectors: no one has more than ``k`` rows for what it met at home, and ``k`` for who came to it."""
    found = _top(ids, x, np.flatnonzero(asks), np.flatnonzero(own), least, k)
    found += _top(ids, x, np.flatnonzero(own & wants), np.flatnonzero(asks & ~own & wants), least, k)
    o, n, v = (np.concatenate(c) for c in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *found, strict=True))
    order = np.argsort(o, kind="stable")
    return o[order], n[order], v[order]


def _search_classes(ids: np.ndarray, same: np.ndarray, codes: np.ndarray, scale: np.ndarray, own: np.ndarray, asks: np.ndarray, wants: np.ndarray, least: float, k: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """As ``_search``, with equal vectors (equal ``same``) searched once for all of them.

    The ``k`` nearest classes hold the ``k`` nearest rows of each member, together with the copies of its own class;
    of a class only the ``k + 1`` smallest identifiers can be among them.
    """
    order = np.lexsort((ids, same))
    order = order[np.r_[True, (same[order][1:] != same[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
    begins = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
    if len(begins) == len(ids):
        return _search(ids, codes, scale, own, asks, wants, least, k, keep)
    ends = np.r_[begins[1:], len(order)]
    rep = order[begins]
    any_of = lambda flag: np.bitwise_or.reduceat(flag[order], begins)
    met = _search(np.arange(len(rep)), codes[rep], scale[rep], any_of(own), any_of(asks), any_of(wants), least, k, keep)
    if met is None:
        return None
    several = np.flatnonzero(ends - begins > 1)
    itself = (codes[rep[several]].astype(np.float32) ** 2).sum(1) * scale[rep[several]] ** 2
    c, o, s = np.r_[met[0], several].astype(np.int64), np.r_[met[1], several].astype(np.int64), np.r_[met[2], itself].astype(np.float32)
    # members of the asking class, then the first identifiers of the class it met
    n = ends[c] - begins[c]
    row = order[np.repeat(begins[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    o, s = np.repeat(o, n), np.repeat(s, n)
    asking = asks[row] | wants[row]
    row, o, s = row[asking], o[asking], s[asking]
    n = np.minimum(ends[o] - begins[o], k + 1)
    other = ids[order[np.repeat(begins[o] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
    owner, s = np.repeat(ids[row], n), np.repeat(s, n)
    fine = (owner != other) & (s >= least)
    owner, other, s = owner[fine], other[fine], s[fine]
    best = _best(owner, other, s, k)
    return owner[best], other[best], s[best]


def valid_vector(column: str, dim: int) -> Column:
    """Full length, only finite numbers and not only zeros."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def nearest(
    df: DataFrame,
    identifier: str,
    vector: str,
    dim: int,
    k: int = 5,
    least: float = 0.0,
    width: float = 2.0,
    far: float = 1.41,
    tables: int = 2,
    bucket: int = 2000,
    queries: Column | None = None,
    seed: int = 7,
    probes: int | None = None,
    keep: int | None = None,
) -> DataFrame:
    """The ``k`` most similar other vectors of every query with at least ``least`` similarity.

    Cosine similarity; equal ones in order of the smaller identifier. ``queries`` restricts
    who asks (all rows by default); every row can be found. Rows whose vector is not
    valid (see ``valid_vector``) or whose identifier is null take no part; identifiers must be
    longs, and of repeated ones one stands for all. ``width`` is the cell width, ``far`` the distance of
    unrelated unit vectors and ``bucket`` the bucket size from which the number of projections
    follows; ``probes`` is the number of other buckets that a query looks into, by default few more than
    projections. ``keep`` bounds the candidates that the codes may leave a query in a bucket (8 k by default); a
    bucket with a query of more is searched again on full vectors, so no candidate is lost, and with 0 all
    are. Equal vectors are searched once for all. The queries of buckets four times as full are shared
    out to several tasks, those of buckets 64 times as full meet its vectors in blocks; both only divide
    the work, each query still meets the whole bucket. The result is
    approximate: what never shares a bucket isn't found (see the README for measured recall).
    Result: ``identifier, neighbour, similarity, place``.
    """
    rows = df.filter(F.col(identifier).isNotNull() & valid_vector(vector, dim))
    asks = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    rows = rows.select(F.col(identifier).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), asks.alias("asks"))
    rows = rows.withColumn("same", F.xxhash64("v"))
    keep = 8 * k if keep is None else keep
    size = rows.count()
    plan = Plan(dim, size, width, far, bucket, tables, seed, probes)

    def unit_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(batch.column("v"), dim)
        return batch.column("id").to_numpy(), _unit(x), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for key in plan.own(unit_rows(batch)[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["bucket"])

    sizes = rows.mapInArrow(measure, "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    hot, vast = {}, []
    for r in sizes.filter(F.col("n") > 4 * bucket).collect():  # at most size x tables / (4 x bucket) rows
        if r.n > 64 * bucket:
            hot[r.bucket] = (math.ceil(r.n / (32 * bucket)),) * 2
            vast.append(r.bucket)
        else:
            hot[r.bucket] = (math.ceil(r.n / (4 * bucket)), 1)

    def place(only: np.ndarray | None) -> DataFrame:
        """What each bucket gets: codes, or full vectors for the buckets in ``only``; vast buckets get only these."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, unit, probing = unit_rows(batch)
                codes, scale = _codes(unit)
                same = batch.column("same").to_numpy()
                sent = codes if only is None else _matrix(batch.column("v"), dim).astype(np.float32)
                for key, part, at, own, asks, wants in plan.buckets(ids, unit, probing, hot):
                    if only is not None or vast:
                        here = np.isin(key, vast, invert=True) if only is None else np.isin(key, only)
                        key, part, at, own, asks, wants = key[here], part[here], at[here], own[here], asks[here], wants[here]
                    if len(at):
                        data = pa.Array.from_buffers(pa.binary(sent.itemsize * dim), len(at), [None, pa.py_buffer(np.ascontiguousarray(sent[at]))]).cast(pa.binary())
                        columns = [pa.array(key), pa.array(part), pa.array(ids[at]), pa.array(same[at]), data, pa.array(scale[at]), pa.array(own), pa.array(asks), pa.array(wants)]
                        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "id", "same", "data", "scale", "own", "asks", "wants"])

        return rows.mapInArrow(spread, "bucket long, part int, id long, same long, data binary, scale float, own boolean, asks boolean, wants boolean").groupBy("bucket", "part")

    lists = "bucket long, id long, others array<long>, sims array<float>"

    def search(full: bool):
        def of_bucket(table: pa.Table) -> pa.Table:
            ids, same, scale, *flags = (table.column(c).to_numpy() for c in ("id", "same", "scale", "own", "asks", "wants"))
            own, asks, wants = (f.astype(bool) for f in flags)
            kind = np.dtype(np.float32 if full else np.int8)
            flat = np.concatenate([np.frombuffer(c.buffers()[2], dtype=kind, count=len(c) * dim, offset=np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset]) for c in table.column("data").chunks if len(c)]).reshape(-1, dim)
            if full:
                met = _exact(ids, flat, own, asks, wants, least, k)
            else:
                met = _search_classes(ids, same, flat, scale, own, asks, wants, least - _CODE_ERROR, k, keep)
            bucket = table.column("bucket")[0].as_py()
            if met is None:  # a row without a query asks for the full vectors
                return pa.table({"bucket": pa.array([bucket], pa.int64()), "id": pa.array([None], pa.int64()), "others": pa.array([None], pa.list_(pa.int64())), "sims": pa.array([None], pa.list_(pa.float32()))})
            q, x, s = met
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
            ends = pa.array(np.r_[start, len(q)].astype(np.int32))
            return pa.table({"bucket": pa.array(np.full(len(start), bucket, dtype=np.int64)), "id": pa.array(q[start]), "others": pa.ListArray.from_arrays(ends, pa.array(x)), "sims": pa.ListArray.from_arrays(ends, pa.array(s.astype(np.float32)))})

        return of_bucket

    met = materialize(place(None).applyInArrow(search(False), lists), "met")
    again = np.array(vast + [r.bucket for r in met.filter("id is null").select("bucket").distinct().collect()], dtype=np.int64)  # each with more than 8k rows
    if len(again):
        met = met.join(F.broadcast(met.filter("id is null").select("bucket").distinct()), "bucket", "left_anti").unionByName(place(again).applyInArrow(search(True), lists))
    pooled = met.select("id", "others", "sims").repartition("id").select("id", F.explode(F.arrays_zip("others", "sims")).alias("e"))
    once = pooled.groupBy("id", F.col("e.others").alias("other")).agg(F.min(-F.col("e.sims")).alias("far"))
    first = once.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("far", "other"))).alias("best"))
    edge = F.coalesce(F.try_element_at("best", F.lit(k))["far"], F.lit(float("inf"))) + 2 * _CODE_ERROR
    directed = first.select("id", edge.alias("edge"), F.explode("best").alias("b")).filter(F.col("b.far") <= F.col("edge")).select("id", F.col("b.other").alias("other"))
    pairs = directed.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max(F.col("id") < F.col("other")).alias("from_a"), F.max(F.col("id") > F.col("other")).alias("from_b"))
    pairs = materialize(pairs, "candidates")
    vectors = rows.select("id", "v").dropDuplicates(["id"])
    both = pairs.join(vectors.withColumnsRenamed({"id": "a", "v": "va"}), "a").join(vectors.withColumnsRenamed({"id": "b", "v": "vb"}), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column("va"), dim), _matrix(batch.column("vb"), dim)
            s = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "from_a", "from_b")), pa.array(np.clip(s, -1, 1))], names=["a", "b", "from_a", "from_b", "similarity"])

    known = both.select("a", "b", "from_a", "from_b", "va", "vb").mapInArrow(exact, "a long, b long, from_a boolean, from_b boolean, similarity double").filter(F.col("similarity") >= least)
    ways = F.filter(F.array(F.struct(F.col("from_a").alias("ok"), F.col("a").alias("id"), F.col("b").alias("neighbour")), F.struct(F.col("from_b").alias("ok"), F.col("b").alias("id"), F.col("a").alias("neighbour"))), lambda e: e["ok"])
    directions = known.select(F.explode(ways).alias("w"), "similarity").select("w.id", "w.neighbour", "similarity")
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")  # of a query at most ``keep`` candidates a bucket it came to
    return directions.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(F.col("id").alias(identifier), "neighbour", "similarity", "place")


def similar_pairs(neighbours: DataFrame, identifier: str) -> DataFrame:
    """Pairs ``id_a < id_b`` of which one is among the nearest of the other."""
    return neighbours.select(F.least(identifier, "neighbour").alias("id_a"), F.greatest(identifier, "neighbour").alias("id_b")).distinct()


def face_neighbours(faces: DataFrame, k: int = 5, least: float = 0.7, queries: Column | None = None) -> DataFrame:
    return nearest(faces, "id", "embedding", 128, k, least, width=2.0, far=1.41, tables=2, queries=queries)


def photo_neighbours(photos: DataFrame, k: int = 5, least: float = 0.99, queries: Column | None = None) -> DataFrame:
    """Cells are narrower, as only vectors within a distance of about 0.14 are asked for."""
    return nearest(photos, "id", "visual_features", 64, k, least, width=0.6, far=1.18, tables=2, queries=queries)


def face_nearest(faces: DataFrame, k: int = 5, queries: Column | None = None) -> DataFrame:
    """However far they are. Strangers are nearly at right angles, so faces alone in the collection need many probes."""
    return nearest(faces, "id", "embedding", 128, k, -1.0, width=2.0, far=1.41, tables=2, queries=queries, probes=60)


def photo_nearest(photos: DataFrame, k: int = 5, queries: Column | None = None) -> DataFrame:
    """However far they are: mostly at a distance of 0.8, where all are at 1.2, so most buckets must be looked into."""
    return nearest(photos, "id", "visual_features", 64, k, -1.0, width=2.0, far=1.18, tables=2, queries=queries, probes=200)
