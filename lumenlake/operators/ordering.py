"""Exact positions and ranks in groups of any size.

A window function puts a whole group into one task. Here rows are sorted
globally by range partitioning instead, so that a group of any size is cut into
as many partitions as it needs; each partition then only has to know how far the
group it begins with has already come. That takes one summary row per partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.shared import checkpointed, shuffle_partitions

PID = "_pid"


def range_sorted(df: DataFrame, keys: list[Column], partitions: int | None = None) -> DataFrame:
    """Globally sorted copy of ``df``, kept in the shared folder, with its partition number."""
    n = partitions or shuffle_partitions(df.sparkSession)
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return checkpointed(out.withColumn(PID, F.spark_partition_id()))


def ordered_scan(
    ordered: DataFrame,
    summarise: Callable[[Iterator[pa.RecordBatch]], dict],
    combine: Callable[[list[dict]], list],
    emit: Callable[[Iterator[pa.RecordBatch], object], Iterator[pa.RecordBatch]],
    schema: T.StructType,
) -> DataFrame:
    """Scan a globally sorted table with a state that crosses partition borders.

    ``summarise`` boils a partition down to a small dict, ``combine`` turns the
    dicts (in partition order) into the state each partition begins with, and
    ``emit`` streams through a partition from that state. The driver sees one
    dict per partition: its load follows the number of partitions, not of rows.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        pid = first.column(PID)[0].as_py()

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from (b for b in batches if b.num_rows)

        said = pickle.dumps(summarise(all_batches()))
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "said": pa.array([said], pa.binary())})

    rows = sorted(ordered.mapInArrow(summaries, "pid int, said binary").collect())
    carries = dict(zip([r.pid for r in rows], combine([pickle.loads(bytes(r.said)) for r in rows]), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from (b for b in batches if b.num_rows)

        yield from emit(all_batches(), carries[first.column(PID)[0].as_py()])

    return ordered.mapInArrow(run, schema)


def _differs(column: pa.Array, previous: object, known: bool) -> np.ndarray:
    """For each value whether it differs from the one before it; null equals null."""
    n = len(column)
    out = np.ones(n, dtype=bool)
    if n > 1:
        a, b = column[1:], column[:-1]
        ne = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out[1:] = ne | nulls
    if known:
        out[0] = column[0].as_py() != previous
    return out


class _Positions:
    """State of the scan: the current group, its rows so far, the current tie and where it began."""

    def __init__(self, group: list[str], tie: list[str], position: str, rank: str, limit: int | None):
        self.group, self.tie, self.position, self.rank, self.limit = group, tie, position, rank, limit

    def _keys(self, batch: pa.RecordBatch, names: list[str], row: int) -> tuple:
        return tuple(batch.column(n)[row].as_py() for n in names)

    def _changes(self, batch: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        def any_of(names: list[str], at: int) -> np.ndarray:
            out = np.zeros(batch.num_rows, dtype=bool)
            for k, n in enumerate(names):
                out |= _differs(batch.column(n), last[at + k] if last else None, last is not None)
            return out

        new_group = any_of(self.group, 0) if self.group else np.zeros(batch.num_rows, dtype=bool)
        return new_group, new_group | (any_of(self.tie, len(self.group)) if self.tie else True)

    def summarise(self, batches: Iterator[pa.RecordBatch]) -> dict:
        seen, last, group_at, tie_at, first = 0, None, 0, 0, None
        for b in batches:
            if first is None:
                first = self._keys(b, self.group + self.tie, 0)
                last = first
            new_group, new_tie = self._changes(b, last)
            if seen == 0 and not self.tie:
                new_tie[0] = False
            if (at := np.flatnonzero(new_group)).size:
                group_at = seen + int(at[-1])
            if (at := np.flatnonzero(new_tie)).size:
                tie_at = seen + int(at[-1])
            last = self._keys(b, self.group + self.tie, b.num_rows - 1)
            seen += b.num_rows
        return {"n": seen, "first": first, "last": last, "group_at": group_at, "tie_at": tie_at}

    def combine(self, parts: list[dict]) -> list:
        out, keys, rows, tie_from, g = [], None, 0, 0, len(self.group)
        for p in parts:
            out.append((keys, rows, tie_from))
            goes_on = keys is not None and keys[:g] == p["first"][:g]
            tied = bool(self.tie) and goes_on and keys == p["first"]
            base = rows if goes_on else 0
            start = base if p["group_at"] == 0 else -p["group_at"]
            if p["tie_at"] == 0:
                tie_from = tie_from if tied else base + 1
            else:
                tie_from = start + p["tie_at"] + 1
            rows, keys = start + p["n"], p["last"]
        return out

    def emit(self, batches: Iterator[pa.RecordBatch], carry: tuple) -> Iterator[pa.RecordBatch]:
        last, rows, tie_from = carry
        for b in batches:
            n = b.num_rows
            new_group, new_tie = self._changes(b, last)
            if last is None:
                new_group[0] = new_tie[0] = True
            at = np.arange(n, dtype=np.int64)
            start = np.maximum.accumulate(np.where(new_group, at, -1))
            position = np.where(start >= 0, at - start + 1, rows + at + 1)
            tie = np.maximum.accumulate(np.where(new_tie, at, -1))
            rank = np.where(tie >= 0, position[np.maximum(tie, 0)], tie_from)
            last = self._keys(b, self.group + self.tie, n - 1)
            rows, tie_from = int(position[-1]), int(rank[-1])
            names = [x for x in b.schema.names if x != PID]
            columns = [b.column(x) for x in names] + [pa.array(position), pa.array(rank)]
            out = pa.RecordBatch.from_arrays(columns, names=[*names, self.position, self.rank])
            if self.limit is not None:
                out = out.filter(pa.array(position <= self.limit))
            if out.num_rows:
                yield out


def global_positions(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    tie: list[str],
    position: str = "position",
    rank: str = "rank",
    limit: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add to each row its position in its group and the rank its tie shares.

    ``order`` sorts the rows of a group and must be total for a repeatable result;
    rows that agree in ``tie`` must stand next to each other in that order and get
    the position of the first of them as rank. ``limit`` keeps positions up to it.
    Null is a group and a tie value like any other. Doubles in ``group`` or ``tie``
    must not be NaN.
    """
    ordered = range_sorted(df, [F.col(g) for g in group] + order, partitions)
    scan = _Positions(group, tie, position, rank, limit)
    schema = T.StructType([*df.schema.fields, T.StructField(position, T.LongType()), T.StructField(rank, T.LongType())])
    return ordered_scan(ordered, scan.summarise, scan.combine, scan.emit, schema)


class _Segments:
    """State of the scan that numbers runs of rows: the last row so far and the runs before it."""

    def __init__(self, columns: list[str], cut: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray], name: str):
        self.columns, self.cut, self.name = columns, cut, name

    def _cuts(self, b: pa.RecordBatch, last: dict | None) -> tuple[np.ndarray, dict]:
        now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in self.columns}
        head = last or {c: v[0] for c, v in now.items()}
        before = {c: np.concatenate([[head[c]], v[:-1]]) for c, v in now.items()}
        cuts = np.asarray(self.cut(before, now), dtype=bool).copy()
        if last is None:
            cuts[0] = True
        return cuts, {c: v[-1] for c, v in now.items()}

    def summarise(self, batches: Iterator[pa.RecordBatch]) -> dict:
        first, last, n = None, None, 0
        for b in batches:
            if first is None:
                first = {c: b.column(c).to_numpy(zero_copy_only=False)[0] for c in self.columns}
                last = first
                cuts, last = self._cuts(b, last)
                cuts[0] = False
            else:
                cuts, last = self._cuts(b, last)
            n += int(cuts.sum())
        return {"first": first, "last": last, "cuts": n}

    def combine(self, parts: list[dict]) -> list:
        out, last, n = [], None, 0
        for p in parts:
            out.append((last, n))
            starts = last is None or bool(self.cut({c: np.array([v]) for c, v in last.items()}, {c: np.array([v]) for c, v in p["first"].items()})[0])
            n, last = n + p["cuts"] + int(starts), p["last"]
        return out

    def emit(self, batches: Iterator[pa.RecordBatch], carry: tuple) -> Iterator[pa.RecordBatch]:
        last, n = carry
        for b in batches:
            cuts, last = self._cuts(b, last)
            number = n + np.cumsum(cuts)
            n = int(number[-1])
            names = [x for x in b.schema.names if x != PID]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(number)], names=[*names, self.name])


def global_segments(df: DataFrame, order: list[Column], columns: list[str], cut: Callable[[dict, dict], np.ndarray], name: str = "segment", partitions: int | None = None) -> DataFrame:
    """Number the runs of a globally sorted table, in its order, from 1.

    ``cut(before, now)`` gets numpy arrays of ``columns`` for each row and the row before it
    and says where a new run begins. A run may cross any number of partitions.
    """
    scan = _Segments(columns, cut, name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    return ordered_scan(range_sorted(df, order, partitions), scan.summarise, scan.combine, scan.emit, schema)
