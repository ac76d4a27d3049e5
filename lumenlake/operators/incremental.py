"""Processing only new or changed records.

A source has a column that grows with every committed row (a commit sequence).
A run reads the watermark of the last successful run, fixes an upper bound when
it starts, and processes exactly the rows between the two. Its output and its new
watermark become visible together, when one small commit file is renamed into
place: a run that fails before that leaves the watermark where it was, and its
output, which no commit names, is never read and is removed by a later run. Of two runs that
start from the same watermark only one can take the next commit number.

A run opens the last commit only. What it must know of earlier windows is in a state table cut into
buckets by key; a commit names the files of each bucket, and a run reads and writes anew only the buckets that its
window touches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.shared import materialize


class CommitConflict(RuntimeError):
    """Another run has committed since this one began."""


class CommitLog:
    """Numbered commit files below ``root``; each names the outputs and the watermark of a run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._dir = self._path(f"{self.root}/_commits")
        self._fs = self._dir.getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def numbers(self) -> list[int]:
        """The numbers of all commits, from the names of their files."""
        if not self._fs.exists(self._dir):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._dir))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{number:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        """The last commit; None before the first."""
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def commits(self) -> list[dict]:
        """All commits in order."""
        return [self.read(n) for n in self.numbers()]

    def clean(self, upto: int) -> int:
        """Remove what runs that lost or failed have left below commit ``upto``; returns how many folders.

        Where several folders have one number, all but the one its commit names go.
        """
        runs = self._path(f"{self.root}/runs")
        if not self._fs.exists(runs):
            return 0
        folders: dict[int, list[str]] = {}
        for s in self._fs.listStatus(runs):
            name = s.getPath().getName()
            folders.setdefault(int(name.split("-")[0]), []).append(name)
        gone = 0
        for number, names in folders.items():
            if number <= upto and len(names) > 1:
                keep = self.read(number).get("run")
                for name in names:
                    if name != keep:
                        self._fs.delete(self._path(f"{self.root}/runs/{name}"), True)
                        gone += 1
        return gone

    def add(self, number: int, content: dict) -> None:
        """Write commit ``number`` in one step; fails if it is there already."""
        self._fs.mkdirs(self._dir)
        draft = self._path(f"{self.root}/_commits/.{number:010d}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._dir.toUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            files.rename(draft, self._path(f"{self.root}/_commits/{number:010d}.json"), kinds)
        except Exception as e:
            self._fs.delete(draft, False)
            raise CommitConflict(f"commit {number} exists already") from e

    def outputs(self, name: str, commits: list[dict] | None = None) -> DataFrame | None:
        """The rows that committed runs have written under ``name``; None if there are none."""
        paths = [c["outputs"][name] for c in (self.commits() if commits is None else commits) if name in c["outputs"]]
        return self.spark.read.parquet(*paths) if paths else None


def run_increment(
    log: CommitLog,
    source: DataFrame,
    sequence: str,
    process: Callable[[DataFrame, dict | None, Callable[..., DataFrame]], dict | None],
    upper: int | None = None,
) -> dict:
    """Process the rows of ``source`` beyond the watermark, up to a bound fixed now.

    ``process(rows, last, write)`` gets the window's rows and the last commit (None at first) and calls
    ``write(name, df)`` for each output; ``write`` returns what was written. What it returns is the
    commit's ``state``. Rows whose sequence is null are in no window. Without new rows ``process`` still
    runs (work left undone may be due) and the watermark stays. ``upper`` lowers
    the bound, never raises it. Only rows beyond the watermark are asked for, so files and row groups of
    earlier windows are skipped by their statistics. Returns the commit.
    """
    last = log.last()
    low = last["watermark"] if last else None
    fresh = source if low is None else source.filter(F.col(sequence) > low)
    top = fresh.agg(F.max(sequence)).first()[0]
    bounds = [b for b in (top, upper) if b is not None]
    high = min(bounds) if top is not None else low
    if low is not None and (high is None or high < low):
        high = low
    rows = fresh.filter(F.col(sequence) <= high if high is not None else F.lit(False))
    number, outputs = last["number"] + 1 if last else 0, {}
    run = f"{number:010d}-{uuid.uuid4().hex[:12]}"

    def write(name: str, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        (df.write.partitionBy(*by) if by else df.write).parquet(path := write.path(name))
        outputs[name] = path
        return log.spark.read.schema(df.schema).parquet(path)

    write.path = lambda name: f"{log.root}/runs/{run}/{name}"
    state = process(rows, last, write)
    commit = {"number": number, "run": run, "low": low, "watermark": high, "outputs": outputs, "state": state}
    log.add(number, commit)
    log.clean(number)
    return commit


def latest_rows(df: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """Of each non-null ``key`` the row that is last in ``order`` (nulls first)."""
    newest = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_last")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[F.col(f"_last.{c}") for c in dict.fromkeys([*order, *values])])


class _KeyedState:
    """A table with a row per key in buckets, each in the folder of the run that wrote it last."""

    def __init__(self, log: CommitLog, state: dict | None, schema: str, key: str, rows_per_bucket: int):
        self.log, self.schema, self.key, self.per = log, schema, key, rows_per_bucket
        self.buckets, self.rows, self.runs = (state["buckets"], state["rows"], state["runs"]) if state else (0, 0, {})

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the buckets in ``only`` (of all if None)."""
        paths = [f"{run}/bucket={b}" for run, mine in self.runs.items() for b in mine if only is None or b in set(only)]
        if not paths:
            return self.log.spark.createDataFrame([], self.schema)
        return self.log.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys`` that have rows."""
        have = {b for mine in self.runs.values() for b in mine}
        if not have:
            return []
        return [r.b for r in keys.select(self.bucket(self.buckets).alias("b")).distinct().collect() if r.b in have]

    def merged(self, fresh: DataFrame, latest: Callable[[DataFrame], DataFrame], write: Callable[..., DataFrame]) -> dict:
        """Write the buckets that ``fresh`` (a row per key) touches, merged with their rows; returns the state for the commit.

        When the table has outgrown its buckets four times, all are written anew into more of them.
        """
        count = fresh.count()
        want = max(1, -(-(self.rows + count) // self.per))
        anew = self.buckets == 0 or want > 4 * self.buckets
        buckets = want if anew else self.buckets
        if not count and not anew:
            return {"buckets": self.buckets, "rows": self.rows, "runs": self.runs}
        old = None if anew else self.touched(fresh)
        before = self.read(old)
        table = latest(before.unionByName(fresh)) if self.runs else fresh
        table = table.withColumn("bucket", self.bucket(buckets))
        write("state", table.repartition("bucket") if buckets > 1 else table.coalesce(1), by=["bucket"])
        return {"buckets": buckets, "anew": anew}

    def commit(self, path: str, plan: dict) -> dict:
        """The commit's state after ``merged`` has written to ``path``."""
        if "anew" not in plan:
            return plan
        jvm, fs = self.log._jvm, self.log._fs
        written = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if "=" in s.getPath().getName())
        runs = {} if plan["anew"] else {run: left for run, mine in self.runs.items() if (left := [b for b in mine if b not in set(written)])}
        replaced = [b for mine in self.runs.values() for b in mine if plan["anew"] or b in set(written)]
        rows = self.log.spark.read.schema(self.schema).parquet(path).count() + self.rows - (self.read(None if plan["anew"] else replaced).count() if replaced else 0)
        return {"buckets": plan["buckets"], "rows": rows, "runs": runs | {path: written}}


def changed_files(
    log: CommitLog,
    entries: DataFrame,
    photos: DataFrame,
    tolerance: float = 0.001,
    current_version: int = 1,
    max_attempts: int = 3,
    upper: int | None = None,
    rows_per_bucket: int = 200_000,
) -> DataFrame:
    """Files the next run has to analyse, from the listing rows since the last run.

    Of each path only the row listed last counts (then the highest entry_id), over
    this and all earlier windows, so a late row of an older listing changes nothing.
    A path is due if ``photos`` has no such path, if its size differs, if its
    modification time differs by more than ``tolerance`` seconds (null differs from
    a value; NaN from all but NaN), or if its photo was left undone: version below
    ``current_version`` and fewer than ``max_attempts`` attempts. Paths whose rows all
    lie in earlier windows come again only while left undone. Null paths are no files;
    of a path that several photos share, one due photo makes it due. The latest row of each path is kept in a
    state of about ``rows_per_bucket`` rows a bucket. Result:
    ``relative_path, reason`` of this run, from its committed output.
    """
    columns = ["relative_path", "listed_at", "entry_id", "size_bytes", "source_mtime"]
    known = photos.filter(F.col("relative_path").isNotNull()).select(
        "relative_path", F.col("size_bytes").alias("_size"), F.col("source_mtime").alias("_mtime"),
        (F.coalesce(F.col("analysis_version") < current_version, F.lit(True)) & F.coalesce(F.col("analysis_attempts") < max_attempts, F.lit(True))).alias("_undone"),
    )

    kept = "relative_path string, listed_at timestamp_ntz, entry_id long, size_bytes long, source_mtime double"
    latest = lambda df: latest_rows(df.select(*columns), columns[0], columns[3:], columns[1:3])

    def process(rows: DataFrame, last: dict | None, write: Callable[..., DataFrame]) -> dict:
        state = _KeyedState(log, last and last["state"], kept, "relative_path", rows_per_bucket)
        typed = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in kept.split(", ")])
        newest = materialize(latest(typed), "newest")
        plan = state.merged(newest, latest, write)
        if state.runs:
            due = newest.select("relative_path").unionByName(known.filter("_undone").select("relative_path"))
            prior = state.read(state.touched(due)).join(due.distinct(), "relative_path", "left_semi")
            newest = latest(newest.unionByName(prior))
        apart = F.abs(F.col("source_mtime") - F.col("_mtime")) > tolerance
        same_nan = F.isnan("source_mtime") & F.isnan("_mtime")
        moved = F.when(F.col("source_mtime").isNull() | F.col("_mtime").isNull(), ~F.col("source_mtime").eqNullSafe(F.col("_mtime"))).otherwise(apart & ~same_nan)
        reason = (
            F.when(F.col("_undone").isNull(), "new")
            .when(~F.col("size_bytes").eqNullSafe(F.col("_size")) | moved, "changed")
            .when(F.col("_undone"), "undone")
        )
        cases = newest.join(known, "relative_path", "left").select("relative_path", reason.alias("reason")).filter("reason is not null")
        write("cases", cases.groupBy("relative_path").agg(F.min("reason").alias("reason")))
        return state.commit(write.path("state"), plan)

    commit = run_increment(log, entries, "entry_id", process, upper)
    return log.spark.read.parquet(commit["outputs"]["cases"])
