"""Read-only photo sources: a listing as a Spark data source, and hashed copies.

The listing's partitions are directories, found breadth first down to a depth, so that
executors walk a tree in parallel. Symbolic links are never followed; skipped directories
and suffixes are compared without case. What can't be read becomes a row with ``warning``
set, so a scan knows whether it was clean.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenlake.config import Settings
from lumenlake.shared import drop

T = TypeVar("T")
LISTING = "relative_path string, file_name string, extension string, size_bytes long, source_mtime double, warning string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class SourceError(OSError):
    """A source stayed unreachable after all attempts."""


class LocalTree:
    """A directory tree that is mounted where the workers run."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)

    def _at(self, path: str) -> str:
        return os.path.join(self.root, *path.split("/")) if path else self.root

    def scan(self, folder: str) -> list:
        with os.scandir(self._at(folder)) as entries:
            return list(entries)

    def open(self, path: str) -> BinaryIO:
        return open(self._at(path), "rb")

    def steadily(self, task: Callable[[], T], label: str) -> T:
        return task()


class ShareTree:
    """A tree on a network share, by way of a client library with the interface of ``smbclient``.

    What fails is tried again, up to ``attempts`` times in all, after 1, 2, 4 and at most 8 seconds, each time
    with a new and again authenticated connection. ``client`` and ``wait`` can be given for tests; in workers
    the library is imported at first use.
    """

    def __init__(self, server: str, share: str, user: str = "", password: str = "", folder: str = "", attempts: int = 4, client: object = None, wait: Callable[[float], None] = time.sleep):
        self.root = "\\\\" + "\\".join([server, share, *[p for p in folder.replace("/", "\\").split("\\") if p]])
        self.server, self.user, self.password, self.attempts, self.wait = server, user, password, attempts, wait
        self._client, self._known = client, False

    def _connect(self) -> object:
        if self._client is None:
            import smbclient

            self._client = smbclient
        if not self._known:
            self._client.register_session(self.server, username=self.user or None, password=self.password or None)
            self._known = True
        return self._client

    def _at(self, path: str) -> str:
        return "\\".join([self.root, *path.split("/")]) if path else self.root

    def steadily(self, task: Callable[[], T], label: str) -> T:
        error: Exception | None = None
        for turn in range(self.attempts):
            if turn:
                self.wait(min(2 ** (turn - 1), 8))
                self._known = False
                with contextlib.suppress(Exception):
                    self._client.reset_connection_cache(fail_on_error=False)
            try:
                return task()
            except TooLarge:
                raise
            except Exception as e:  # the library has several kinds of transport errors
                error = e
        raise SourceError(f"{label} failed after {self.attempts} attempts: {error}")

    def scan(self, folder: str) -> list:
        def entries() -> list:
            with self._connect().scandir(self._at(folder)) as found:
                return [e for e in found if e.name not in (".", "..")]

        return self.steadily(entries, f"listing {folder or '/'}")

    def open(self, path: str) -> BinaryIO:
        return self._connect().open_file(self._at(path), mode="rb")


def tree_of(options: dict[str, str]) -> LocalTree | ShareTree:
    """The tree that options name: ``source`` local (the default) with ``root``, or smb with ``server`` and ``share``."""
    kind = options.get("source", "local").lower()
    if kind == "local":
        if not options.get("root"):
            raise ValueError("a local source needs a root")
        return LocalTree(options["root"])
    if kind == "smb":
        missing = [k for k in ("server", "share") if not options.get(k)]
        if missing:
            raise ValueError(f"a network share needs {' and '.join(missing)}")
        return ShareTree(options["server"], options["share"], options.get("user", ""), options.get("password", ""), options.get("folder", ""))
    raise ValueError(f"unknown source {kind}")


class _Walk:
    """Lists one directory, or all below it."""

    def __init__(self, tree: LocalTree | ShareTree, skipped: set[str], suffixes: set[str]):
        self.tree, self.skipped, self.suffixes = tree, skipped, suffixes

    def one(self, folder: str) -> tuple[list[str], list[tuple]]:
        below, rows = [], []
        try:
            entries = sorted(self.tree.scan(folder), key=lambda e: e.name.casefold())
        except OSError as e:
            return [], [(folder, None, None, None, None, f"{type(e).__name__}: can't list")]
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            try:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name.casefold() not in self.skipped:
                        below.append(path)
                elif e.is_file(follow_symlinks=False) and (suffix := Path(e.name).suffix.lower()) in self.suffixes:
                    stat = e.stat(follow_symlinks=False)
                    rows.append((path, e.name, suffix, int(stat.st_size), float(stat.st_mtime), None))
            except OSError as error:
                rows.append((path, None, None, None, None, f"{type(error).__name__}: can't read"))
        return below, rows

    def all(self, folder: str) -> Iterator[tuple]:
        stack = [folder]
        while stack:
            below, rows = self.one(stack.pop())
            yield from rows
            stack += reversed(below)


class _Reader(DataSourceReader):
    def __init__(self, walk: _Walk, depth: int):
        self.walk, self.depth = walk, depth

    def partitions(self) -> list[InputPartition]:
        level, out = [""], []
        for _ in range(self.depth):
            out += [_Folder(p, False) for p in level]
            level = [b for p in level for b in self.walk.one(p)[0]]
        return out + [_Folder(p, True) for p in level] or [_Folder("", True)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        yield from self.walk.all(partition.path) if partition.deep else self.walk.one(partition.path)[1]


class PhotoListing(DataSource):
    """``spark.read.format("photo_listing").option("root", ...)``; options of ``tree_of``, and skipped, suffixes (comma lists) and depth."""

    @classmethod
    def name(cls) -> str:
        return "photo_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        o, s = self.options, Settings()
        skipped = {d.casefold() for d in o["skipped"].split(",")} if "skipped" in o else set(s.skipped)
        suffixes = {x.lower() if x.startswith(".") else f".{x.lower()}" for x in o["suffixes"].split(",")} if "suffixes" in o else set(s.suffixes)
        return _Reader(_Walk(tree_of(o), skipped, suffixes), int(o.get("depth", "1")))


def list_photos(spark: SparkSession, root: str | dict[str, str], settings: Settings = Settings(), depth: int = 1) -> DataFrame:
    """Files below ``root`` (a local folder, or options of ``tree_of``) and warnings; ``scan_max_files`` bounds the files if it isn't 0."""
    spark.dataSource.register(PhotoListing)
    options = {"root": root} if isinstance(root, str) else dict(root)
    tree_of(options)
    options |= {"skipped": ",".join(settings.skip_directories), "suffixes": ",".join(settings.supported_extensions), "depth": str(depth)}
    rows = spark.read.format("photo_listing").options(**options).load()
    return rows.orderBy("relative_path").limit(settings.scan_max_files) if settings.scan_max_files else rows


def listing_is_clean(listing: DataFrame) -> bool:
    return listing.filter("warning is not null").isEmpty()


def probe(source: str | dict[str, str] | LocalTree | ShareTree) -> str:
    """Whether a source answers: its first folder is listed, no more."""
    tree = tree_of({"root": source} if isinstance(source, str) else source) if isinstance(source, (str, dict)) else source
    tree.scan("")
    return "ok"


def path_statistics(spark: SparkSession, root: str) -> DataFrame:
    """One row ``files, bytes, readable`` about all files below a folder, such as a cache of derivatives.

    File contents aren't read. A folder that can't be read has 0 files.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    readable = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if not readable:
        return spark.createDataFrame([(0, 0, False)], "files long, bytes long, readable boolean")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.lit(True).alias("readable"))


def hashed_contents(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """``relative_path, size_bytes, file_hash`` of supported files within the size limit.

    The limit is checked before any content is read; too large files have a null hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = os.path.realpath(root).rstrip("/") + "/"
    path: Column = F.substring_index(F.col("path"), base, -1)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(sorted(settings.suffixes))
    most = settings.max_file_mb * 1024 * 1024
    small = files.filter(wanted & (F.col("length") <= most)).select(path.alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_hash"))
    large = files.filter(wanted & (F.col("length") > most)).select(path.alias("relative_path"), F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("file_hash"))
    return small.unionByName(large)


def safe_relative_path(path: str) -> str:
    """The path without empty and ``.`` parts; absolute ones and ``..`` are refused."""
    parts = path.replace("\\", "/").split("/")
    if parts[0] == "" and len(parts) > 1 or ".." in parts:
        raise ValueError("a path must stay below the root")
    return "/".join(p for p in parts if p not in ("", "."))


class TooLarge(ValueError):
    """A file exceeds the size that may be copied."""


def copy_and_hash(source: str | LocalTree | ShareTree, relative_path: str, target: str, most_bytes: int, chunk: int = 1 << 20) -> tuple[str, int]:
    """Copy a source file in chunks and return its SHA-256 and size; too large ones leave nothing behind.

    On a network share a copy that breaks off is begun anew; too large files aren't tried again.
    """
    tree, path, part = LocalTree(source) if isinstance(source, str) else source, safe_relative_path(relative_path), f"{target}.part"
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)

    def copy() -> tuple[str, int]:
        digest, total = hashlib.sha256(), 0
        with tree.open(path) as f, open(part, "wb") as out:
            while piece := f.read(chunk):
                total += len(piece)
                if total > most_bytes:
                    raise TooLarge(f"the file exceeds {most_bytes} bytes")
                digest.update(piece)
                out.write(piece)
        return digest.hexdigest(), total

    try:
        copied = tree.steadily(copy, f"copying {path}")
        os.replace(part, target)
    except BaseException:
        if os.path.exists(part):
            os.unlink(part)
        raise
    return copied


def export_manifest(rows: DataFrame, path: str) -> str:
    """Write a manifest as one CSV file with a header below ``path``; a manifest is one collection's."""
    drop(rows.sparkSession, path)
    rows.coalesce(1).write.option("header", True).option("quoteAll", False).option("emptyValue", "").csv(path)
    return path
