"""Near-duplicate records by a parity-sketch join.

A record is a set of tokens. XOR-hashing every token to one bit of a sketch that has fewer
bits than there are tokens gives a bit string whose Hamming distance to another sketch never
exceeds the symmetric difference of the two sets: a token in both sets flips nothing, any other
at most one bit. So all pairs within a distance come out of a pigeonhole join of sketches, and
a check of what meets. Sets whose sizes differ too much can't match, so the join has a
band of sizes in its key; a set near a band's border is a guest in the next band.

Two plans share this. ``set_pairs`` takes sets of any size and a least similarity: each band has
as many blocks of sketch bits as a pair may have differences, and some to spare, so that blocks
of a matching pair must agree. ``hash_pairs`` takes pairs of image hashes, sets of up to 128 tokens that
differ in few: four blocks, of which one may have a single error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.components import connected_components
from lumenlake.operators.joins import skew_join
from lumenlake.shared import materialize

_BLOCKS, _BLOCK_BITS = 4, 16
#: Ids of one class that stand in a row together when classes are spelled out as pairs.
_PAGE = 1000


# -- sketches ----------------------------------------------------------------------------


def parity_sketch(tokens: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketches, ``(sets, bits / 64)`` words, of sets laid end to end: set i begins at ``starts[i]``.

    A token's bit is drawn from a mix of its value, a 64-bit integer.
    """
    place = (_mixed(tokens) % np.uint64(bits)).astype(np.int64)
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(tokens)]))
    odd = np.bincount(of * bits + place, minlength=len(starts) * bits).astype(np.int64) & 1
    return np.packbits(odd.reshape(len(starts), bits).astype(np.uint8), axis=1, bitorder="little").view("<u8")


def _mixed(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = tokens.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)


# -- sets of tokens ------------------------------------------------------------------------


def size_bands(least: float, largest: int) -> list[tuple[int, int, int]]:
    """Bands ``(from, below, most)`` of set sizes; ``most`` bounds the differences of a pair that meets in the band.

    Sizes of a pair with a Jaccard similarity of at least ``least`` differ at most by that factor, so they
    lie in one band or in neighbouring ones, and then meet in the upper one.
    """
    out, at = [], 1
    while at <= largest:
        below = max(at + 1, math.ceil(at / least - 1e-9))
        out.append((at, below, math.floor((1 - least) / (1 + least) * 2 * (below - 1) + 1e-9)))
        at = below
    return out


def _block_keys(tokens: np.ndarray, blocks: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """``(block, key)`` of one set: the sketch of ``64 x blocks`` bits, a word a block.

    ``blocks`` exceeds the differences by ``spare`` + 1, so a matching pair agrees in so many blocks at least. Empty
    words, which far too many sets share, are left out up to ``spare`` of them, the first ones; the last
    empty word that a pair has in common is then still in both.
    """
    words = parity_sketch(tokens, np.zeros(1, dtype=np.int64), 64 * blocks)[0] if blocks else np.empty(0, np.uint64)
    empty = np.flatnonzero(words == 0)[:spare]
    block = np.delete(np.arange(blocks), empty)
    return block, words[block].view(np.int64)


def set_pairs(df: DataFrame, identifier: str, tokens: Column, least: float = 0.8, spare: int = 2, crowded: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """All pairs of different token sets with a Jaccard similarity of at least ``least``, and who has them.

    ``tokens`` is an array of longs; repeated tokens count once, null tokens don't. Rows with a null
    identifier or without tokens match nothing. Rows with equal sets are one class, named by its
    smallest identifier. Result: ``rep_a, rep_b, similarity`` (rep_a < rep_b) and the membership ``id, rep``.
    Complete for every ``least`` above 0. A set of n tokens goes to about 0.5 n keys at 0.8. Keys that more than
    ``crowded`` sets share are cut into parts, each pair of parts in a task of its own.
    """
    kind = df.schema[identifier].dataType.simpleString()
    clean = F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()).cast("array<long>")))
    rows = df.select(F.col(identifier).alias("id"), clean.alias("tokens")).filter("id is not null and size(tokens) > 0")
    rows = materialize(rows.select("id", "tokens", F.xxhash64("tokens").alias("_h")), "sets")
    classes = rows.groupBy("_h", "tokens").agg(F.min("id").alias("rep")).select("rep", "tokens", "_h", F.size("tokens").alias("size"))
    classes = materialize(classes, "set-classes")
    members = skew_join(rows.select("id", "_h", "tokens"), classes.select("_h", "tokens", "rep"), ["_h", "tokens"], rows.count()).select("id", "rep").distinct()
    largest = classes.agg(F.max("size")).first()[0] or 0
    bands = size_bands(least, largest)
    lower = np.array([b[0] for b in bands] or [1])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("tokens")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            sketch = parity_sketch(flat, at[:-1], 256)
            found: list[tuple] = []
            for i in range(batch.num_rows):
                mine, n = flat[at[i] : at[i + 1]], at[i + 1] - at[i]
                home = int(np.searchsorted(lower, n, "right")) - 1
                places = [(home, True)]
                if home + 1 < len(bands) and math.floor(n / least + 1e-9) >= bands[home + 1][0]:
                    places.append((home + 1, False))
                for band, here in places:
                    most = bands[band][2]
                    if most:  # else only equal sets match
                        block, key = _block_keys(mine, most + 1 + spare, spare)
                        found.append((np.full(len(block), i), np.full(len(block), band), block, key, np.full(len(block), here)))
            if found:
                of, band, block, key, here = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [pa.array(band.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(key), pa.array(here), batch.column("rep").take(pa.array(of)), batch.column("size").take(pa.array(of))]
                columns += [pa.array(sketch[of, w].view(np.int64)) for w in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["band", "block", "key", "home", "rep", "size", "w0", "w1", "w2", "w3"])

    keys = ["band", "block", "key"]
    placed = materialize(classes.select("rep", "tokens", "size").mapInArrow(spread, f"band int, block int, key long, home boolean, rep {kind}, size int, w0 long, w1 long, w2 long, w3 long"), "set-keys")
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    shares = F.ceil(F.col("n") / crowded).cast("int")
    split = materialize(counts.filter(F.col("n") > crowded).select(*keys, shares.alias("shares")), "crowded-keys")
    if split.isEmpty():
        sides = [placed.withColumn("part", F.lit(0))] * 2
    else:
        marked = skew_join(placed, split, keys, placed.count(), "left").fillna(1, ["shares"])
        own = F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int")
        sides = [marked.withColumn("part", own).drop("shares"), marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")]
    a, b = (x.select(*keys, "part", *[F.col(c).alias(f"{c}_{s}") for c in ("home", "rep", "size", "w0", "w1", "w2", "w3")]) for x, s in zip(sides, "ab", strict=True))
    apart = sum((F.bit_count(F.col(f"w{w}_a").bitwiseXOR(F.col(f"w{w}_b"))) for w in range(1, 4)), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    close = (F.col("rep_a") < F.col("rep_b")) & (F.col("home_a") | F.col("home_b")) & (apart <= (F.col("size_a") + F.col("size_b")) * ((1 - least) / (1 + least)) + 1e-9)
    close &= F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-9
    met = materialize(a.join(b, [*keys, "part"]).filter(close).select("rep_a", "rep_b").distinct(), "set-candidates")
    both = met.join(classes.select(F.col("rep").alias("rep_a"), F.col("tokens").alias("ta")), "rep_a").join(classes.select(F.col("rep").alias("rep_b"), F.col("tokens").alias("tb")), "rep_b")
    shared = F.size(F.array_intersect("ta", "tb"))
    similarity = shared / (F.size("ta") + F.size("tb") - shared)
    return both.select("rep_a", "rep_b", similarity.alias("similarity")).filter(F.col("similarity") >= least - 1e-12), members


def words_of(text: Column) -> Column:
    """The words of a text, in lower case and without punctuation."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(parts: Column, words: int = 5) -> Column:
    """Hashes of all runs of ``words`` words; of all words together if they are fewer; empty without words.

    ``parts`` must be a column that exists: an expression would be evaluated for every run.
    """
    many = F.greatest(F.size(parts) - (words - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), many), lambda i: F.xxhash64(F.array_join(F.slice(parts, i, words), " ")))
    return F.when(F.size(parts) > 0, runs).otherwise(F.array().cast("array<long>"))


def text_groups(documents: DataFrame, identifier: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document with words: its class of equal shingle sets, the class's links, its group; whole texts count."""
    split = materialize(documents.select(identifier, words_of(F.col(text)).alias("words")), "words")
    pairs, members = set_pairs(split, identifier, shingles(F.col("words"), words), least)
    return _groups(pairs, members, identifier)


# -- image hashes ------------------------------------------------------------------------


def hash_bits(column: Column) -> Column:
    """The 64 bits of a hex hash as a long; null unless it is valid.

    Valid: without outer blanks and in either case 16 hex digits that aren't all the same.
    """
    h = F.lower(F.trim(column))
    valid = h.rlike("^[0-9a-f]{16}$") & ~h.rlike("^(.)\\1{15}$")
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.when(valid, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hash_sketch(joined: Column | str, verified: Column | str) -> tuple[Column, Column]:
    """Parity sketch of the up to 128 tokens of two hashes in 96 bits.

    The tokens (one bits) of the first hash have a bit each, for the join; of the second, tokens t and
    t + 32 share one, so it fits in half and its distance never exceeds that of the hashes.
    """
    v = F.col(verified) if isinstance(verified, str) else verified
    return F.col(joined) if isinstance(joined, str) else joined, F.shiftright(F.shiftleft(v.bitwiseXOR(F.shiftrightunsigned(v, 32)), 32), 32).cast("int")


def _block(sketch: np.ndarray, b: int) -> np.ndarray:
    return ((sketch >> np.uint64(_BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)


def _masks(width: int, most: int) -> list[int]:
    """Bit patterns of ``width`` bits with at most ``most`` ones."""
    out = [0]
    for _ in range(most):
        out = sorted({m | 1 << b for m in out for b in range(width)} | set(out))
    return out


_EIGHT_ONE, _SIXTEEN_TWO = _masks(8, 1), _masks(16, 2)


def _meet(left: np.ndarray, right: np.ndarray, masks: list[int], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with left[i] ^ right[j] in ``masks``; ``right`` is sorted. At most about ``chunk`` at once."""
    for m in masks:
        want = left ^ m
        lo = np.searchsorted(right, want, "left")
        n = np.searchsorted(right, want, "right") - lo
        ends = np.cumsum(n)
        at = 0
        while at < len(left):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + chunk, "right")))
            k = n[at:to]
            total = int(k.sum())
            if total:
                i = np.repeat(np.arange(at, to), k)
                j = np.repeat(lo[at:to] - (np.cumsum(k) - k), k) + np.arange(total)
                yield i, j
            at = to


def _compare(rows: dict[str, np.ndarray], b: int, half: int, most_p: int, most_d: int, chunk: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (identifier, identifier) of one bucket whose sketches are close, each only in its first bucket."""
    sketch, fold, ids, left, home = rows["sketch"], rows["fold"], rows["rep"], rows["left"], rows["home"]
    block = _block(sketch, b)
    free = block >> 8 if half == 0 else block & 0xFF  # the half that may differ in one bit

    def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (ids[i] < ids[j]) & (home[i] | home[j])
        i, j = i[ok], j[ok]
        x = sketch[i] ^ sketch[j]
        ok = (np.bitwise_count(x) <= most_p) & (np.bitwise_count(fold[i] ^ fold[j]) <= most_d)
        i, j, x = i[ok], j[ok], x[ok]
        first = np.bitwise_count(_block(x, b)) <= 1
        for other in range(b):
            first &= np.bitwise_count(_block(x, other)) > 1
        same_low = (_block(x, b) & 0xFF) == 0
        first &= same_low if half == 0 else ~same_low
        return ids[i[first]], ids[j[first]]

    order = np.argsort(free, kind="stable")
    sketch, fold, ids, left, home, free = (x[order] for x in (sketch, fold, ids, left, home, free))
    at = np.flatnonzero(left)
    counts = np.bincount(free, minlength=256).astype(np.float64)
    work = sum(float((counts[np.arange(256) ^ m] * np.bincount(free[at], minlength=256)).sum()) for m in _EIGHT_ONE)
    indexed = len(ids) * (_BLOCKS - 1) * len(_SIXTEEN_TWO) * 4 + work * 0.01
    if work <= 4 * indexed:  # the cheaper of two ways to the same pairs
        for i, j in _meet(free[at], free, _EIGHT_ONE, chunk):
            yield close(at[i], j)
        return
    # A crowded bucket: the other blocks share at most most_p errors, so one of them has at most two.
    seen: list[int] = []
    for other in [o for o in range(_BLOCKS) if o != b]:
        key = _block(sketch, other)
        by = np.argsort(key, kind="stable")
        for i, j in _meet(key[at], key[by], _SIXTEEN_TWO, chunk):
            i, j = at[i], by[j]
            near = np.bitwise_count(free[i] ^ free[j]) <= 1
            for o in seen:
                near[near] &= np.bitwise_count(_block(sketch[i[near]] ^ sketch[j[near]], o)) > 2
            yield close(i[near], j[near])
        seen.append(other)


def hash_pairs(df: DataFrame, identifier: str, joined: Column, verified: Column, most_joined: int = 7, most_verified: int = 12, crowded: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """All pairs of distinct hash combinations within both distances, and who has them.

    ``joined`` and ``verified`` are 64-bit hashes as longs; rows with a null in either, or a null
    identifier, match nothing. Rows that agree in both are one class, named by its smallest
    identifier. Result: pairs of classes ``rep_a, rep_b`` (rep_a < rep_b) and the membership
    ``id, rep``. Pairs are complete for ``most_joined`` up to 7: of four 16-bit sketch
    blocks one then differs in at most one bit, so one of its halves not at all. Each record
    goes to the eight buckets of its halves in its band of sizes. A bucket is cut by as many bits of the other
    half as bring its parts below ``crowded`` classes, at most all eight; the result is the same.
    """
    if not 0 <= most_joined <= 7:
        raise ValueError("the pigeonhole join is complete up to a distance of 7")
    kind = df.schema[identifier].dataType.simpleString()
    rows = df.select(F.col(identifier).alias("id"), joined.alias("p"), verified.alias("d")).filter("id is not null and p is not null and d is not null")
    rows = materialize(rows, "hashes")
    classes = materialize(rows.groupBy("p", "d").agg(F.min("id").alias("rep")), "hash-classes")

    sketch, fold = hash_sketch("p", "d")
    wide = 3 * (most_joined + 1)
    size = F.bit_count(sketch)
    band = F.floor(size / wide).cast("int")
    guest = F.when(size % wide >= wide - most_joined, F.struct((band + 1).alias("band"), F.lit(False).alias("home")))
    bands = F.filter(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), guest), lambda x: x.isNotNull())
    halves = []
    for b in range(_BLOCKS):
        low, high = (F.shiftrightunsigned("sketch", _BLOCK_BITS * b + at).bitwiseAND(F.lit(0xFF)).cast("int") for at in (0, 8))
        halves += [F.struct((F.lit((b * 2 + half) * 256) + x).alias("bucket"), y.alias("other")) for half, x, y in ((0, low, high), (1, high, low))]
    spread = classes.select("rep", sketch.alias("sketch"), fold.alias("fold"), F.explode(bands).alias("_b")).select("*", F.explode(F.array(*halves)).alias("_h"))
    spread = spread.select("rep", "sketch", "fold", "_b.band", "_b.home", "_h.bucket", "_h.other")
    sizes = spread.groupBy("band", "bucket").count().filter(F.col("count") > crowded)
    cuts = F.least(F.ceil(F.log2(F.col("count") / crowded)).cast("int"), F.lit(8))
    sizes = materialize(sizes.select("band", "bucket", cuts.alias("cuts")), "crowded-buckets")  # at most 2,048 a band
    if sizes.isEmpty():
        placed = spread.select("*", F.lit(0).alias("part"), F.lit(True).alias("left"))
    else:
        own = F.floor(F.col("other") / F.pow(F.lit(2), 8 - F.col("cuts"))).cast("int")
        copies = F.transform(F.sequence(F.lit(0), F.col("cuts")), lambda k: F.when(k == 0, F.struct(own.alias("part"), F.lit(True).alias("left"))).otherwise(F.struct(own.bitwiseXOR(F.pow(F.lit(2), k - 1).cast("int")).alias("part"), F.lit(False).alias("left"))))
        placed = spread.join(F.broadcast(sizes), ["band", "bucket"], "left").fillna(0, ["cuts"]).select("*", F.explode(copies).alias("_x")).select("*", "_x.part", "_x.left")
    placed = placed.select("band", "bucket", "part", "left", "home", "sketch", "fold", "rep")

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table = key[1].as_py(), pa.Table.from_batches(batches)
        rows = {c: table.column(c).to_numpy() for c in ("sketch", "fold", "rep", "left", "home")}
        rows["sketch"], rows["fold"] = rows["sketch"].view(np.uint64), rows["fold"].view(np.uint32)
        rows["left"], rows["home"] = rows["left"].astype(bool), rows["home"].astype(bool)
        kind = table.schema.field("rep").type
        for a, b in _compare(rows, bucket // 512, bucket // 256 % 2, most_joined, most_verified):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["rep_a", "rep_b"])

    met = placed.groupBy("band", "bucket", "part").applyInArrow(compare, f"rep_a {kind}, rep_b {kind}")
    ends = [classes.select(F.col("rep").alias(f"rep_{s}"), F.col("p").alias(f"p{s}"), F.col("d").alias(f"d{s}")) for s in "ab"]
    apart = lambda c: F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b")))
    pairs = met.join(ends[0], "rep_a").join(ends[1], "rep_b").filter((apart("p") <= most_joined) & (apart("d") <= most_verified)).select("rep_a", "rep_b")
    members = skew_join(rows, classes, ["p", "d"], rows.count()).select("id", "rep").distinct()
    return pairs, members


def _pages(members: DataFrame) -> DataFrame:
    """``rep, page, ids``: the members of each class in rows of about a thousand, so that no class is one row or one key's work."""
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / _PAGE).cast("int").alias("pages"))
    paged = skew_join(members, sizes.filter("pages > 1"), ["rep"], members.count(), "left").fillna(1, ["pages"])
    return paged.groupBy("rep", F.pmod(F.xxhash64("id"), F.col("pages")).alias("page")).agg(F.collect_list("id").alias("ids"))


def photo_pairs(photos: DataFrame, most_perceptual: int = 7, most_difference: int = 12) -> DataFrame:
    """Pairs of photos ``photo_id_a < photo_id_b`` that are slightly changed versions of one another.

    The perceptual hashes differ in at most ``most_perceptual`` bits, the difference hashes in at
    most ``most_difference``; identical hashes count. Invalid hashes (see ``hash_bits``) match nothing.
    Classes are spelled out page by page: k copies are k (k - 1) / 2 pairs, but no single task's.
    """
    pairs, members = hash_pairs(photos, "id", hash_bits(F.col("perceptual_hash")), hash_bits(F.col("difference_hash")), most_perceptual, most_difference)
    pages = materialize(_pages(materialize(members, "hash-members")), "hash-pages")
    a, b = (pages.select(F.col("rep").alias(f"rep_{s}"), F.col("page").alias(f"page_{s}"), F.col("ids").alias(f"ids_{s}")) for s in "ab")
    across = pairs.join(a, "rep_a").join(b, "rep_b").select("ids_a", "ids_b", F.lit(True).alias("all"))
    several = pages.filter("page > 0 or size(ids) > 1")
    a, b = (several.select("rep", F.col("page").alias(f"page_{s}"), F.col("ids").alias(f"ids_{s}")) for s in "ab")
    same = a.join(b, "rep").filter("page_a <= page_b").select("ids_a", "ids_b", (F.col("page_a") < F.col("page_b")).alias("all"))
    spelled = across.unionByName(same).select("ids_b", "all", F.explode("ids_a").alias("x")).select("x", "all", F.explode("ids_b").alias("y")).filter(F.col("all") | (F.col("x") < F.col("y")))
    return spelled.select(F.least("x", "y").alias("photo_id_a"), F.greatest("x", "y").alias("photo_id_b"))


def _groups(pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
    pairs = materialize(pairs.select("rep_a", "rep_b"), "class-pairs")
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = connected_components(pairs, "rep_a", "rep_b").select(F.col("vertex").alias("rep"), "component")
    linked = links.join(groups, "rep")
    rows = skew_join(members, linked, ["rep"], members.count(), "left")
    return rows.select(F.col("id").alias(name), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "rep").alias("group_id"))


def photo_groups(photos: DataFrame, most_perceptual: int = 7, most_difference: int = 12) -> DataFrame:
    """One row per photo with valid hashes: its class of identical hashes, the class's links, its group.

    Result: ``photo_id, class_id, links, group_id``; links counts the other classes within both
    distances; groups are the connected components of classes, named by the smallest photo.
    """
    pairs, members = hash_pairs(photos, "id", hash_bits(F.col("perceptual_hash")), hash_bits(F.col("difference_hash")), most_perceptual, most_difference)
    return _groups(pairs, materialize(members, "hash-members"), "photo_id")
