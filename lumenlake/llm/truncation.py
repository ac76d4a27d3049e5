"""Text cut off by field limits: detection by logistic regression on artificially cut values.

Nobody labels truncated records, so positives are made: values of a bounded sample are
cut at random places or at their source's field limit, some with an ellipsis put behind.
A hashed logistic regression learns from the closing characters and words, punctuation,
structure and distance to the limit what the end of a cut value looks like. Uncut values
serve as negatives; those that look cut to a model trained on the other half of the
sample are taken out, since some of them are. The final model scores every record.

Corpus statistics (how often a word occurs whole, at which lengths a source's values pile
up) cover all records; only the fit uses a sample. One pass over the texts gives all that a
record's features need, and the word counts; whole texts are read, nothing is judged by a window.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.operators.joins import skew_join
from lumenlake.shared import materialize

_BITS = 18
#: So many features, the first ones, tell how the length stands to the source's limit.
_LIMIT_FEATURES = 5
_STOPS = ".!?。！？؟।"
_QUOTES = "\"'”’»」』)]"
_ELLIPSIS = re.compile(r"\s*(\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|…|\.{3}|&hellip;)$")
_SENTENCE_END = re.compile(r"[.!?。！？؟।][\"'”’»」』)\]]*(?=\s|$)|[。！？]|\n")
_WORD = re.compile(r"[^\W\d_]+")
_STAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:")
_ZEROS = str.maketrans("123456789", "0" * 9)
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
#: A value is cut for training at most so many times.
_CUTS = 2


def split_ellipsis(text: str) -> tuple[str, str]:
    """The text without blanks and an ellipsis at its end, and what kind of ellipsis that was."""
    core = text.rstrip()
    if core[-1:] not in ("…", ".", "]", ")", ";"):
        return core, ""
    last = core[-1:]
    if last in "])":
        opened = core.rfind("[" if last == "]" else "(")
        m = _ELLIPSIS.match(core, opened) if opened >= 0 else None
    else:
        at = len(core) - {"…": 1, ".": 3, ";": 8}[last]
        m = _ELLIPSIS.match(core, at) if at >= 0 else None
    if not m:
        return core, ""
    # of four dots the first is the sentence's own
    return core[: m.start(1)].rstrip(), "box" if last in "])" else "dots"


def shape_of(text: str) -> str:
    """json, csv, log, list or prose."""
    head = text.lstrip()
    if head[:1] in ("{", "[") and re.match(r"[{\[]\s*([\"{\[\]}\-\d]|true|false|null|$)", head):
        return "json"
    if _STAMP.match(head):
        return "log"
    line, broken, _ = head.partition("\n")
    if broken and line.count(",") >= 2 and " " not in line.strip() and not re.search(r"[.!?]", line):
        return "csv"
    for sep in (";", " | ", ","):
        if head.count(sep) >= 2 and all(len(p.split(None, 2)) <= 2 for p in head.split(sep)):
            return "list"
    return "prose"


def structure_of(core: str, shape: str) -> str:
    """Whether a structured value is complete: ok, open, or - for running text."""
    if shape == "json":
        try:
            json.loads(core)
            return "ok"
        except (ValueError, RecursionError):
            return "open"
    if shape == "csv":
        if core.count('"') % 2:
            return "open"
        plain = re.sub(r'"[^"]*"', "", core)
        first, last = plain.partition("\n"), plain.rpartition("\n")
        return "ok" if first[1] and last[2].count(",") == first[0].count(",") else "open"
    if shape == "log":
        line = core.rsplit("\n", 1)[-1]
        return "-" if _STAMP.match(line) and len(line.split(None, 2)) > 2 else "open"
    return "-"


def last_word(core: str) -> str:
    """The letters that the text ends with, in lower case."""
    at = len(core)
    while at and core[at - 1].isalpha():
        at -= 1
    return core[at:].lower()


def _since_last_end(core: str) -> tuple[bool, str]:
    """Whether any sentence ends in the text, and what follows the last one that does."""
    for window in (240, len(core)):  # the last end, wherever it is; mostly it is near
        begin = max(0, len(core) - window)
        at = -1
        for m in _SENTENCE_END.finditer(core, begin):
            at = m.end()
        if at >= 0:
            return True, core[at:].strip()
    return False, core.strip()


def describe(text: str, source: str) -> tuple:
    """``word, mark, structure, stopped, kind, start, sign, paired`` of a text and the names of its features, but for the corpus's."""
    core, mark = split_ellipsis(text)
    shape = shape_of(text)
    structure = structure_of(core, shape)
    word = last_word(core)
    many, rest = _since_last_end(core)
    last = core[-1:]
    kind = "L" if last.isalpha() else "D" if last.isdigit() else last
    closing = [x.translate(_ZEROS) for x in core.lower().rsplit(None, 4)[-4:]]
    low = core[-5:].lower().translate(_ZEROS)
    stopped = (not rest and last in _STOPS) or core.rstrip(_QUOTES)[-1:] in tuple(_STOPS)
    style = "multi" if many else "one"
    start = [] if stopped else rest.split(None, 2)[:2]
    sign = rest[:1] if rest and not rest[:1].isalnum() else ""
    style_of, first, end = f"{source}|{shape}|{style}", " ".join(start[:1])[:24], closing[-1] if closing else ""
    left = -1 if stopped else min(12, rest.count(" ") + 1 if rest else 0)
    names = [
        "bias", f"k={kind}", f"sk={source}|{kind}", f"hk={shape}|{style}|{kind}", f"st={structure}|{shape}", f"m={mark}|{stopped}", f"m={mark}",
        f"stop={stopped}", f"ss={style_of}|{stopped}", f"w1={end}", f"w1h={shape}|{style}|{end}", f"w2={' '.join(closing[-2:])}", f"w3={' '.join(closing[-3:])}",
        f"w4={' '.join(closing)}", f"r0={style}|{first}", f"r1={style}|{' '.join(start)[:40]}", f"rn={style_of}|{left}", f"c2={low[-2:]}", f"c3={low[-3:]}", f"c4={low[-4:]}", f"c5={low}",
        f"pc={shape}|{low[-2:-1]}{kind}", f"open={core.count('(') > core.count(')')}|{core.count('“') > core.count('”')}", f"blank={core[-12:].count(' ')}",
    ]
    return word, mark, structure, bool(stopped), kind, first, sign, rest.count("(") == rest.count(")"), names


def corpus_features(source: str, word: str, structure: str, stopped: bool, kind: str, start: str, sign: str, paired: bool, known: int, at_limit: str) -> list[str]:
    """The features that depend on word counts and on the lengths of the source; those of the length first."""
    seen = "none" if not word else str(min(6, int(np.log10(known + 1) * 2)))
    return [
        f"lim={at_limit}", f"limk={at_limit}|{stopped}", f"limseen={at_limit}|{seen}", f"lims={at_limit}|{source}", f"limst={at_limit}|{structure}",
        f"seen={seen}", f"seenk={seen}|{stopped}", f"seens={source}|{seen}", f"r0s={start}|{seen}|{kind}", f"sg={sign}|{seen}|{kind}", f"pair={kind}|{paired}|{seen}",
    ]


def _hashed(names: list[list[str]]) -> np.ndarray:
    """Feature indices of many rows of feature names at once."""
    flat = np.array([n for row in names for n in row], dtype=object)
    h = pd.util.hash_array(flat, categorize=False) >> np.uint64(64 - _BITS)
    return h.astype(np.int32).reshape(len(names), -1)


def fit_logistic(rows: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.25, decay: float = 2e-6, batch: int = 256, seed: int = 1) -> np.ndarray:
    """Hashed logistic regression by AdaGrad; ``rows`` holds as many feature indices a row.

    Rows are drawn into batches once; each epoch takes the batches in another order.
    """
    w, g2 = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-2)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    batches = []
    for at in range(0, len(order), batch):
        x = rows[order[at : at + batch]]
        touched, inverse = np.unique(x.reshape(-1), return_inverse=True)
        batches.append((touched, inverse.reshape(x.shape), labels[order[at : at + batch]]))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            touched, at, y = batches[k]
            mine = w[touched]
            err = (1 / (1 + np.exp(-np.clip(mine[at].sum(1), -30, 30))) - y) / len(y)
            g = np.bincount(at.reshape(-1), np.repeat(err, at.shape[1]), len(touched)) + decay * mine
            squares = g2[touched] + g * g
            g2[touched] = squares
            w[touched] = mine - rate * g / np.sqrt(squares)
    return w


def _score(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[rows].sum(1), -30, 30)))


def fit_cut_model(frame: pd.DataFrame, seed: int = 1) -> np.ndarray:
    """Weights from sampled values: ``features`` (index arrays), ``cut``, ``suspect``, ``fold`` (0/1 each).

    Uncut values are mixed: some are truncated. First a model without the length features,
    fitted without the suspects (values at their source's limit or with an ellipsis),
    scores the other half of the sample; what it finds cut is no negative. A second round
    with all features does the same again before the final fit.
    """
    rows = np.stack(frame["features"].to_numpy())
    labels, fold = frame["cut"].to_numpy().astype(np.float64), frame["fold"].to_numpy()
    blind = rows.copy()
    blind[:, :_LIMIT_FEATURES] = _hashed([["bias"]])[0, 0]
    keep = (labels == 1) | (frame["suspect"].to_numpy() == 0)
    for x in (blind, rows):
        score = np.zeros(len(x))
        for f in (0, 1):
            there, here = keep & (fold == f), fold != f
            if there.any() and here.any():
                score[here] = _score(fit_logistic(x[there], labels[there], seed=seed), x[here])
        keep = (labels == 1) | (score < 0.5)
    return fit_logistic(rows[keep], labels[keep], seed=seed)


def cut_places(text: str, limits: list[int], rng: np.random.Generator, many: int = _CUTS) -> list[tuple[str, str]]:
    """Cuts of an intact value, with how they stand to the limit (at, off).

    Places where the piece would be complete in itself (after a sentence, before a
    separator or line end) teach nothing and are passed over.
    """
    out, n = [], len(text.rstrip())
    if n < 8:
        return out
    for _ in range(many * 3):
        if len(out) >= many:
            break
        fixed = [x for x in limits if x < n]
        at = int(rng.choice(fixed)) if fixed and rng.random() < 0.5 else int(rng.integers(max(3, n // 4), n))
        piece, following = text[:at], text[at : at + 1]
        core = piece.rstrip()
        if len(core) < 3 or following in ",;|\n":
            continue
        if re.search(r"[.!?。！？؟।][\"'”’»」』)\]]*$", core) and (following.isspace() or core != piece or core[-1] in "。！？"):
            continue
        if rng.random() < 0.2:
            piece = core + str(rng.choice(["…", "...", " […]", " …"]))
        elif rng.random() < 0.05:
            piece += "\ufffd"  # a transfer that broke off within a character
        out.append((piece, "at" if at in fixed or rng.random() < 0.35 else "off"))
    return out


def _texts(documents: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    rows = documents.select("doc_id", source.alias("source"), F.col("text").alias("text"))
    return rows.filter(F.col("text").rlike(r"\S"))


def length_limits(described: DataFrame, least: int = 5, times: float = 6.0, shortest: int = 20) -> DataFrame:
    """``source, n``: lengths at which a source's values pile up against the ten lengths around."""
    counts = described.groupBy("source", "n").agg(F.count("*").alias("c"))
    around = Window.partitionBy("source").orderBy("n").rangeBetween(-5, 5)  # one row a length
    near = counts.withColumn("near", F.sum("c").over(around) - F.col("c"))
    return near.filter((F.col("n") >= shortest) & (F.col("c") >= least) & (F.col("c") >= times * (F.col("near") / 10 + 0.5))).select("source", "n")


_DESCRIBED = "source string, n long, word string, mark string, structure string, stopped boolean, kind string, start string, sign string, paired boolean, base array<int>"
_KINDS = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.bool_(), *[pa.string()] * 3, pa.bool_()]
_NAMES = [c.split()[0] for c in _DESCRIBED.split(", ")]


def _described(texts: list[str], sources: list[str]) -> list[pa.Array]:
    """The columns of ``_DESCRIBED``."""
    d = list(map(describe, texts, sources))
    base = _hashed([x[-1] for x in d])
    columns = [sources, [len(t) for t in texts], *zip(*(x[:-1] for x in d), strict=True)]
    return [*(pa.array(x, k) for x, k in zip(columns, _KINDS, strict=True)), pa.FixedSizeListArray.from_arrays(pa.array(base.reshape(-1)), base.shape[1]).cast(pa.list_(pa.int32()))]


class _Words:
    """Counts the words that have something behind them; texts of plain letters are counted as bytes."""

    def __init__(self) -> None:
        self.plain: Counter[bytes] = Counter()
        self.other: Counter[str] = Counter()

    def add(self, text: str) -> None:
        plain = text.isascii()
        words = text.lower().encode().translate(_LETTERS).split() if plain else _WORD.findall(text.lower())
        if words and text[-1].isalpha():
            words.pop()
        (self.plain if plain else self.other).update(words)

    def __len__(self) -> int:
        return len(self.plain) + len(self.other)

    def take(self) -> tuple[list[str], list[int]]:
        out = [*(w.decode() for w in self.plain), *self.other], [*self.plain.values(), *self.other.values()]
        self.__init__()
        return out


def _one_pass(texts: DataFrame, kind: str) -> DataFrame:
    """A row ``doc_id, <described>`` per text and, with a count ``c``, a row per word and task."""
    names = ["doc_id", *_NAMES, "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, types = _Words(), None

        def counted() -> pa.RecordBatch:
            words, counts = seen.take()
            columns = {n: pa.nulls(len(words), t) for n, t in types.items()} | {"word": pa.array(words, pa.string()), "c": pa.array(counts, pa.int64())}
            return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            text = b.column("text").to_pylist()
            for t in text:
                seen.add(t)
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), *_described(text, b.column("source").to_pylist()), pa.nulls(len(text), pa.int64())], names=names)
            types = dict(zip(out.schema.names, out.schema.types, strict=True))
            yield out
            if len(seen) > 200_000:
                yield counted()
        if len(seen):
            yield counted()

    return texts.mapInArrow(run, f"doc_id {kind}, {_DESCRIBED}, c long")


def _cut_sample(texts: DataFrame, limits: DataFrame, seed: int) -> DataFrame:
    """Described values of a sample and of cuts made from them."""
    by_source = limits.groupBy("source").agg(F.sort_array(F.collect_list("n")).alias("limits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []  # text, source, at_limit, cut, suspect, fold, code
            for text, source, limits in zip(*(b.column(c).to_pylist() for c in ("text", "source", "limits")), strict=True):
                limits, code = limits or [], zlib.crc32(text.encode("utf-8", "surrogatepass"))
                at = len(text) in limits
                rows.append((text, source, "at" if at else "off", 0, int(at or split_ellipsis(text)[1] != ""), code & 1, code))
                for piece, stand in cut_places(text, limits, np.random.default_rng([code, seed]), 1):
                    rows.append((piece, source, stand if limits else "off", 1, 0, code & 1, code))
            if rows:
                text, source, *rest = map(list, zip(*rows, strict=True))
                kinds = [pa.string(), *[pa.int32()] * 3, pa.int64()]
                yield pa.RecordBatch.from_arrays([*_described(text, source), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=[*_NAMES, "at_limit", "cut", "suspect", "fold", "code"])

    joined = texts.select("source", "text").join(by_source, "source", "left")
    return joined.mapInArrow(run, f"{_DESCRIBED}, at_limit string, cut int, suspect int, fold int, code long")


def _features(described: DataFrame, keep: list[str], weights: np.ndarray | None) -> DataFrame:
    """The hashed features of described values, or with ``weights`` their score."""
    names = ["source", "word", "structure", "stopped", "kind", "start", "sign", "paired", "known", "at_limit"]
    shipped = None if weights is None else described.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = _hashed(list(map(corpus_features, *(b.column(c).to_pylist() for c in names))))
            rows = np.hstack([rows, b.column("base").flatten().to_numpy().reshape(b.num_rows, -1)])
            if shipped is None:
                out = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.int32()))
            else:
                out = pa.array(_score(shipped.value, rows).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), out], names=[*keep, "features" if shipped is None else "score"])

    kinds = ", ".join(f"{c} {described.schema[c].dataType.simpleString()}" for c in keep)
    return described.mapInArrow(run, f"{kinds}, " + ("features array<int>" if shipped is None else "score double"))


def score_truncation(documents: DataFrame, sample: int = 40_000, seed: int = 1) -> DataFrame:
    """``doc_id, source, score`` of every document: how likely its text was cut off.

    ``sample`` bounds (in expectation) the values the classifier is fitted on, chosen by the
    hash of their identifier; each gives itself and one cut. Everything else covers all texts.
    Texts are judged whole: shape, structure, brackets and sentences are those of the whole text, and the last words
    and characters are its last, however long it is. Null, empty and blank texts score 0. A null source is a source of its own.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = _texts(documents)
    passed = materialize(_one_pass(texts, kind), "described")
    described = passed.filter("c is null").drop("c")
    total = described.count()
    limits = materialize(length_limits(described), "limits")
    words = materialize(passed.filter("c is not null").groupBy("word").agg(F.sum("c").alias("known")), "words")
    blank = documents.filter(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).select("doc_id", "source", F.lit(0.0).alias("score"))
    if not total:
        return blank

    share = min(1.0, sample / total)
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    drawn = _cut_sample(texts.filter(chosen), limits, seed).join(words, "word", "left").fillna(0, ["known"])
    frame = _features(drawn, ["cut", "suspect", "fold", "code", "n"], None).toArrow().to_pandas()
    frame = frame.sort_values(["code", "cut", "n"], kind="stable").reset_index(drop=True)
    if frame["cut"].nunique() < 2:  # nothing that could be cut
        return described.select("doc_id", F.when(F.col("source") != "?", F.col("source")).alias("source"), F.lit(0.0).alias("score")).unionByName(blank)
    weights = fit_cut_model(frame, seed)

    known = skew_join(described, words, ["word"], total, "left").fillna(0, ["known"])
    known = skew_join(known, limits.withColumn("at_limit", F.lit("at")), ["source", "n"], total, "left").fillna("off", ["at_limit"])
    scored = _features(known, ["doc_id", "source"], weights)
    return scored.withColumn("source", F.when(F.col("source") != "?", F.col("source"))).unionByName(blank)


def truncation_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """How often each source truncates: ``source, documents, truncated, rate``; null is a source."""
    cut = F.count_if(F.col("score") >= threshold)
    return scores.groupBy("source").agg(F.count("*").alias("documents"), cut.alias("truncated"), (cut / F.count("*")).alias("rate"))
