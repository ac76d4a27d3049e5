"""Encoding with a public byte-level BPE tokenizer through a tokenization automaton.

The merges are compiled into a deterministic automaton over token labels that accepts
exactly the correct token sequences. It starts as one state with an arc for every byte.
Each merge (a, b) -> c then adds a gadget: arcs labelled a are led to a copy of their
target without the arc b, and wherever a could be followed by b an arc c is added that
goes where b went. All arcs of one label share their target, so a state is its parent
state less one label, and whether it has an arc follows from two rules (see ``arc``).

A pre-split word is encoded by table-driven transitions: a trie walks the bytes, and
from each reached position only labels the automaton has an arc for are followed. The
automaton leaves exactly one way through a word. Decoding emits the labels' bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default place of the vocabulary files; every operator takes another as a parameter.
TOKENIZER = os.path.join(os.environ.get("LUMENLAKE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Fixed value: the pattern that splits text into words before the merges of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORDS_KEPT, _ARCS_KEPT = 400_000, 1_000_000


def _byte_of() -> dict[str, int]:
    """Characters by which these files write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def read_vocabulary(path: str = TOKENIZER) -> dict:
    """The merges of a byte-level BPE file as ids: ``bytes`` (id of each byte) and ``merges`` (a, b, c)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("byte_fallback"):
        raise ValueError(f"{path} holds no byte-level BPE")
    ids, byte_of = model["vocab"], _byte_of()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], dtype=np.int32)
    return {"bytes": [ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], "merges": merges}


class Automaton:
    """The compiled automaton; one per Python worker."""

    def __init__(self, vocabulary: dict):
        merges = vocabulary["merges"].tolist()
        self.text: dict[int, bytes] = {t: bytes([b]) for b, t in enumerate(vocabulary["bytes"])}
        self.born: dict[int, int] = dict.fromkeys(self.text, 0)  # gadget that made a label
        self.left: dict[int, int] = {}
        self.parent, self.without, self.made = [-1], [-1], [0]  # per state; state 0 has every byte
        self.target: dict[int, int] = dict.fromkeys(self.text, 0)  # where a label's arcs lead
        self.arcs: dict[int, bool] = {}
        for k, (a, b, c) in enumerate(merges, 1):
            q = self.target[a]
            if c in self.text or not self.arc(q, b):
                continue  # this merge can never happen
            self.text[c], self.born[c], self.left[c] = self.text[a] + self.text[b], k, a
            self.target[c] = self.target[b]
            self.parent.append(q)
            self.without.append(b)
            self.made.append(k)
            self.target[a] = len(self.parent) - 1
        self.arcs.clear()
        self.next: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.label: list[int] = [-1]
        for t, word in self.text.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                node = self.next.get(key, -1)
                if node < 0:
                    node = self.next[key] = len(self.label)
                    self.label.append(-1)
            self.label[node] = t
        self.words: dict[str, tuple[int, ...]] = {}
        import regex

        self.split = regex.compile(PATTERN).findall

    def arc(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc ``label``.

        A label made after the state has an arc there if its left part had; an older one
        if the parent state has it and it isn't the arc that was left out.
        """
        parent, without, made, born, left = self.parent, self.without, self.made, self.born, self.left
        while True:
            k = born[label]
            if k >= made[state]:
                if k == 0:
                    return True
                label = left[label]
            elif without[state] == label:
                return False
            else:
                state = parent[state]

    def _may(self, state: int, label: int) -> bool:
        key = state << 20 | label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= _ARCS_KEPT:
                self.arcs.clear()
            known = self.arcs[key] = self.arc(state, label)
        return known

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word."""
        n = len(word)
        if not n:
            return ()
        state, came, by = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        state[0] = 0
        step, label, target = self.next.get, self.label, self.target
        for i in range(n):
            s = state[i]
            if s < 0:
                continue
            node = 0
            for j in range(i, n):
                node = step(node << 8 | word[j], -1)
                if node < 0:
                    break
                t = label[node]
                if t >= 0 and state[j + 1] < 0 and self._may(s, t):
                    state[j + 1], came[j + 1], by[j + 1] = target[t], i, t
            if state[n] >= 0:
                break
        out = []
        while n:
            out.append(by[n])
            n = came[n]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; strings that look like special tokens are ordinary text."""
        words, found = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_bytes(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) >= _WORDS_KEPT:
                        words.clear()
                    words[w] = ids
            found.append(ids)
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        """Text of token ids; broken UTF-8 becomes replacement characters, unknown ids raise KeyError."""
        return b"".join([self.text[t] for t in ids]).decode("utf-8", errors="replace")


_compiled: dict[str, Automaton] = {}


def _automaton(path: str, vocabulary) -> Automaton:
    if path not in _compiled:
        _compiled[path] = Automaton(vocabulary.value)
    return _compiled[path]


def _shipped(spark: SparkSession, path: str):
    """The vocabulary, read once on the driver; its size is bounded by the file's."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _apart(name: str, columns: list[str]) -> str:
    """A name that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with the token ids of each text as a list of integers; a column ``ids`` is replaced.

    Whole texts are encoded, without special tokens. An empty or null text gives an empty list.
    """
    vocabulary = _shipped(df.sparkSession, path)
    rest = [c for c in df.columns if c not in (text, ids)]
    source = _apart("_text", rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _automaton(path, vocabulary).encode
        for b in batches:
            lists = [encode(t) if t else [] for t in b.column(source).to_pylist()]
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), column], names=[*rest, ids])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*rest, F.col(text).alias(source)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", count: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with the number of tokens of each text (0 for empty and null)."""
    vocabulary = _shipped(df.sparkSession, path)
    rest = [c for c in df.columns if c not in (text, count)]
    source = _apart("_text", rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _automaton(path, vocabulary).encode
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(source).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), n], names=[*rest, count])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(count, T.LongType())])
    return df.select(*rest, F.col(text).alias(source)).mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``df`` without ``ids``, with the text of each id list; null stays null, an empty list gives an empty text."""
    vocabulary = _shipped(df.sparkSession, path)
    rest = [c for c in df.columns if c not in (text, ids)]
    source = _apart("_ids", rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _automaton(path, vocabulary).decode
        for b in batches:
            texts = pa.array([None if x is None else decode(x) for x in b.column(source).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), texts], names=[*rest, text])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(text, T.StringType())])
    return df.select(*rest, F.col(ids).alias(source)).mapInArrow(run, schema)
