import os
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import tokenizer as K
from lumenlake.llm import truncation as T
from lumenlake.llm.mixing import mix

pytestmark = pytest.mark.skipif(not os.path.exists(K.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def automaton():
    return K.Automaton(K.read_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.TOKENIZER)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_encoding_is_the_public_one(automaton, library, text):
    ids = automaton.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert automaton.decode(ids) == text


def test_hard_words(automaton, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abehint ") for _ in range(300)) for _ in range(200)] + ["a" * n for n in range(1, 120)] + ["<|endoftext|>", "  \n\n\t x", "é" * 50, "日本語" * 30, "👩‍👩‍👧‍👦" * 5, "\x00\x01", "=" * 300]
    for t in texts:
        assert automaton.encode(t) == library.encode(t, add_special_tokens=False).ids
    assert automaton.decode(automaton.encode("ab" * 200_000)) == "ab" * 200_000


def test_small_automaton_follows_the_merges():
    """Merges ab, then bc, then (ab)c: of abc only the last sequence is right."""
    v = {"bytes": list(range(256)), "merges": np.array([[97, 98, 256], [98, 99, 257], [256, 99, 258], [97, 97, 259]], dtype=np.int32)}
    a = K.Automaton(v)
    assert a.encode_bytes(b"abc") == (258,) and a.encode_bytes(b"bc") == (257,) and a.encode_bytes(b"abbc") == (256, 257)
    assert a.encode_bytes(b"aaa") == (259, 97) and a.encode_bytes(b"aab") == (259, 98) or a.encode_bytes(b"aab") == (97, 256)
    assert a.encode_bytes(b"") == ()


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (2, "", "y"), (3, None, "z"), (None, "Hello world", None), (4, "word " * 50_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string").withColumn("ids", F.lit(1))
    out = {r.doc_id: r.ids for r in K.encode_texts(df).collect()}
    assert out[1] == out[None] == [15496, 995] and out[2] == out[3] == [] and len(out[4]) > 49_999
    assert {r.doc_id: r.n_tokens for r in K.count_tokens(df).collect()}[1] == 2
    back = {r.doc_id: r.text for r in K.decode_ids(K.encode_texts(df)).collect()}
    assert back[1] == "Hello world" and back[2] == back[3] == "" and back[4] == rows[4][1]
    assert K.encode_texts(df.limit(0)).count() == 0


def _documents(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, source string, text string, n_tokens int, h int")


def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(6)
    words = ["tram", "harbour", "meadow", "lantern", "bridge"]
    rows, k = [], 0
    for source, n in (("big", 900), ("mid", 200), ("tiny", 12)):
        for _ in range(n):
            k += 1
            rows.append((k, source, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) + f" {k}"))
    rows += [(5000, "tiny", rows[-1][2]), (5001, "big", None), (5002, "big", ""), (5003, "big", "  \n"), (5004, None, "x"), (5005, "other", "x"), (None, "big", "no id")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.08, 4), ("absent", 0.02, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mix(_documents(spark, rows), targets)
    report = {r.source: r for r in report.collect()}
    chosen = chosen.collect()
    assert len({c.doc_id for c in chosen}) == len(chosen) and all(1 <= c.uses <= {"big": 1, "mid": 2, "tiny": 4}[c.source] for c in chosen)
    for source, share in (("big", 0.6 / 0.98), ("mid", 0.3 / 0.98), ("tiny", 0.08 / 0.98)):
        r = report[source]
        assert abs(r.actual_share - share) < 0.03 and abs(r.shortfall_tokens) <= 23
        assert r.chosen_tokens == sum(c.n_tokens * c.uses for c in chosen if c.source == source)
    assert report["absent"].chosen_tokens == 0 and report["tiny"].most_uses == 4
    # a smaller budget takes a subset
    less = {c.doc_id: c.uses for c in mix(_documents(spark, rows), targets, total=600)[0].collect()}
    more = {c.doc_id: c.uses for c in mix(_documents(spark, rows), targets, total=1200)[0].collect()}
    assert less and all(more.get(d, 0) >= u for d, u in less.items())
    # more than there is: cut off at the repeats, and said so
    huge = {r.source: r for r in mix(_documents(spark, rows), targets, total=10**9)[1].collect()}
    assert huge["tiny"].chosen_tokens == 4 * huge["tiny"].available_tokens and huge["big"].most_uses == 1


def test_mix_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mix(_documents(spark, []), targets)
    assert chosen.count() == 0 and {r.source: r.chosen_tokens for r in report.collect()} == {"a": 0, "b": 0}
    chosen, report = mix(_documents(spark, [(1, "a", "same"), (2, "a", "same"), (2, "a", "same"), (3, "b", "x")]), targets.limit(3))
    assert [(c.doc_id, c.uses) for c in chosen.collect()] == [(1, 2)]
    assert mix(_documents(spark, [(1, "a", "x")]), targets.limit(0))[1].count() == 0


def _library(n=1500, seed=7):
    """Made-up records: prose with full stops, captions without, JSON, lists."""
    rng = random.Random(seed)
    who, did, what = ["A cyclist", "The twins", "Our guide", "Two children"], ["painted", "followed", "crossed", "remembered"], ["the silver viaduct", "a quiet orchard", "the northern lighthouse", "an empty terrace"]
    tail = ["before the rain", "after the museum closed", "during the slow journey", "because nobody knew the way"]
    rows = []
    for k in range(n):
        s = lambda: f"{rng.choice(who)} {rng.choice(did)} {rng.choice(what)} {rng.choice(tail)}"
        kind = k % 4
        if kind == 0:
            rows.append((k, "journal", ". ".join(s() for _ in range(rng.randint(2, 6))) + "."))
        elif kind == 1:
            rows.append((k, "caption", s()))
        elif kind == 2:
            rows.append((k, "sidecar", '{"file": "IMG_%d.jpg", "comment": "%s.", "tags": ["%s"]}' % (k, s(), rng.choice(what))))
        else:
            rows.append((k, "keywords", "; ".join(rng.choice(what).split()[-1] for _ in range(rng.randint(3, 9)))))
    return rows


def test_truncation_on_held_out_cuts(spark):
    rng = np.random.default_rng(8)
    rows, truth = _library(), {}
    texts = []
    for k, source, text in rows:
        pieces = T.cut_places(text, [], rng, 1) if k % 7 == 0 else []
        truth[k] = bool(pieces)
        texts.append((k, source, pieces[0][0] if pieces else text, "x", 1))
    extra = [(9001, "journal", None, "", 0), (9002, "journal", "", "", 0), (9003, None, " \n", "", 0), (9004, None, "The twins crossed a quiet orchard before the rain.", "", 0)]
    df = spark.createDataFrame(texts + extra, "doc_id long, source string, text string, word string, known int")
    scores = {r.doc_id: r.score for r in T.score_truncation(df, sample=4000).collect()}
    assert scores[9001] == scores[9002] == scores[9003] == 0 and scores[9004] < 0.5
    found = {k for k in truth if scores[k] >= 0.5}
    cut = {k for k, t in truth.items() if t}
    assert len(found & cut) / len(cut) > 0.9 and len(found & cut) / len(found) > 0.9
    rates = {r.source: r for r in T.truncation_rates(T.score_truncation(df, sample=4000)).collect()}
    assert rates["journal"].documents == 377 and None in rates


def test_truncation_edges(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert T.score_truncation(df).count() == 0
    few = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (2, "a", "x")], df.schema)
    assert sorted(r.score for r in T.score_truncation(few).collect()) == [0, 0, 0]


def test_ends_and_structure():
    assert T.split_ellipsis("and then […]") == ("and then", "box") and T.split_ellipsis("It ended. …") == ("It ended.", "dots")
    assert T.split_ellipsis("It ended....") == ("It ended.", "dots") and T.split_ellipsis("and then...") == ("and then", "dots") and T.split_ellipsis("It ended.") == ("It ended.", "")
    assert T.structure_of('{"a": 1}', "json") == "ok" and T.structure_of('{"a": [1', "json") == "open"
    assert T.structure_of('a,b\n1,"x, y"', "csv") == "ok" and T.structure_of('a,b\n1,"x', "csv") == "open"
    assert T.shape_of("a; b; c") == "list" and T.shape_of("2025-01-01T10:00:00Z INFO x") == "log" and T.shape_of("One, two.") == "prose"


def test_fit_separates():
    def names(t):
        *mine, base = T.describe(t, "s")
        word, _, structure, stopped, kind, start, sign, paired = mine
        return T.corpus_features("s", word, structure, stopped, kind, start, sign, paired, 0, "off") + base

    values = [(t, c, k & 1) for k in range(200) for t, c in ((f"the sky {k}. All was well.", 0), (f"the sky {k}. All was we", 1))]
    rows = T._hashed([names(t) for t, _, _ in values])
    frame = pd.DataFrame({"features": list(rows), "cut": [c for _, c, _ in values], "suspect": 0, "fold": [f for _, _, f in values]})
    w = T.fit_cut_model(frame)
    assert ((T._score(w, rows) > 0.5) == (frame["cut"] == 1)).all()


def test_whole_texts_are_judged():
    sentence, gap = "It rained. ", "ab cd " * 2000
    assert T.describe(f"He said (and{gap}", "s")[-1][-2] == "open=True|False"
    assert T._since_last_end(sentence + gap) == (True, gap.strip())
    assert T.shape_of("a" * 3000 + ",b,c\n1,2,3") == "csv" and T.shape_of("; ".join(["tag"] * 500) + "; these are many words") == "prose"
    assert T.last_word("w" * 500) == "w" * 500 and T.last_word("end.") == "" and T.last_word("") == ""
    for text in ("x …", "(...)", "[…]", "...", "a & b &hellip;", "…", ")", "]", ";", "a]", "f(x)", "(a) (b...)"):
        slow = T._ELLIPSIS.search(text.rstrip())
        assert (T.split_ellipsis(text)[1] != "") == bool(slow)


def test_word_counts_need_something_behind():
    words = T._Words()
    for t in ("The cat sat", "the Cat.", "naïve cat_1 the", ""):
        words.add(t)
    assert dict(zip(*words.take(), strict=True)).get("cat") is not None
    for t in ("The cat sat", "the Cat."):
        words.add(t)
    assert dict(zip(*words.take(), strict=True)) == {"the": 2, "cat": 2} and len(words) == 0
