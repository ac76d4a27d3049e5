"""The llm queries run on the smallest tables, and those with SQL agree with DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest

from lumenlake.llm import queries as Q
from lumenlake.llm.tokenizer import TOKENIZER

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(TOKENIZER), reason="no test data")


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, tables, name):
    df = Q.queries()[name](spark, DATA)
    names = sorted(df.columns)
    rows = df.collect()
    if name in Q.oracle_sql():
        rel = tables.sql(Q.oracle_sql()[name])
        at = [rel.columns.index(c) for c in names]
        assert len(names) == len(rel.columns)
        want = sorted(repr(tuple(_plain(r[k]) for k in at)) for r in rel.fetchall())
        assert sorted(repr(tuple(_plain(r[c]) for c in names)) for r in rows) == want


def _true_pairs(tables, table, column, dim, least):
    rows = tables.sql(f"SELECT id, {column} FROM {table} WHERE len({column}) = {dim} ORDER BY id").fetchall()
    rows = [(i, v) for i, v in rows if all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, u = [i for i, _ in rows], np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= least}
    return out


def test_neighbour_recall_on_the_tables(spark, tables):
    got = {(r.kind, r.id_a, r.id_b) for r in Q.p6_found(spark, DATA).collect()}
    want = {("face", *p) for p in _true_pairs(tables, "faces", "embedding", 128, 0.7)} | {("photo", *p) for p in _true_pairs(tables, "photos", "visual_features", 64, 0.99)}
    assert want and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
