"""Queries of this package that SQL can express, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from notelode.llm.queries import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = c.execute(oracle()[name])
    at = [[x[0] for x in want.description].index(k) for k in cols]
    rows = Counter(tuple(r[i] for i in at) for r in want.fetchall())
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == rows


def test_columns(spark):
    want = {
        "p1_found": ["doc_id", "start_pos", "end_pos"], "p2_found": ["doc_id_a", "doc_id_b"], "p3_found": ["mention_id", "term"],
        "p4_found": ["doc_id", "kind", "start_pos", "end_pos"], "p5_found": ["type", "text", "mark"], "p7_ids": ["doc_id", "ids"],
        "p9_found": ["doc_id", "subject"],
    }
    for name, columns in want.items():
        assert queries()[name](spark, DATA).columns == columns
