"""N-gram counts by sorted suffixes against counting everything."""

import random
from collections import defaultdict

import pytest

from notelode.llm.frequency import ngram_counts, value_counts


def brute(rows, longest, shortest):
    n, records = defaultdict(int), defaultdict(set)
    for record, terms in rows:
        for i in range(len(terms or [])):
            for k in range(shortest, longest + 1):
                if i + k <= len(terms):
                    g = tuple(terms[i : i + k])
                    n[g] += 1
                    if record is not None:
                        records[g].add(record)
    return {(g, c, len(records[g])) for g, c in n.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [(rng.choice(["r1", "r2", "r3", None]), [rng.choice(["a", "b", "", "hot"]) for _ in range(rng.randrange(9))]) for _ in range(300)]
    return made + [(f"h{i % 40}", ["hot", "hot", "a"]) for i in range(200)] + [("r1", None)]


@pytest.mark.parametrize(("longest", "shortest", "route"), [(1, 1, 1), (3, 1, 1), (4, 2, 2)])
def test_against_brute_force(spark, rows, longest, shortest, route):
    df = spark.createDataFrame(rows, "record string, terms array<string>").repartition(5)
    got = ngram_counts(df, longest, shortest, route=route).collect()
    assert len(got) == len({tuple(r["ngram"]) for r in got})
    assert {(tuple(r["ngram"]), r["n"], r["records"]) for r in got} == brute(rows, longest, shortest)


def test_route_must_fit(spark, rows):
    with pytest.raises(ValueError, match="route"):
        ngram_counts(spark.createDataFrame(rows, "record string, terms array<string>"), 3, 1, route=2)


def test_values(spark):
    data = [(i % 30, "A", " So\u0302t ") for i in range(60)] + [(1, "A", "sôt"), (1, "B", "x  y"), (2, "B", "X  Y"), (3, None, "z"), (4, "A", None), (5, "A", ""), (6, "A", "hiếm"), (None, "A", "không")]
    df = spark.createDataFrame(data, "r long, t string, x string").withColumnsRenamed({"r": "record", "t": "type", "x": "text"})
    got = {(r["type"], r["text"]): (r["n"], r["n_records"], r["mark"]) for r in value_counts(df, "record", "type", "text").collect()}
    assert got == {
        ("A", "sôt"): (61, 30, "common"), ("B", "x  y"): (2, 2, "common"), ("A", ""): (1, 1, "rare"), ("A", "hiếm"): (1, 1, "rare"), ("A", "không"): (1, 0, None),
    }
    assert value_counts(df.limit(0), "record", "type", "text").count() == 0
