"""Compaction against a plain loop; failures at any point; odd inputs."""

import datetime as dt
import random

import pytest

from notelode.operators.compaction import Store, compact

SCHEMA = "file_id bigint, record_id string, text string, written_at timestamp, ward string"


def row(i, record, text, minute=None):
    return (i, record, text, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i if minute is None else minute), "W")


def plain(rows):
    first, out = {}, set()
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if r[1] is None or r[2] is None:
            continue
        key = r[1], r[2].replace("\r\n", "\n").replace("\r", "\n")
        if key in first:
            out.add(r[0])
        first.setdefault(key, r[0])
    return out


def ids(df):
    return [] if df is None else sorted(r["file_id"] for r in df.select("file_id").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["", None, "a", "a\r\nb", "a\nb", "a\rb", "A", "x" * 5000, "à"]
    made = [row(i, rng.choice(["1", "01", "2", None]), rng.choice(texts), rng.randrange(60)) for i in range(400)]
    return made + [row(1000 + i, "hot", "same") for i in range(300)]


def test_against_loop(spark, tmp_path, rows):
    store = compact(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "s"))
    out = plain(rows)
    assert ids(store.dropped()) == sorted(out)
    assert ids(store.read()) == sorted({r[0] for r in rows} - out)
    assert store.read().columns == ["file_id", "record_id", "text", "written_at", "ward"]
    assert sum(x["files"] for x in store.live()) == 1
    # Sixteen runs, by fours.
    assert [x["level"] for x in store.commits()] == [1, 2, 2, 2, 2, 3]


def test_readers_of_replaced_runs(spark, tmp_path, rows):
    df, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "s")
    store = Store(spark, path)
    store.ingest(df, "all", 2)
    early = store.read()
    store.finish()
    store.vacuum()
    assert early.count() == len(rows)
    store.grace = 0
    store.vacuum()
    assert ids(Store(spark, path).read()) == sorted({r[0] for r in rows} - plain(rows))
    assert ids(Store(spark, path).dropped()) == sorted(plain(rows))


def test_batches_and_levels(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "s"), fan_in=2)
    for k in range(3):
        store.ingest(spark.createDataFrame(rows[k::3], SCHEMA), f"b{k}")
        store.ingest(spark.createDataFrame(rows[k::3], SCHEMA), f"b{k}")  # the same batch again is nothing new
        store.settle()
    store.finish()
    assert ids(store.dropped()) == sorted(plain(rows))
    assert ids(store.read()) == sorted({r[0] for r in rows} - plain(rows))
    assert max(x["level"] for x in store.commits()) >= 2


@pytest.mark.parametrize("at", ["intent", "write", "commit"])
def test_stopped_and_run_again(spark, tmp_path, rows, at, monkeypatch):
    df, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / at)
    store = Store(spark, path)
    store.ingest(df, "all")
    put, n = type(store.folder).put, []

    def fail(self, name, value):
        n.append(name)
        if at == "intent" or name.endswith("commit.json"):
            if at == "commit":
                put(self, name, value)
            raise RuntimeError("stopped")
        put(self, name, value)

    monkeypatch.setattr(type(store.folder), "put", fail)
    with pytest.raises(RuntimeError):
        store.finish()
    monkeypatch.setattr(type(store.folder), "put", put)
    before = ids(store.read())
    assert set(before) >= {r[0] for r in rows} - plain(rows)
    again = compact(df, path)
    assert ids(again.dropped()) == sorted(plain(rows))
    assert ids(again.read()) == sorted({r[0] for r in rows} - plain(rows))


def test_empty_table(spark, tmp_path):
    store = compact(spark.createDataFrame([], SCHEMA), str(tmp_path / "s"))
    assert ids(store.dropped()) == [] and ids(store.read()) == []
