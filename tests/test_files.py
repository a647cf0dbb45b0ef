"""Directory source, JSON sink, command line and streams."""

import datetime as dt
import json
import os

import pytest

from notelode import extract_concepts
from notelode.__main__ import main
from notelode.plans.pipeline import concept_rows
from notelode.sources.files import in_file_order, read_text_files, write_json_files
from notelode.streaming.extract import concept_stream, counts_by_window, deduplicated, read_notes, write_stream


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "2.txt").write_bytes("a\r\nsốt\rđau".encode())
    (d / "10.txt").write_bytes("﻿1. Tiền sử\n- gout".encode())
    (d / "01.txt").write_bytes(b"- amlodipine 10 mg po daily")
    (d / "1.txt").write_bytes(b"")
    (d / "x.csv").write_text("sốt")
    (d / "3.TXT").write_text("sốt")
    return d


def test_read(spark, folder):
    rows = in_file_order(read_text_files(spark, str(folder))).collect()
    assert [r["record_id"] for r in rows] == ["01", "1", "2", "10"]
    assert rows[2]["text"] == "a\nsốt\nđau" and rows[3]["text"].startswith("﻿")


def test_odd_names(spark, tmp_path):
    names = ["a b.txt", "c+d.txt", "e%20f.txt", "sốt.txt", "g\u0301.txt"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text("x" * (i % 2))
    rows = {r["record_id"]: r["text"] for r in read_text_files(spark, str(tmp_path)).collect()}
    assert rows == {name[:-4]: "x" * (i % 2) for i, name in enumerate(names)}


def test_bad_bytes_raise(spark, folder):
    (folder / "5.txt").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        read_text_files(spark, str(folder)).collect()


def test_json_bytes(spark, folder, tmp_path):
    out = tmp_path / "out"
    assert write_json_files(extract_concepts(read_text_files(spark, str(folder))), str(out)) == 4
    assert sorted(os.listdir(out)) == ["01.json", "1.json", "10.json", "2.json"]
    want = [{"text": "amlodipine 10 mg po daily", "type": "THUỐC", "candidates": ["17767"], "assertions": [], "position": [2, 27]}]
    assert (out / "01.json").read_text(encoding="utf-8") == json.dumps(want, ensure_ascii=False, indent=2)
    assert (out / "1.json").read_text() == "[]"
    assert [c["position"] for c in json.loads((out / "2.json").read_text())] == [[2, 5], [6, 9]]


def test_command_line(spark, folder, tmp_path, capsys):
    assert main([]) == 1 and "Usage" in capsys.readouterr().out
    assert main([str(folder), str(tmp_path / "o")]) == 0
    (folder / "abc.txt").write_text("x")
    with pytest.raises(ValueError, match="not a number"):
        main([str(folder), str(tmp_path / "p")])
    assert os.listdir(tmp_path / "p") == []


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{i}. Tiền sử bệnh\n- gout và sốt {i}") for i in range(20)], "id int, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = concept_stream(read_notes(spark, str(tmp_path / "in"), rows.schema), ["id"])
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, got)) == sorted(map(str, concept_rows(rows, ["id"]).collect()))


def test_stream_drops_repeats_and_counts(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=m)
    rows = [(1, at(0), "sốt"), (1, at(1), "sốt"), (2, at(70), "sốt, đau"), (3, at(2), "ho")]
    spark.createDataFrame(rows, "id int, at timestamp, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    notes = read_notes(spark, str(tmp_path / "in"), "id int, at timestamp, text string")
    write_stream(deduplicated(notes, ["id"], "at"), str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    once = spark.read.parquet(str(tmp_path / "once"))
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 3]
    found = concept_stream(notes, ["id", "at"])
    counts = counts_by_window(found, "at", "1 hour", "10 minutes")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r["window_start"].hour, r["type"]): r["n"] for r in spark.table("counts").collect()}
    assert got == {(8, "TRIỆU_CHỨNG"): 3, (9, "TRIỆU_CHỨNG"): 2}
