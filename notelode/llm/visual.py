"""One form for texts that look the same, and the documents that share it.

Every batch of rows is handed to DuckDB inside the task, where one SQL expression makes the form: invisible characters
fall away; every blank becomes the plain one, their number stays; look-alike letters become Latin; wide, narrow and
shaped forms and radicals become plain; ligatures fall apart; Thai and Lao AM are put together; all is composed.
Raised digits, letter case, quotes, dashes and line ends stay, since a reader sees them.

A null text has a null form and is in no pair; a blank text is in no pair. Equal texts are no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.forms import blanks, invisible, ligatures, look_alikes, same_shapes
from notelode.session import cut, spread


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(text: str) -> str:
    """DuckDB expression for the form of a column."""
    one = {c: " " for c in blanks() + "\t"} | look_alikes() | same_shapes()
    # What a shape stands for may be a look-alike or a blank itself.
    one = {a: one.get(b, b) for a, b in one.items()}
    gone = invisible()
    # A character with no partner at the end of the list is deleted.
    sql = f"translate({text}, {_quoted(''.join(one) + gone)}, {_quoted(''.join(one.values()))})"
    for sign, letters in ligatures().items():
        sql = f"replace({sql}, {_quoted(sign)}, {_quoted(letters)})"
    sql = f"nfc_normalize(replace(replace({sql}, chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
    # The ring of AM and a tone mark stand in either order.
    sql = rf"regexp_replace({sql}, '\x{{0e4d}}([\x{{0e48}}-\x{{0e4b}}]?)\x{{0e32}}', '\1' || chr(3635), 'g')"
    return rf"regexp_replace({sql}, '\x{{0ecd}}([\x{{0ec8}}-\x{{0ecb}}]?)\x{{0eb2}}', '\1' || chr(3763), 'g')"


def _duck(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # One batch needs no room on disk, so none of a worker's folders is written to.
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as con:
            for b in batches:
                con.register("rows", pa.Table.from_batches([b]))
                made = con.sql(sql).to_arrow_table()
                con.unregister("rows")
                yield from made.to_batches()

    return run


def with_form(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, form: the visual form of each text; whole texts, one row each."""
    kind = dict(df.dtypes)[key]
    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    made = src.mapInArrow(_duck(f"SELECT k, {form_sql('t')} AS form FROM rows"), f"k {kind}, form string")
    return made.withColumnRenamed("k", key)


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, form and text as SHA-256 digests, for rows whose text isn't blank; texts never leave their task."""
    kind = dict(df.dtypes)[key]
    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    sql = f"""SELECT k, unhex(sha256(form)) AS form, unhex(sha256(t)) AS same FROM (SELECT k, t, {form_sql("t")} AS form FROM rows)
        WHERE trim(form, ' ' || chr(9) || chr(10)) <> ''"""
    return src.mapInArrow(_duck(sql), f"k {kind}, form binary, same binary")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """a, b (a < b): every pair of keys whose texts have one form but aren't equal.

    Pairs are made between the different texts of a form first and only then between their rows, so that copies of
    one text, however many, are never compared with each other.
    """
    marks = cut(fingerprints(df, key, text))
    mixed = marks.groupBy("form").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).filter("lo <> hi")
    rows = marks.join(mixed.select("form"), "form", "left_semi")
    texts = rows.select("form", "same").distinct()
    pairs = texts.withColumnRenamed("same", "same_a").join(texts.withColumnRenamed("same", "same_b"), "form").filter("same_a < same_b")
    one = pairs.join(rows.select("form", F.col("same").alias("same_a"), F.col("k").alias("ka")), ["form", "same_a"])
    two = one.join(rows.select("form", F.col("same").alias("same_b"), F.col("k").alias("kb")), ["form", "same_b"])
    return two.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, class (smallest key of it), links (documents that look the same with another text), copies (with this text).

    One row for every document whose form has more than one text. Texts are counted before forms, so a form that a third
    of all rows have is a few rows to each task.
    """
    marks = cut(fingerprints(df, key, text))
    texts = marks.groupBy("form", "same").agg(F.count(F.lit(1)).alias("copies"), F.min("k").alias("first"))
    forms = texts.groupBy("form").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("all"), F.min("first").alias("class")).filter("texts > 1")
    known = texts.join(forms, "form").select("form", "same", "class", (F.col("all") - F.col("copies")).alias("links"), "copies")
    return marks.join(known, ["form", "same"]).select(F.col("k").alias(key), "class", "links", "copies")
