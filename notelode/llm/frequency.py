"""Occurrences and records of every n-gram of terms, by sorted suffixes.

A record's term sequence is cut into its suffixes of at most `longest` terms. Suffixes are counted within their task
first, then routed by their first terms and sorted in descending order, in which a sequence stands before all its
prefixes; one pass with a stack then counts every prefix, its records with it. A route is also split by record, into
more parts the more records there are, so a term that a third of all rows begin with meets many tasks and no set of
records outgrows one; parts hold different records, so both counts add up.

A whole value is counted the same way, as the only term of its row.

A null sequence counts nowhere; terms may be any strings, empty ones too. A null record counts as an occurrence in
no record.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from unicodedata import is_normalized, normalize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.session import spread

#: Parts of a route at least, and records a part should meet.
SHARDS, RECORDS = 16, 100_000
#: Distinct suffixes held in a task before they are passed on.
HELD = 200_000

_SCHEMA = "suffix array<string>, record string, n bigint"


def _suffixes(longest: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def frame(held: Counter) -> pd.DataFrame:
        return pd.DataFrame({"suffix": [list(s) for s, _ in held], "record": [r for _, r in held], "n": list(held.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for record, terms in zip(b["record"], b["terms"], strict=True):
                if terms is None:
                    continue
                terms = tuple(terms)
                for i in range(len(terms)):
                    held[terms[i : None if longest is None else i + longest], record] += 1
            if len(held) > HELD:
                yield frame(held)
                held.clear()
        if held:
            yield frame(held)

    return run


def _stacked(shortest: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One frame per term of the sequence under way: [term, occurrences, records].
        stack: list[list] = []
        out: list[tuple[list[str], int, int]] = []

        def pop() -> None:
            term, n, records = stack[-1]
            if n and len(stack) >= shortest:
                out.append(([x[0] for x in stack], n, len(records)))
            stack.pop()
            if stack:
                stack[-1][1] += n
                if len(stack[-1][2]) < len(records):
                    stack[-1][2], records = records, stack[-1][2]
                stack[-1][2] |= records

        for b in batches:
            for suffix, record, n in zip(b["suffix"], b["record"], b["n"], strict=True):
                same = 0
                for frame, term in zip(stack, suffix):
                    if frame[0] != term:
                        break
                    same += 1
                while len(stack) > same:
                    pop()
                stack += [[term, 0, set()] for term in suffix[same:]]
                if stack:
                    stack[-1][1] += n
                    if record is not None:
                        stack[-1][2].add(record)
            if out:
                yield pd.DataFrame(out, columns=["ngram", "n", "records"])
                out.clear()
        while stack:
            pop()
        if out:
            yield pd.DataFrame(out, columns=["ngram", "n", "records"])

    return run


def ngram_counts(rows: DataFrame, longest: int | None = None, shortest: int = 1, route: int = 1, records: int | None = None) -> DataFrame:
    """ngram ARRAY<STRING>, n (occurrences), records (distinct records) over rows of record STRING, terms ARRAY<STRING>.

    route: how many first terms decide the route, at most shortest. records: about how many there are, if known.
    """
    if route > shortest:
        raise ValueError("n-grams shorter than the route would be counted in several places")
    if records is None:
        records = rows.agg(F.approx_count_distinct("record")).first()[0]
    shards = max(SHARDS, math.ceil(records / RECORDS))
    made = spread(rows.select("record", "terms")).mapInPandas(_suffixes(longest), _SCHEMA)
    dealt = made.repartition(F.slice("suffix", 1, route), F.pmod(F.xxhash64("record"), F.lit(shards)))
    ordered = dealt.sortWithinPartitions(F.desc("suffix"))
    parts = ordered.mapInPandas(_stacked(shortest), "ngram array<string>, n bigint, records bigint")
    return parts.groupBy("ngram").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))


def _form(text: str) -> str:
    """Composed, in lower case, without outer blanks."""
    return (text if is_normalized("NFC", text) else normalize("NFC", text)).lower().strip(" ")


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            # One term; the kind's length tells where the text begins.
            terms = [[f"{len(k)}:{k}{_form(t)}"] for k, t in zip(b["kind"], b["text"], strict=True)]
            yield pd.DataFrame({"record": b["record"], "terms": terms})


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield pd.DataFrame({"record": b["record"], "terms": [_form(t).split(" ") for t in b["text"]]})


def _source(rows: DataFrame, record: str, kind: str, text: str) -> DataFrame:
    src = rows.filter(F.col(kind).isNotNull() & F.col(text).isNotNull())
    return spread(src.select(F.col(record).cast("string").alias("record"), F.col(kind).alias("kind"), F.col(text).alias("text")))


def value_counts(rows: DataFrame, record: str, kind: str, text: str) -> DataFrame:
    """type, text (composed, lower case, without outer blanks), n, n_records, mark over rows with type and text.

    mark: rare (one record), common (more than a twentieth of all records of the table), else null.
    """
    total = rows.select(F.countDistinct(record)).first()[0]
    terms = _source(rows, record, kind, text).mapInPandas(_values, "record string, terms array<string>")
    counts = ngram_counts(terms, longest=1, records=total)
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") * 20 > total, "common")
    value = F.col("ngram")[0]
    at = F.instr(value, ":")
    size = F.substring(value, F.lit(1), at - 1).cast("int")
    return counts.select(
        F.substring(value, at + 1, size).alias("type"), F.substring(value, at + 1 + size, F.length(value)).alias("text"),
        "n", F.col("records").alias("n_records"), mark.alias("mark"),
    )


def word_ngrams(rows: DataFrame, record: str, kind: str, text: str, longest: int = 3) -> DataFrame:
    """size, ngram (words with blanks between), n, n_records over the words of rows with type and text, as in value_counts."""
    terms = _source(rows, record, kind, text).mapInPandas(_words, "record string, terms array<string>")
    counts = ngram_counts(terms, longest=longest)
    return counts.select(F.size("ngram").alias("size"), F.array_join("ngram", " ").alias("ngram"), "n", F.col("records").alias("n_records"))
