"""The extractor's vocabulary read from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelode.lexicon import DEFAULT, Lexicon

#: Terms a table may hold: all of them end up in one pattern.
MOST = 100_000


def _terms(df: DataFrame, term: str, codes: Column | None = None) -> dict[str, tuple[str, ...]]:
    """Terms in lower case, by name; of one that comes twice with other codes the first in order counts."""
    low = F.lower(term)
    rows = df.filter(F.col(term).isNotNull()).groupBy(low.alias("term"))
    rows = rows.agg(F.min(F.array().cast("array<string>") if codes is None else codes).alias("codes")).orderBy("term").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a vocabulary may hold {MOST} terms at most")
    return {r["term"]: tuple(r["codes"] or ()) for r in rows}


def read_lexicon(spark: SparkSession, d: str, cues: Lexicon = DEFAULT) -> Lexicon:
    """drug_lexicon (term, code), diagnosis_lexicon (term, codes), symptom_lexicon (term) and lab_lexicon (abbr) of a folder.

    Null terms don't count. Cues and sections aren't in tables; they are those of `cues`.
    """
    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    return Lexicon(
        drugs=_terms(table("drug_lexicon"), "term", F.array("code")),
        diagnoses=_terms(table("diagnosis_lexicon"), "term", F.col("codes")),
        symptoms=tuple(_terms(table("symptom_lexicon"), "term")),
        labs=tuple(_terms(table("lab_lexicon"), "abbr")),
        negation=cues.negation,
        family=cues.family,
        historical=cues.historical,
        sections=cues.sections,
    )
