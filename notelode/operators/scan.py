"""Term scans: one line in, its matches out, each with its place in the line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelode.functions.text import SPANS, marked_parts, spans, strip
from notelode.patterns import Patterns


def _array_map(terms: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(v) if i == 0 else F.array(*map(F.lit, v)) for k, codes in terms.items() for i, v in enumerate((k, codes))))


def drug_matches(line: Column, p: Patterns) -> Column:
    """Drugs with the dose, route and frequency after them; groups: term, dose."""
    return spans(marked_parts(line, p.drug, 2), 2)


def diagnosis_matches(line: Column, p: Patterns) -> Column:
    return spans(marked_parts(line, p.diagnosis, 1), 1)


def symptom_matches(line: Column, p: Patterns) -> Column:
    return spans(marked_parts(line, p.symptom, 1), 1)


def lab_matches(line: Column, p: Patterns) -> Column:
    """Pairs of lab name and value whose name has a known fragment; groups: name, link, value.

    A pair that fails the test is used up all the same: the scan goes on behind it.
    """
    # Most lines have no link before a number; the scan, which tries up to forty lengths of name at a place, skips them.
    found = F.when(line.rlike(p.lab_hint), spans(marked_parts(line, p.lab, 3), 3))
    found = F.coalesce(found, F.array().cast(SPANS))
    return F.filter(found, lambda m: F.lower(strip(m["groups"][0])).rlike(p.lab_names))


def codes(terms: dict[str, tuple[str, ...]], found: Column) -> Column:
    """Codes of a found term; a spelling that matches only by case folding has none."""
    return F.coalesce(F.element_at(_array_map(terms), F.lower(found)), F.array().cast("array<string>"))
