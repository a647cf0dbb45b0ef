"""Context of a concept from what stands before it on its line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelode.operators.lines import HISTORY
from notelode.patterns import Patterns

# Names of the assertions, and how near a history cue must begin before a symptom.
NEGATED, FAMILY, HISTORICAL = "isNegated", "isFamily", "isHistorical"
NEAR = 20


def before(line_lower: Column, start: Column) -> Column:
    """What stands before a place; boundaries are tested within it, so a cue may end at the cut."""
    return F.substring(line_lower, F.lit(1), start)


def cue_end(line_lower: Column, cues: str) -> Column:
    """Where the first cue on a line ends; 0 if there is none."""
    return F.length(F.regexp_extract(line_lower, rf"(?s)\A.*?{cues}", 0))


def has_cue(line_lower: Column, start: Column, end: Column, cues: str, longest: int) -> Column:
    """Whether a cue stands before a place; end is cue_end of the line, longest the length of the longest cue.

    A line is gone through once, not once for each place on it. A cue may also end right at the place, where the line goes
    on with a letter; and before the end of the line's first cue another one may end, so there the head is asked itself.
    """
    tail = F.substring(line_lower, F.greatest(start - longest, F.lit(1)), F.least(start, F.lit(longest + 1)))
    cut_off = tail.rlike(rf"{cues}\z")
    return F.when((end > 0) & (end <= start), True).when(end == 0, cut_off).otherwise(before(line_lower, start).rlike(cues))


def is_negated(head: Column, p: Patterns) -> Column:
    return head.rlike(p.negation)


def is_family(head: Column, p: Patterns) -> Column:
    return head.rlike(p.family)


def is_historical(head: Column, section: Column, p: Patterns) -> Column:
    """Drugs and diagnoses: a cue before, or a section on history."""
    return section | head.rlike(p.historical)


def is_near_history(head: Column) -> Column:
    """Symptoms: the history cue itself begins fewer than NEAR characters before."""
    return head.rlike(rf"(?s){HISTORY}.{{0,{NEAR - 1 - len(HISTORY)}}}\z")


def listed(negated: Column, family: Column, historical: Column) -> Column:
    made = F.array(F.when(negated, NEGATED), F.when(family, FAMILY), F.when(historical, HISTORICAL))
    return F.filter(made, lambda a: a.isNotNull())


def assertions(head: Column, historical: Column, p: Patterns) -> Column:
    return listed(is_negated(head, p), is_family(head, p), historical)
