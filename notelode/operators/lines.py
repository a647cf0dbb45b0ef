"""Lines of a text, their places, and the section state carried over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelode.functions.text import is_blank, let, running, strip
from notelode.patterns import HEADER, Patterns

# Words that open or close a section.
HISTORY, PRESENT, REASON, ADMITTED = "tiền sử", "hiện tại", "lý do nhập viện", "khi nhập viện"
SHORT_LINE = 60


def split_lines(text: Column) -> Column:
    """Lines of a text; only the line feed parts them, empty ones count."""
    return F.split(text, "\n", -1)


def is_header(line: Column) -> Column:
    """A number, a dot, and at least one more character."""
    return line.rlike(HEADER)


def is_subheader(line: Column) -> Column:
    """No header, no dash in front, and short or ending in a colon."""
    s = strip(line)
    return ~is_blank(line) & ~is_header(line) & ~s.startswith("-") & (s.endswith(":") | (F.length(s) < SHORT_LINE))


def section_event(line: Column, p: Patterns) -> Column:
    """true: what follows is history; false: it is not; null: as before."""
    low = F.lower(strip(line))
    listed = low.rlike(p.sections)
    return (
        F.when(is_blank(line), F.lit(None).cast("boolean"))
        .when(is_header(line), low.contains(HISTORY) | listed)
        .when(
            is_subheader(line),
            F.when(listed, True).when(low.contains(PRESENT) | low.contains(REASON) | low.contains(ADMITTED), False),
        )
    )


def top_section(line: Column) -> Column:
    """Kind of a numbered header, null for any other line."""
    low = F.lower(strip(line))
    return F.when(
        is_header(line) & ~is_blank(line),
        F.when(low.contains(HISTORY), "history").when(low.contains(PRESENT), "present").otherwise("hospital"),
    )


def with_state(text: Column, p: Patterns) -> Column:
    """array<struct<no, start, line, historical>>: lines with their places and section state, in the row, without a shuffle."""
    rows = F.transform(split_lines(text), lambda x: F.struct(x.alias("line"), section_event(x, p).alias("event")))

    def placed(rows: Column) -> Column:
        # Twice the number of a line with an event, and one more if it opens a history; the largest up to a line decides.
        events = F.transform(rows, lambda x, i: F.coalesce(2 * i + x["event"].cast("int"), F.lit(-1)))
        starts = running(F.transform(rows, lambda x: F.length(x["line"]) + 1), lambda x, y: x + y, 0)
        both = F.struct(starts.alias("starts"), running(events, lambda x, y: F.greatest(x, y), -1).alias("last"))
        return let(
            both,
            lambda v: F.transform(
                rows,
                lambda x, i: F.struct(
                    i.alias("no"), F.get(v["starts"], i).alias("start"), x["line"].alias("line"),
                    (F.get(v["last"], i + 1) % 2 == 1).alias("historical"),
                ),
            ),
        )

    return let(rows, placed)


def exploded(notes: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """One row per line: key, line_no, line."""
    return notes.select(key, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def with_offsets(lines: DataFrame, key: str = "record_id") -> DataFrame:
    """Adds line_start by a running sum over the record's lines; shuffles by record."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def with_section(lines: DataFrame, p: Patterns, key: str = "record_id") -> DataFrame:
    """Adds historical and top_section, each the last one observed; the relational form of with_state."""
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(
        "historical", F.coalesce(F.last(section_event(F.col("line"), p), True).over(upto), F.lit(False))
    ).withColumn("top_section", F.last(top_section(F.col("line")), True).over(upto))
