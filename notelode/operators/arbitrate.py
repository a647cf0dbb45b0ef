"""Who wins where matches overlap: drugs, then diagnoses, then labs, then symptoms, among those accepted so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meets(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open spans share a place; touching ones do not."""
    return (a_start < b_end) & (a_end > b_start)


def free(matches: Column, taken: Column) -> Column:
    """Matches that meet no taken span."""
    return F.filter(matches, lambda m: ~F.exists(taken, lambda t: meets(m["s"], m["e"], t["s"], t["e"])))


def free_pairs(pairs: Column, taken: Column) -> Column:
    """Lab pairs of which neither name nor value meets a taken span; the link between may."""

    def hit(m: Column, t: Column) -> Column:
        ends = m["ends"]
        return meets(ends[0], ends[1], t["s"], t["e"]) | meets(ends[2], ends[3], t["s"], t["e"])

    return F.filter(pairs, lambda m: ~F.exists(taken, lambda t: hit(m, t)))


def places(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))


def pair_places(pairs: Column) -> Column:
    return F.flatten(
        F.transform(
            pairs,
            lambda m: F.array(
                F.struct(m["ends"][0].alias("s"), m["ends"][1].alias("e")),
                F.struct(m["ends"][2].alias("s"), m["ends"][3].alias("e")),
            ),
        )
    )


def free_rows(candidates: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """The relational form: an anti join on the line with a residual range test."""
    c, t = candidates.alias("c"), taken.alias("t")
    same = [F.col(f"c.{k}") == F.col(f"t.{k}") for k in keys]
    return c.join(t, [*same, meets(F.col("c.s"), F.col("c.e"), F.col("t.s"), F.col("t.e"))], "left_anti")
