"""The extractor as one narrow projection: a text column in, an array of concepts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.functions.text import is_blank, let
from notelode.lexicon import DEFAULT, Lexicon
from notelode.operators import arbitrate, assertions, lines, scan
from notelode.patterns import Patterns, build

# Concept types.
DRUG, DIAGNOSIS, LAB_NAME, LAB_VALUE, SYMPTOM = "THUỐC", "CHẨN_ĐOÁN", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "TRIỆU_CHỨNG"

CONCEPT = "struct<text:string,type:string,candidates:array<string>,assertions:array<string>,position:array<int>>"


def line_spans(line: Column, p: Patterns) -> Column:
    """struct<drugs, diagnoses, labs, symptoms>: matches of a line that hold after arbitration, layer by layer."""

    def kept(found: Column) -> Column:
        drugs = found["drugs"]

        def with_diagnoses(diagnoses: Column) -> Column:
            taken = F.concat(arbitrate.places(drugs), arbitrate.places(diagnoses))
            return let(let(taken, lambda t: arbitrate.free_pairs(found["labs"], t)), lambda labs: with_labs(diagnoses, labs))

        def with_labs(diagnoses: Column, labs: Column) -> Column:
            taken = F.concat(arbitrate.places(drugs), arbitrate.places(diagnoses), arbitrate.pair_places(labs))
            symptoms = let(taken, lambda t: arbitrate.free(found["symptoms"], t))
            return F.struct(drugs.alias("drugs"), diagnoses.alias("diagnoses"), labs.alias("labs"), symptoms.alias("symptoms"))

        return let(arbitrate.free(found["diagnoses"], drugs), with_diagnoses)

    # All four scans first, side by side: scans within scans would nest deeper than the analyzer goes.
    scans = F.struct(
        scan.drug_matches(line, p).alias("drugs"), scan.diagnosis_matches(line, p).alias("diagnoses"),
        scan.lab_matches(line, p).alias("labs"), scan.symptom_matches(line, p).alias("symptoms"),
    )
    return let(scans, kept)


def _concept(line: Column, start: Column, s: Column, e: Column, kind: str, candidates: Column, asserted: Column) -> Column:
    return F.struct(
        F.substring(line, s + 1, e - s).alias("text"),
        F.lit(kind).alias("type"),
        candidates.cast("array<string>").alias("candidates"),
        asserted.cast("array<string>").alias("assertions"),
        F.array(start + s, start + e).alias("position"),
    ).cast(CONCEPT)


def line_concepts(row: Column, p: Patterns, lexicon: Lexicon) -> Column:
    """Concepts of one line given as struct<start, line, historical>."""
    line, start, hist = row["line"], row["start"], row["historical"]
    none = F.lit(None)

    def made(v: Column) -> Column:
        low, m = v["low"], v["m"]

        def cued(x: Column, name: str, cues: str) -> Column:
            return assertions.has_cue(low, x["s"], v[name], cues, p.longest)

        def asserted(x: Column, historical: Column) -> Column:
            return assertions.listed(cued(x, "neg", p.negation), cued(x, "fam", p.family), historical)

        def coded(kind: str, terms: dict[str, tuple[str, ...]]):
            return lambda x: _concept(
                line, start, x["s"], x["e"], kind, scan.codes(terms, x["groups"][0]), asserted(x, hist | cued(x, "past", p.historical))
            )

        def symptom(x: Column) -> Column:
            # No more than what is near can matter.
            near = F.substring(low, F.greatest(x["s"] - assertions.NEAR + 1, F.lit(1)), F.least(x["s"], F.lit(assertions.NEAR)))
            return _concept(line, start, x["s"], x["e"], SYMPTOM, none, asserted(x, assertions.is_near_history(near)))

        def pair(x: Column) -> Column:
            ends = x["ends"]
            return F.array(
                _concept(line, start, ends[0], ends[1], LAB_NAME, none, none),
                _concept(line, start, ends[2], ends[3], LAB_VALUE, none, none),
            )

        return F.concat(
            F.transform(m["drugs"], coded(DRUG, lexicon.drugs)),
            F.transform(m["diagnoses"], coded(DIAGNOSIS, lexicon.diagnoses)),
            F.flatten(F.transform(m["labs"], pair)),
            F.transform(m["symptoms"], symptom),
        )

    def any_made(m: Column) -> Column:
        n = F.size(m["drugs"]) + F.size(m["diagnoses"]) + F.size(m["labs"]) + F.size(m["symptoms"])
        low = F.lower(line)
        ends = {"neg": p.negation, "fam": p.family, "past": p.historical}
        full = let(F.struct(low.alias("low"), m.alias("m"), *(assertions.cue_end(low, cues).alias(n) for n, cues in ends.items())), made)
        return F.when(n > 0, full).otherwise(F.array().cast(f"array<{CONCEPT}>"))

    return let(line_spans(line, p), any_made)


def concepts(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Concepts of a text by place. A null text gives null, an empty or blank one the empty array."""
    p = build(lexicon)
    found = F.flatten(
        F.transform(
            F.filter(lines.with_state(text, p), lambda x: ~is_blank(x["line"])), lambda x: line_concepts(x, p, lexicon)
        )
    )
    # Accepted spans are disjoint and not empty, so the place decides alone.
    placed = F.transform(found, lambda c: F.struct(c["position"].alias("at"), c.alias("c")))
    return F.when(text.isNotNull(), F.transform(F.array_sort(placed), lambda x: x["c"]))


def extract_concepts(df: DataFrame, text: str = "text", into: str = "concepts", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds the concepts of a text column; narrow, so it runs in batch and on streams alike."""
    return df.withColumn(into, concepts(F.col(text), lexicon))


def concept_rows(df: DataFrame, keys: list[str], text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """One row per concept: the keys, text, type, candidates, assertions, position."""
    return df.select(*keys, F.explode(concepts(F.col(text), lexicon)).alias("_c")).select(*keys, "_c.*")


def concepts_json(df: DataFrame, text: str = "text", into: str = "json", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds the concepts as a JSON array; absent lists are left out, empty ones stay."""
    return df.withColumn(into, F.to_json(F.coalesce(concepts(F.col(text), lexicon), F.array().cast(f"array<{CONCEPT}>"))))
