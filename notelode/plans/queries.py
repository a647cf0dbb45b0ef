"""Named queries over the extractor's operators, on notes made of a template and a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelode.functions.text import is_blank
from notelode.lexicon import DEFAULT
from notelode.operators import arbitrate, assertions, lines, scan
from notelode.patterns import build
from notelode.plans import pipeline
from notelode.operators.compaction import compact
from notelode.operators.ordering import ranked
from notelode.session import cut, shared_dir, spread
from notelode.sources.lexicon import read_lexicon
from notelode.streaming.extract import concept_stream, read_notes, write_stream
from notelode.sources.files import numeric_order, record_id, universal_newlines

P = build(DEFAULT)

#: Clinical lines put before each document, so that every scan has something to find.
TEMPLATES = (
    "- amlodipine 10 mg po daily\naspirin 81",
    "aspirin: 81mg x 2 ngày\n- Docusate Sodium 100 mg",
    "xaspiriny\nhydromorphone 2 mg iv",
    "Tăng huyết áp, tăng lipid máu\nviêm gan bình thường",
    "trào ngược dạ dày - thực quản\n- khối u trực tràng",
    "- WBC là 12, sốt\n- K: 3.5\n- K : 3.5",
    "glucose (máu đói): 126 mg/dl\n- hẹn 10:30, ure: 7,2\n- mạch khi nghỉ: 80 lần",
    "gãy cổ xương đùi di lệch\n- Albumin: 3.5 g/dl",
    "1. Tiền sử bệnh\n- aspirin 81 mg\n2. Bệnh sử hiện tại\n- aspirin",
    "Thuốc trước khi nhập viện\n- metformin\n\n- gout\nKhi nhập viện:\n- gout",
    "1. Tiền sử bệnh\n3.5 mg\n- gout",
    "Tiền sử bệnh:\nTrước khi nhập viện\n- gout",
    "1. Tiền sử bệnh\n1.\n- gout\n\ufeff1. Tiền sử dị ứng",
    "Bệnh nhân không đau ngực, có sốt\nkhông bị gout nhưng hiện có suy tim",
    "bác sĩ ghi nhận sốt\ntiền sử 1234567890 sốt\ntiền sử 12345678901 sốt",
    "không có tiền sử gia đình bị gout\nkhôngsốt\nkhông thể tự chăm sóc bản thân",
    "có tiền sử ho ra máu\n- mẹ bị đái tháo đường type 2\n😀 sốt",
    "\n \t\nso\u0302\u0301t\r\n- ngừng uống warfarin 5 mg qd, trước đây dùng insulin glargine 10 units sc qhs",
)


def notes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text: a template by id, then the whole document."""
    at = F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("doc_id") % len(TEMPLATES)).cast("int"))
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", F.concat(at, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text")
    )


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.exploded(notes(spark, d), "doc_id")


def line_split(spark, d):
    return _lines(spark, d)


def line_offsets(spark, d):
    return lines.with_offsets(_lines(spark, d), "doc_id").select(
        "doc_id", "line_no", "line_start", F.length("line").alias("n")
    )


def blank_filter(spark, d):
    return _lines(spark, d).filter(~is_blank(F.col("line"))).select("doc_id", "line_no")


def header_lines(spark, d):
    return _lines(spark, d).filter(lines.is_header(F.col("line")) & ~is_blank(F.col("line")))


def subheader_lines(spark, d):
    return _lines(spark, d).filter(lines.is_subheader(F.col("line")))


def section_event(spark, d):
    event = lines.section_event(F.col("line"), P)
    return _lines(spark, d).select("doc_id", "line_no", F.coalesce(event.cast("string"), F.lit("keep")).alias("event"))


def section_state(spark, d):
    return lines.with_section(_lines(spark, d), P, "doc_id").select("doc_id", "line_no", "historical")


def section_state_in_row(spark, d):
    """The same state by the fold within the row: no shuffle, runs on streams."""
    state = lines.with_state(F.col("text"), P)
    return notes(spark, d).select("doc_id", F.explode(state).alias("x")).select(
        "doc_id", F.col("x.no").alias("line_no"), F.col("x.historical").alias("historical")
    )


def top_section(spark, d):
    return lines.with_section(_lines(spark, d), P, "doc_id").select("doc_id", "line_no", "top_section")


def _matches(spark, d, found) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_no", "line", F.explode(found(F.col("line"), P)).alias("m"))


def _surface(s: Column, e: Column) -> Column:
    return F.substring(F.col("line"), s + 1, e - s)


def _spans(df: DataFrame, s: Column, e: Column, *more: Column) -> DataFrame:
    return df.select("doc_id", "line_no", s.alias("s"), e.alias("e"), _surface(s, e).alias("text"), *more)


def drug_scan(spark, d):
    return _spans(_matches(spark, d, scan.drug_matches), F.col("m.s"), F.col("m.ends")[1])


def dose_extension(spark, d):
    m = _matches(spark, d, scan.drug_matches)
    return _spans(m, F.col("m.s"), F.col("m.e"), F.col("m.groups")[1].alias("dose"))


def diagnosis_scan(spark, d):
    return _spans(_matches(spark, d, scan.diagnosis_matches), F.col("m.s"), F.col("m.e"))


def symptom_scan(spark, d):
    return _spans(_matches(spark, d, scan.symptom_matches), F.col("m.s"), F.col("m.e"))


def lab_pairs(spark, d):
    ends = F.col("m.ends")
    return _matches(spark, d, scan.lab_matches).select(
        "doc_id", "line_no", ends[0].alias("name_s"), ends[1].alias("name_e"), ends[2].alias("value_s"),
        ends[3].alias("value_e"), _surface(ends[0], ends[1]).alias("name"), _surface(ends[2], ends[3]).alias("value"),
    )


def _coded(spark, d, found, terms):
    term = F.col("m.groups")[0]
    return _matches(spark, d, found).select(
        "doc_id", "line_no", F.col("m.s").alias("s"), F.lower(term).alias("term"),
        F.array_join(scan.codes(terms, term), "|").alias("codes"),
    )


def drug_codes(spark, d):
    return _coded(spark, d, scan.drug_matches, DEFAULT.drugs)


def diagnosis_codes(spark, d):
    return _coded(spark, d, scan.diagnosis_matches, DEFAULT.diagnoses)


def overlap_antijoin(spark, d):
    """All scans in one pass over the lines, then layer by layer what meets nothing accepted before."""
    keys = ["doc_id", "line_no"]
    key = [F.col(k) for k in keys]
    place = "array<struct<kind:string,s:int,e:int,vs:int,ve:int>>"

    def placed(found: Column, kind: str) -> Column:
        no = F.lit(None)
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), no.alias("vs"), no.alias("ve"))).cast(place)

    def pairs(found: Column) -> Column:
        ends = lambda m, i: m["ends"][i]
        return F.transform(found, lambda m: F.struct(F.lit("lab"), ends(m, 0), ends(m, 1), ends(m, 2), ends(m, 3))).cast(place)

    line = F.col("line")
    found = F.concat(
        placed(scan.drug_matches(line, P), "drug"), placed(scan.diagnosis_matches(line, P), "diagnosis"),
        pairs(scan.lab_matches(line, P)), placed(scan.symptom_matches(line, P), "symptom"),
    )
    found = cut(_lines(spark, d).select(*key, F.explode(found).alias("m")).select(*key, "m.*"))
    of = lambda kind: found.filter(F.col("kind") == kind).select(*key, "kind", "s", "e")
    taken = of("drug")
    taken = taken.unionByName(arbitrate.free_rows(of("diagnosis"), taken, keys))
    # A pair is two spans; both go if either meets a taken one.
    ok = arbitrate.free_rows(found.filter("kind = 'lab'"), taken, keys)
    ok = arbitrate.free_rows(ok.select(*key, "kind", F.col("s").alias("ns"), F.col("e").alias("ne"), F.col("vs").alias("s"), F.col("ve").alias("e")), taken, keys)
    both = F.explode(F.array(F.struct(F.col("ns").alias("s"), F.col("ne").alias("e")), F.struct("s", "e"))).alias("x")
    taken = taken.unionByName(ok.select(*key, "kind", both).select(*key, "kind", "x.s", "x.e"))
    return taken.unionByName(arbitrate.free_rows(of("symptom"), taken, keys))


def _accepted(spark, d) -> DataFrame:
    """doc_id, line_no, kind, s, head, historical of accepted drugs, diagnoses and symptoms."""
    rows = notes(spark, d).select("doc_id", F.explode(lines.with_state(F.col("text"), P)).alias("x"))
    rows = rows.select("doc_id", "x.no", "x.historical", "x.line", pipeline.line_spans(F.col("x.line"), P).alias("m"))
    kind = lambda name: F.transform(F.col(f"m.{name}"), lambda m: F.struct(F.lit(name).alias("kind"), m["s"].alias("s")))
    return rows.select(
        "doc_id", F.col("no").alias("line_no"), "line", "historical",
        F.explode(F.concat(kind("drugs"), kind("diagnoses"), kind("symptoms"))).alias("c"),
    ).select("doc_id", "line_no", "c.kind", "c.s", assertions.before(F.lower("line"), F.col("c.s")).alias("head"), "historical")


def assert_negated(spark, d):
    return _accepted(spark, d).select("doc_id", "line_no", "s", assertions.is_negated(F.col("head"), P).alias("negated"))


def assert_family(spark, d):
    return _accepted(spark, d).select("doc_id", "line_no", "s", assertions.is_family(F.col("head"), P).alias("family"))


def assert_historical(spark, d):
    is_hist = assertions.is_historical(F.col("head"), F.col("historical"), P)
    return _accepted(spark, d).filter("kind <> 'symptoms'").select("doc_id", "line_no", "s", is_hist.alias("hist"))


def symptom_proximity(spark, d):
    near = assertions.is_near_history(F.col("head"))
    return _accepted(spark, d).filter("kind = 'symptoms'").select("doc_id", "line_no", "s", near.alias("hist"))


def assertion_list(spark, d):
    head = F.col("head")
    is_hist = F.when(F.col("kind") == "symptoms", assertions.is_near_history(head)).otherwise(
        assertions.is_historical(head, F.col("historical"), P)
    )
    made = F.array_join(assertions.assertions(head, is_hist, P), "|")
    return _accepted(spark, d).select("doc_id", "line_no", "s", made.alias("assertions"))


def _rows(spark, d) -> DataFrame:
    return pipeline.concept_rows(notes(spark, d), ["doc_id"]).select(
        "doc_id", "type", "text", F.col("position")[0].alias("s"), F.col("position")[1].alias("e"),
        F.array_join("candidates", "|").alias("candidates"), F.array_join("assertions", "|").alias("assertions"),
    )


def concepts_union(spark, d):
    return _rows(spark, d)


def concepts_sorted(spark, d):
    at = F.posexplode(pipeline.concepts(F.col("text"))).alias("rank", "c")
    return notes(spark, d).select("doc_id", at).select(
        "doc_id", "rank", "c.type", F.col("c.position")[0].alias("s"), F.col("c.position")[1].alias("e")
    )


def concepts_per_doc(spark, d):
    found = F.transform(
        pipeline.concepts(F.col("text")), lambda c: F.concat_ws("~", c["type"], c["position"][0], c["text"])
    )
    return notes(spark, d).select("doc_id", F.array_join(found, "|").alias("found"))


def concept_counts(spark, d):
    """Concepts and records by type over the whole collection."""
    return _rows(spark, d).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")
    )


def concepts_json(spark, d):
    return pipeline.concepts_json(notes(spark, d)).select("doc_id", "json")


def _files(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/note_files.parquet")


def file_record_ids(spark, d):
    return _files(spark, d).select("file_id", record_id(F.col("file_name")).alias("stem"))


def newline_translation(spark, d):
    text = universal_newlines(F.col("text"))
    return _files(spark, d).select("file_id", F.length(text).alias("n"), F.size(lines.split_lines(text)).alias("n_lines"))


def file_order(spark, d):
    """Each file's place in its ward, by number of its record; a ward may lie in any number of tasks."""
    order = [numeric_order(F.col("record_id")), F.col("record_id"), F.col("file_id")]
    return ranked(_files(spark, d).select("file_id", "ward", "record_id"), ["ward"], order, "place").select("file_id", "place")


def file_concepts(spark, d):
    """Concepts of the note files, as read in text mode."""
    files = spread(_files(spark, d).select("file_id", "text")).select("file_id", universal_newlines(F.col("text")).alias("text"))
    return pipeline.concept_rows(files, ["file_id"]).select(
        "file_id", "type", "text", F.col("position")[0].alias("s"), F.col("position")[1].alias("e")
    )


def streamed_concepts(spark, d):
    """file_concepts, but the files come as a stream that is worked off in micro-batches and written exactly once."""
    files, out = _files(spark, d), shared_dir(spark)
    arriving = read_notes(spark, f"{d}/note_files.parquet", files.schema).select("file_id", universal_newlines(F.col("text")).alias("text"))
    write_stream(concept_stream(arriving, ["file_id"]), f"{out}/rows", f"{out}/state").awaitTermination()
    rows = spark.read.schema("file_id bigint, text string, type string, position array<int>").parquet(f"{out}/rows")
    return rows.select("file_id", "type", "text", F.col("position")[0].alias("s"), F.col("position")[1].alias("e"))


def lexicon_source(spark, d):
    """The vocabulary as the extractor takes it from the tables."""
    x = read_lexicon(spark, d)
    rows = [("drug", t, "|".join(c)) for t, c in x.drugs.items()] + [("diagnosis", t, "|".join(c)) for t, c in x.diagnoses.items()]
    rows += [(kind, t, "") for kind, terms in (("symptom", x.symptoms), ("lab", x.labs)) for t in terms]
    return spark.createDataFrame(rows, "kind string, term string, codes string")


def run_summary(spark, d):
    return _files(spark, d).agg(F.count(F.lit(1)).alias("n_files"), F.count("text").alias("n_read"))


def p6_found(spark, d):
    """Files that compaction found to be stored already."""
    return compact(_files(spark, d), shared_dir(spark)).dropped()


def p6_store(spark, d):
    """Every record version that the compacted store holds, by record: how many, and their characters."""
    files = _files(spark, d)
    rows = compact(files, shared_dir(spark)).read()
    rows = files.limit(0) if rows is None else rows
    return rows.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


NAMES = (
    "line_split line_offsets blank_filter header_lines subheader_lines section_event section_state section_state_in_row "
    "top_section drug_scan dose_extension diagnosis_scan symptom_scan lab_pairs drug_codes diagnosis_codes "
    "overlap_antijoin assert_negated assert_family assert_historical symptom_proximity assertion_list concepts_union "
    "concepts_sorted concepts_per_doc concept_counts concepts_json file_record_ids newline_translation file_order "
    "file_concepts streamed_concepts lexicon_source run_summary p6_found p6_store"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
