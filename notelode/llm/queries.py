"""Named queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelode.llm import bpe, canonical, forms, frequency, packing, personal, sentences, subjects, visual


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return sentences.sentences(_table(spark, d, "documents"), "doc_id", "text")


def p2_found(spark, d):
    pairs = visual.look_alike_pairs(_table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p2_form(spark, d):
    return visual.with_form(_table(spark, d, "documents"), "doc_id", "text")


def p2_classes(spark, d):
    """Documents that look like others of another text: their class, and how many they are linked to."""
    return visual.look_alike_classes(_table(spark, d, "documents"), "doc_id", "text")


DRUG, DIAGNOSIS = "THUỐC", "CHẨN_ĐOÁN"


def _mapped(spark, d) -> DataFrame:
    """mention_id, kind, text, term, distance of each drug or diagnosis without a code."""
    rows = _table(spark, d, "mentions").select("mention_id", "loaded_at", "type", "text", "candidates")
    rows = rows.filter(F.col("type").isin(DRUG, DIAGNOSIS))
    coded = F.coalesce(F.size("candidates") > 0, F.lit(False))
    # How often an entry occurs as it stands decides between entries that are equally near.
    seen = rows.filter(coded).groupBy("type", F.lower("text").alias("term")).agg(F.count(F.lit(1)).alias("frequency"))

    def reference(name: str, kind: str) -> DataFrame:
        own = seen.filter(F.col("type") == kind).withColumnRenamed("term", "low")
        lexicon = _table(spark, d, name).select("term")
        return lexicon.join(own, F.lower("term") == F.col("low"), "left").select("term", F.coalesce("frequency", F.lit(0)).alias("frequency"))

    free = canonical.latest(rows.filter(~coded), "mention_id", "loaded_at", "type", "text")
    kind = F.when(F.col("type") == DRUG, "drug").otherwise("diagnosis")
    references = {"drug": reference("drug_lexicon", DRUG), "diagnosis": reference("diagnosis_lexicon", DIAGNOSIS)}
    return canonical.map_to_reference(free, "mention_id", kind, F.col("text"), references)


def p3_found(spark, d):
    return _mapped(spark, d).select("mention_id", F.coalesce("term", F.lit("(none)")).alias("term"))


def p3_unmatched(spark, d):
    """Texts that mean no entry, and how often each occurs."""
    return _mapped(spark, d).filter("term IS NULL").groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark, d):
    return personal.personal_items(_table(spark, d, "documents"), "doc_id", "text")


def p4_text(spark, d):
    """The documents with typed placeholders."""
    return personal.redacted(_table(spark, d, "documents"), "doc_id", "text")


def p5_values(spark, d):
    return frequency.value_counts(_table(spark, d, "mentions"), "record_id", "type", "text")


def p5_found(spark, d):
    return p5_values(spark, d).filter("mark IS NOT NULL").select("type", "text", "mark")


def p5_ngrams(spark, d):
    """Word sequences of up to three words within values."""
    return frequency.word_ngrams(_table(spark, d, "mentions"), "record_id", "type", "text")


def p7_ids(spark, d):
    return bpe.token_ids(_table(spark, d, "documents"), "doc_id", "text")


def p7_corpus(spark, d):
    """The same ids, every different word of the corpus replayed once."""
    return bpe.corpus_token_ids(_table(spark, d, "documents"), "doc_id", "text")


def _packs(spark, d) -> list[tuple[str, int]]:
    """The few container sizes."""
    return [(r["pack_name"], r["capacity_tokens"]) for r in _table(spark, d, "pack_sizes").orderBy("pack_name").collect()]


def _packed(spark, d) -> packing.Packed:
    sizes = bpe.token_counts(_table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", _packs(spark, d))


def p8_pack(spark, d):
    """Containers of every capacity: which documents, or pieces of those that are too long, lie in them."""
    return _packed(spark, d).placed.withColumnsRenamed({"first": "first_token", "size": "n_tokens"})


def p8_use(spark, d):
    """Containers, how full they are, and the fewest that any packing needs, by capacity."""
    return packing.use(_packed(spark, d), _packs(spark, d))


def p8_bounds(spark, d):
    """What each partition needed in each round, and its bound."""
    return _packed(spark, d).bounds


def p8_check(spark, d):
    """By capacity: documents packed, containers that hold too much, and documents split though they would fit."""
    of = spark.createDataFrame(_packs(spark, d), "pack_name string, capacity int")
    placed = _packed(spark, d).placed
    full = placed.groupBy("pack_name", "container").agg(F.sum("size").alias("size")).join(of, "pack_name")
    full = full.groupBy("pack_name").agg(F.count(F.when(F.col("size") > F.col("capacity"), 1)).alias("overfull"))
    whole = placed.groupBy("pack_name", "doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces")).join(of, "pack_name")
    needless = F.count(F.when(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))), 1))
    return whole.groupBy("pack_name").agg(F.count(F.lit(1)).alias("documents"), needless.alias("needless")).join(full, "pack_name")


def p9_found(spark, d):
    names = [r["subject"] for r in _table(spark, d, "subjects").select("subject").distinct().collect()]
    return subjects.assign_subjects(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "subject_labels"), names)


_VALUES = """WITH v AS (SELECT type, trim(lower(nfc_normalize(text)), ' ') AS text, record_id FROM mentions WHERE type IS NOT NULL AND text IS NOT NULL),
c AS (SELECT type, text, count(*) AS n, count(DISTINCT record_id) AS n_records FROM v GROUP BY type, text),
m AS (SELECT *, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records * 20 > (SELECT count(DISTINCT record_id) FROM mentions) THEN 'common' END AS mark FROM c)
"""

_SQL = {
    "p8_check": "SELECT pack_name, count(doc_id) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS needless FROM pack_sizes, documents GROUP BY pack_name",
    "p5_values": _VALUES + "SELECT type, text, n, n_records, mark FROM m",
    "p5_ngrams": _VALUES.partition("c AS")[0] + """w AS (SELECT string_split(text, ' ') AS w, record_id FROM v),
k AS (SELECT w, record_id, unnest([1, 2, 3]) AS size FROM w),
g AS (SELECT size, record_id, w, unnest(range(1, len(w) - size + 2)) AS i FROM k)
SELECT size, array_to_string(w[i:i + size - 1], ' ') AS ngram, count(*) AS n, count(DISTINCT record_id) AS n_records FROM g GROUP BY 1, 2""",
    "p5_found": _VALUES + "SELECT type, text, mark FROM m WHERE mark IS NOT NULL",
}


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def _shapes() -> str:
    """VALUES of characters and what a reader sees, from the Unicode data, apart from the operator's tables."""
    rows = {"\t": " ", "\u2010": "-", "\u2011": "-"}
    for c in map(chr, range(0x80, 0x110000)):
        kind, mark = unicodedata.category(c), unicodedata.decomposition(c).split(" ")[0]
        plain = unicodedata.normalize("NFKC", c)
        if kind == "Cf" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef" or c in forms.SHOW_NOTHING:
            rows[c] = ""
        elif kind == "Zs":
            rows[c] = " "
        elif "\ufb00" <= c <= "\ufb06":
            rows[c] = plain
        elif len(plain) == 1 and (mark in ("<wide>", "<narrow>", "<isolated>", "<final>", "<initial>", "<medial>") or mark == "<compat>" and "\u2e80" <= c <= "\u2fdf"):
            rows[c] = plain
        else:
            base, *marks = unicodedata.normalize("NFD", c)
            seen = unicodedata.normalize("NFC", forms.LOOK_ALIKES.get(base, base) + "".join(marks))
            if base in forms.LOOK_ALIKES and len(seen) == 1:
                rows[c] = seen
    text = lambda x: "'" + rows.get(x, x).replace("'", "''") + "'"
    return ", ".join(f"(chr({ord(c)}), {text(x)})" for c, x in rows.items())


def _forms_sql() -> str:
    """doc_id, text, form: character by character through a join."""
    form = "nfc_normalize(replace(replace(coalesce(s, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
    for ring, tail, am, tones in ((0xE4D, 0xE32, 0xE33, range(0xE48, 0xE4C)), (0xECD, 0xEB2, 0xEB3, range(0xEC8, 0xECC))):
        for tone in ("''", *(f"chr({t})" for t in tones)):
            form = f"replace({form}, chr({ring}) || {tone} || chr({tail}), {tone} || chr({am}))"
    return f"""WITH m(c, x) AS (VALUES {_shapes()}), t AS (SELECT doc_id, string_split(text, '') AS cs FROM documents),
u AS (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM t),
j AS (SELECT doc_id, string_agg(coalesce(x, c), '' ORDER BY i) AS s FROM u LEFT JOIN m USING (c) GROUP BY doc_id),
f AS (SELECT d.doc_id, text, CASE WHEN text IS NOT NULL THEN {form} END AS form FROM documents d LEFT JOIN j USING (doc_id)),
g AS (SELECT * FROM f WHERE regexp_matches(form, '[^ \\t\\n]'))
"""


def oracle() -> dict[str, str]:
    made = _forms_sql()
    pairs = "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"
    classes = """SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS links,
count(*) OVER (PARTITION BY form, text) AS copies FROM g QUALIFY links > 0"""
    return _SQL | {"p2_form": made + "SELECT doc_id, form FROM f", "p2_found": made + pairs, "p2_classes": made + classes}
