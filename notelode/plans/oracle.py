"""The queries of queries.py in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

from notelode.lexicon import DEFAULT
from notelode.plans.queries import TEMPLATES

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
M = "chr(57344)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _esc(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in term)


def _alt(terms) -> str:
    return "|".join(_esc(t) for t in sorted(terms, key=lambda t: (-len(t), t)))


def _values(terms: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"({_q(t)}, {_q('|'.join(c))})" for t, c in terms.items())


def _parts(name: str, source: str, pattern: str, groups: int) -> str:
    """CTEs name_p (parts with their places) and name (matches): g1.. texts, b1.. places where each group begins, e."""
    shown = f"{M} || " + f" || {M} || ".join(_q(f"\\{i + 1}") for i in range(groups)) + f" || {M}"
    cols = ", ".join(f"max(part) FILTER (WHERE i % {groups + 1} = {k}) AS g{k}, max(pos) FILTER (WHERE i % {groups + 1} = {k}) AS b{k}" for k in range(1, groups + 1))
    return f"""
{name}_s AS (SELECT id, line_no, line, string_split(regexp_replace(translate(line, {M}, chr(63743)), {_q(pattern)}, {shown}, 'g'), {M}) AS ps FROM {source}),
{name}_p AS (SELECT id, line_no, line, unnest(ps) AS part, unnest(range(len(ps))) AS i FROM {name}_s WHERE len(ps) > 1),
{name}_o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM {name}_p),
{name} AS (SELECT id, line_no, any_value(line) AS line, i // {groups + 1} AS k, {cols}, max(pos + length(part)) AS e
  FROM {name}_o WHERE i % {groups + 1} > 0 GROUP BY id, line_no, i // {groups + 1}),"""


def _has(column: str, cues) -> str:
    return f"regexp_matches({column}, {_q('(^|[^\\p{L}\\p{N}_])(' + '|'.join(map(_esc, cues)) + ')($|[^\\p{L}\\p{N}_])')})"


def _free(alias: str, s: str, e: str, taken: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.id = {alias}.id AND t.line_no = {alias}.line_no AND {alias}.{s} < t.e AND {alias}.{e} > t.s)"


def _chain(source: str) -> str:
    # The forms of doses, and of lab names, links and values.
    amount = r"\p{Nd}+[.,]?\p{Nd}*"
    dose = (
        rf"(?:[,:]|{WS})*(?:{amount}(?:-{amount})?{WS}*(?:mg|mcg|g|ml|iu|units|unit|meq)\b(?:/(?:ml|mg|g))?|(?:mg|mcg|g|ml)\b"
        r"|po|iv|im|sc|subcut|subq|pr|sl|top|inh|neb|oral|suspension|tablet|tablets|capsule|capsules|cream|ointment|drops|syrup"
        r"|inhaler|patch|injection|solution|elixir|daily|qd|bid|tid|qid|qhs|qam|qpm|prn|q\p{Nd}+h|q\p{Nd}+-\p{Nd}+h|weekly"
        rf"|x{WS}*\p{{Nd}}+|extended[- ]release|xl|xr|er|cr|sr)\b"
    )
    lab = (
        rf"(?i)([a-zA-ZÀ-ỹ][a-zA-ZÀ-ỹ0-9 %/\-]{{1,40}}?(?:{WS}*\([^)]{{1,60}}\))?)({WS}*(?:là|:){WS}*)"
        rf"(-?\p{{Nd}}+[.,]?\p{{Nd}}*{WS}*(?:mg/dl|mmol/l|g/dl|%|u/l|/mm3)?)"
    )
    strip = lambda c: f"regexp_replace({c}, {_q(f'^{WS}+|{WS}+$')}, '', 'g')"
    listed = " OR ".join(f"contains(low, {_q(h)})" for h in DEFAULT.sections)
    fragment = " OR ".join(f"contains(lower({strip('g1')}), {_q(a)})" for a in DEFAULT.labs)
    return f"""WITH notes AS ({source}),
ls AS (SELECT id, string_split(text, chr(10)) AS l FROM notes),
raw AS (SELECT id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM ls),
lines AS (SELECT id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start,
  {strip('line')} AS s, lower({strip('line')}) AS low,
  regexp_matches(line, {_q(rf'^{WS}*\p{{Nd}}+\.(?s:.)')}) AS header FROM raw),
kinds AS (SELECT *, s = '' AS blank, NOT header AND s <> '' AND NOT starts_with(s, '-') AND (ends_with(s, ':') OR length(s) < 60) AS sub,
  ({listed}) AS listed FROM lines),
events AS (SELECT *, CASE WHEN blank THEN NULL WHEN header THEN contains(low, 'tiền sử') OR listed
  WHEN sub THEN CASE WHEN listed THEN true WHEN contains(low, 'hiện tại') OR contains(low, 'lý do nhập viện') OR contains(low, 'khi nhập viện') THEN false END END AS event,
  CASE WHEN header AND NOT blank THEN CASE WHEN contains(low, 'tiền sử') THEN 'history' WHEN contains(low, 'hiện tại') THEN 'present' ELSE 'hospital' END END AS top FROM kinds),
states AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER w, false) AS historical, last_value(top IGNORE NULLS) OVER w AS top_section
  FROM events WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{_parts('drug', 'lines', rf'(?i)({_alt(DEFAULT.drugs)})((?:{dose})*)', 2)}
{_parts('diag', 'lines', rf'(?i)({_alt(DEFAULT.diagnoses)})', 1)}
{_parts('symp', 'lines', rf'(?i)({_alt(DEFAULT.symptoms)})', 1)}
{_parts('lab_all', 'lines', lab, 3)}
lab AS (SELECT *, b1 + length(g1) AS e1 FROM lab_all WHERE {fragment}),
drug_lex AS (SELECT * FROM (VALUES {_values(DEFAULT.drugs)}) AS v(term, codes)),
diag_lex AS (SELECT * FROM (VALUES {_values(DEFAULT.diagnoses)}) AS v(term, codes)),
t1 AS (SELECT id, line_no, 'drug' AS kind, b1 AS s, e, lower(g1) AS term FROM drug),
t2 AS (SELECT * FROM t1 UNION ALL SELECT id, line_no, 'diagnosis', b1, e, lower(g1) FROM diag WHERE {_free('diag', 'b1', 'e', 't1')}),
lab_ok AS (SELECT * FROM lab WHERE {_free('lab', 'b1', 'e1', 't2')} AND {_free('lab', 'b3', 'e', 't2')}),
t3 AS (SELECT * FROM t2 UNION ALL SELECT id, line_no, 'lab', b1, e1, 'name' FROM lab_ok UNION ALL SELECT id, line_no, 'lab', b3, e, 'value' FROM lab_ok),
t4 AS (SELECT * FROM t3 UNION ALL SELECT id, line_no, 'symptom', b1, e, '' FROM symp WHERE {_free('symp', 'b1', 'e', 't3')}),
heads AS (SELECT t4.*, states.line, line_start, historical, left(lower(line), t4.s) AS head FROM t4 JOIN states USING (id, line_no)),
flags AS (SELECT *, {_has('head', DEFAULT.negation)} AS neg, {_has('head', DEFAULT.family)} AS fam,
  CASE WHEN kind = 'symptom' THEN regexp_matches(head, '(?s)tiền sử.{{0,12}}$') ELSE historical OR {_has('head', DEFAULT.historical)} END AS hist FROM heads),
concepts AS (SELECT id, CASE kind WHEN 'drug' THEN 'THUỐC' WHEN 'diagnosis' THEN 'CHẨN_ĐOÁN' WHEN 'symptom' THEN 'TRIỆU_CHỨNG' ELSE CASE term WHEN 'name' THEN 'TÊN_XÉT_NGHIỆM' ELSE 'KẾT_QUẢ_XÉT_NGHIỆM' END END AS type,
  substring(line, s + 1, e - s) AS text, line_start + s AS s, line_start + e AS e,
  CASE kind WHEN 'drug' THEN coalesce((SELECT any_value(codes) FROM drug_lex x WHERE x.term = flags.term), '') WHEN 'diagnosis' THEN coalesce((SELECT any_value(codes) FROM diag_lex x WHERE x.term = flags.term), '') END AS candidates,
  CASE WHEN kind <> 'lab' THEN array_to_string(list_filter([CASE WHEN neg THEN 'isNegated' END, CASE WHEN fam THEN 'isFamily' END, CASE WHEN hist THEN 'isHistorical' END], lambda x: x IS NOT NULL), '|') END AS assertions
  FROM flags)
"""


def oracle() -> dict[str, str]:
    templates = ", ".join(map(_q, TEMPLATES))
    docs = _chain(f"SELECT doc_id AS id, [{templates}][doc_id % {len(TEMPLATES)} + 1] || chr(10) || coalesce(text, '') AS text FROM documents")
    newlines = "regexp_replace(text, '\r\n?', chr(10), 'g')"
    files = _chain(f"SELECT file_id AS id, {newlines} AS text FROM note_files")
    scan = "SELECT id AS doc_id, line_no, b1 AS s, {e} AS e, substring(line, b1 + 1, {e} - b1) AS text"
    state = "SELECT id AS doc_id, line_no, historical FROM states"
    body = {
        "line_split": "SELECT id AS doc_id, line_no, line FROM raw",
        "line_offsets": "SELECT id AS doc_id, line_no, line_start, length(line) AS n FROM lines",
        "blank_filter": "SELECT id AS doc_id, line_no FROM kinds WHERE NOT blank",
        "header_lines": "SELECT id AS doc_id, line_no, line FROM kinds WHERE header AND NOT blank",
        "subheader_lines": "SELECT id AS doc_id, line_no, line FROM kinds WHERE sub",
        "section_event": "SELECT id AS doc_id, line_no, coalesce(event::VARCHAR, 'keep') AS event FROM events",
        "section_state": state,
        "section_state_in_row": state,
        "top_section": "SELECT id AS doc_id, line_no, top_section FROM states",
        "drug_scan": scan.format(e="(b1 + length(g1))") + " FROM drug",
        "dose_extension": scan.format(e="e") + ", g2 AS dose FROM drug",
        "diagnosis_scan": scan.format(e="e") + " FROM diag",
        "symptom_scan": scan.format(e="e") + " FROM symp",
        "lab_pairs": "SELECT id AS doc_id, line_no, b1 AS name_s, e1 AS name_e, b3 AS value_s, e AS value_e, substring(line, b1 + 1, e1 - b1) AS name, substring(line, b3 + 1, e - b3) AS value FROM lab",
        "drug_codes": "SELECT id AS doc_id, line_no, b1 AS s, lower(g1) AS term, coalesce(codes, '') AS codes FROM drug LEFT JOIN drug_lex ON term = lower(g1)",
        "diagnosis_codes": "SELECT id AS doc_id, line_no, b1 AS s, lower(g1) AS term, coalesce(codes, '') AS codes FROM diag LEFT JOIN diag_lex ON term = lower(g1)",
        "overlap_antijoin": "SELECT id AS doc_id, line_no, kind, s, e FROM t4",
        "assert_negated": "SELECT id AS doc_id, line_no, s, neg AS negated FROM flags WHERE kind <> 'lab'",
        "assert_family": "SELECT id AS doc_id, line_no, s, fam AS family FROM flags WHERE kind <> 'lab'",
        "assert_historical": "SELECT id AS doc_id, line_no, s, hist FROM flags WHERE kind IN ('drug', 'diagnosis')",
        "symptom_proximity": "SELECT id AS doc_id, line_no, s, hist FROM flags WHERE kind = 'symptom'",
        "assertion_list": "SELECT f.id AS doc_id, f.line_no, f.s, array_to_string(list_filter([CASE WHEN neg THEN 'isNegated' END, CASE WHEN fam THEN 'isFamily' END, CASE WHEN hist THEN 'isHistorical' END], lambda x: x IS NOT NULL), '|') AS assertions FROM flags f WHERE kind <> 'lab'",
        "concepts_union": "SELECT id AS doc_id, type, text, s, e, candidates, assertions FROM concepts",
        "concepts_sorted": "SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY s, e) - 1 AS rank, type, s, e FROM concepts",
        "concepts_per_doc": "SELECT n.id AS doc_id, coalesce(string_agg(type || '~' || s || '~' || c.text, '|' ORDER BY s, e), '') AS found FROM notes n LEFT JOIN concepts c ON c.id = n.id GROUP BY n.id",
        "concepts_json": """SELECT n.id AS doc_id, '[' || coalesce(string_agg('{"text":' || to_json(c.text)::VARCHAR || ',"type":"' || type || '"'
  || CASE WHEN candidates IS NULL THEN '' WHEN candidates = '' THEN ',"candidates":[]' ELSE ',"candidates":["' || replace(candidates, '|', '","') || '"]' END
  || CASE WHEN assertions IS NULL THEN '' WHEN assertions = '' THEN ',"assertions":[]' ELSE ',"assertions":["' || replace(assertions, '|', '","') || '"]' END
  || ',"position":[' || s || ',' || e || ']}', ',' ORDER BY s, e), '') || ']' AS json FROM notes n LEFT JOIN concepts c ON c.id = n.id GROUP BY n.id""",
        "concept_counts": "SELECT type, count(*) AS n, count(DISTINCT id) AS n_docs FROM concepts GROUP BY type",
    }
    ranked = f"SELECT *, CASE WHEN text IS NOT NULL AND record_id IS NOT NULL THEN row_number() OVER (PARTITION BY record_id, {newlines} ORDER BY written_at, file_id) ELSE 1 END AS rn FROM note_files"
    return {name: docs + sql for name, sql in body.items()} | {
        "file_record_ids": r"SELECT file_id, regexp_extract(file_name, '([^/]*)\.txt$', 1) AS stem FROM note_files",
        "newline_translation": f"SELECT file_id, length({newlines}) AS n, CASE WHEN text IS NOT NULL THEN len(string_split({newlines}, chr(10))) END AS n_lines FROM note_files",
        "file_order": "SELECT file_id, row_number() OVER (PARTITION BY ward ORDER BY try_cast(record_id AS DECIMAL(38, 0)), record_id, file_id) AS place FROM note_files",
        "file_concepts": files + "SELECT id AS file_id, type, text, s, e FROM concepts",
        "streamed_concepts": files + "SELECT id AS file_id, type, text, s, e FROM concepts",
        "lexicon_source": """SELECT DISTINCT 'drug' AS kind, lower(term) AS term, code AS codes FROM drug_lexicon
UNION ALL SELECT DISTINCT 'diagnosis', lower(term), array_to_string(codes, '|') FROM diagnosis_lexicon
UNION ALL SELECT DISTINCT 'symptom', lower(term), '' FROM symptom_lexicon UNION ALL SELECT DISTINCT 'lab', lower(abbr), '' FROM lab_lexicon""",
        "p6_found": f"SELECT file_id FROM ({ranked}) WHERE rn > 1",
        "p6_store": f"SELECT record_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM ({ranked}) WHERE rn = 1 GROUP BY record_id",
        "run_summary": "SELECT count(*) AS n_files, count(text) AS n_read FROM note_files",
    }
