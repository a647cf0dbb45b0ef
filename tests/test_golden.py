"""The golden notes of FIXTURES.md: every row of its table must come out exactly."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from notelode import concepts_json, extract_concepts
from notelode.lexicon import DEFAULT, Lexicon
from notelode.operators import assertions
from notelode.patterns import build

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROW = re.compile(r"\| (G\d\d) \| `(.*?)` \| (.*?) \| ")
CONCEPT = re.compile(r"`(.*)` (\S+) `\[(\d+),(\d+)\]` cand=(\S+|\[.*?\]) assert=(.*)$")


def golden():
    with open(os.path.join(HERE, "FIXTURES.md"), encoding="utf-8") as f:
        for line in f:
            if m := ROW.match(line):
                found = [CONCEPT.match(x) for x in m[3].split("<br>")]
                value = lambda s: None if s == "absent" else json.loads(s)
                yield m[1], json.loads(f'"{m[2]}"'), [
                    (x[1], x[2], value(x[5]), value(x[6]), [int(x[3]), int(x[4])]) for x in found if x
                ]


@pytest.fixture(scope="module")
def got(spark):
    rows = spark.createDataFrame([(i, text) for i, text, _ in golden()], "id string, text string")
    return {r["id"]: r["concepts"] for r in extract_concepts(rows).collect()}


@pytest.mark.parametrize("case", list(golden()), ids=lambda c: c[0])
def test_golden(got, case):
    assert [tuple(c) for c in got[case[0]]] == case[2]


def test_counts():
    assert (len(DEFAULT.drugs), len(DEFAULT.diagnoses), len(DEFAULT.symptoms), len(DEFAULT.labs)) == (174, 67, 87, 49)
    assert len({c for x in DEFAULT.drugs.values() for c in x}) == 155


def test_null_empty_and_marks(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "sốt")], "id int, text string")
    got = {r["id"]: r["concepts"] for r in extract_concepts(rows).collect()}
    assert got[1] is None and got[2] == [] and got[3] == []
    assert [(c.text, c.position) for c in got[4]] == [("sốt", [1, 4])]


def test_json(spark):
    rows = spark.createDataFrame([("đau 12",), (None,)], "text string")
    assert [r["json"] for r in concepts_json(rows).collect()] == [
        '[{"text":"đau","type":"TRIỆU_CHỨNG","assertions":[],"position":[0,3]}]',
        "[]",
    ]


def test_long_text_and_lines(spark):
    text = "- sốt và aspirin 5 mg po daily\n" * 3000 + "po daily " * 20000
    rows = spark.createDataFrame([(1, text), (2, "aspirin " + "po " * 30000)], "id int, text string")
    got = {r["id"]: r["concepts"] for r in extract_concepts(rows).collect()}
    assert len(got[1]) == 6000 and all(text[c.position[0] : c.position[1]] == c.text for c in got[1])
    assert got[2][0].position == [0, 7 + 3 * 30000]


def test_cost_grows_with_the_lines(spark):
    """Ten times as many lines take about ten times as long, in one text."""

    def seconds(n):
        rows = spark.createDataFrame([("- sốt và đau\n" * n,)], "text string")
        began = time.time()
        assert extract_concepts(rows).select(F.size("concepts")).first()[0] == 2 * n
        return time.time() - began

    seconds(1000)
    assert seconds(50_000) < 20 * seconds(5_000) + 2


def test_cues_of_a_line_at_once(spark):
    """has_cue says what a search of everything before the place says."""
    rng = random.Random(4)
    pieces = ["không", "không có", "mẹ", "chưa", "a", " ", ",", "tiền sử", "đã từng", "sốt", "\n", "1", "con", "con trai", "́"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randrange(12))), i) for i in range(400)]
    rows = [(t, i, rng.randrange(len(t) + 1)) for t, i in rows]
    p, low, at = build(DEFAULT), F.col("t"), F.col("at")
    for cues in (p.negation, p.family, p.historical):
        fast = assertions.has_cue(low, at, assertions.cue_end(low, cues), cues, p.longest)
        df = spark.createDataFrame(rows, "t string, i int, at int")
        assert df.filter(~fast.eqNullSafe(assertions.before(low, at).rlike(cues))).count() == 0


def test_empty_lists(spark):
    rows = spark.createDataFrame([("không sốt, Na: 140, aspirin",)], "text string")
    own = Lexicon(drugs={}, diagnoses={}, symptoms=("sốt",), labs=(), negation=(), family=(), historical=(), sections=())
    assert [(c.text, c.assertions) for c in extract_concepts(rows, lexicon=own).first()["concepts"]] == [("sốt", [])]


@pytest.mark.parametrize("term", ["daily-tan", "mg x", "l-dopa"])
def test_drugs_that_begin_in_a_dose(term):
    with pytest.raises(ValueError, match="dose"):
        build(Lexicon(drugs={term: ("1",)}))


def test_own_lexicon_is_checked():
    with pytest.raises(ValueError, match="lower case"):
        Lexicon(symptoms=("Sốt",))
