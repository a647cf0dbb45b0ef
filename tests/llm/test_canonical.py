"""Mapping to a reference list: forms, distances, misses, and against a full search."""

import random

import pytest
from pyspark.sql import functions as F

from notelode.llm import canonical
from notelode.llm.canonical import DIAGNOSES, DRUGS, Matcher, allowed, distance, map_to_reference, within

DRUG = ["falfugephenadrol", "kelbelioxanide", "kelbelioxanide XR", "clegefumabutrin", "quolooxanide", "bradaprazone"]
DIAG = ["xơ hóa ống lệ giai đoạn sớm", "thoái hóa ống lệ hai bên", "rò bao gân duỗi", "viêm củng mạc", "nang da đầu"]


@pytest.mark.parametrize(
    ("text", "term"),
    [
        ("Falfugephenadrol 20 mg po daily", DRUG[0]), ("ｆａｌｆｕｇｅｐｈｅｎａｄｒｏｌ", DRUG[0]), ("h/c falfugehpenadrol: 5 mg bid", DRUG[0]),
        ("kelbelioxanid XR 10 mg", DRUG[2]), ("kelbelioxanide 10mg", DRUG[1]), ("KLEGEFUMABUTRIEN", DRUG[3]),
        ("quоlоoхanіdе 25mg", DRUG[4]), ("quoloo\u200bxanide", DRUG[4]), ("THUỐC BRADAPRAZON", DRUG[5]), ("quolooksanid", DRUG[4]),
        ("tavcuzepril 2 mg", None), ("?", None), ("", None), ("   ", None), ("12 mg", None), ("như đơn cũ", None), (None, None),
    ],
)
def test_drugs(text, term):
    assert Matcher.of([(t, 1) for t in DRUG], DRUGS).match(text)[0] == term


@pytest.mark.parametrize(
    ("text", "term"),
    [
        ("XO HOA ONG LE GIAI DOAN SOM", DIAG[0]), ("xow hoas oongs leej giai ddoanj sowms", DIAG[0]), ("x. hóa ống lệ giai đoạn sớm", DIAG[0]),
        ("XHOLGDS", DIAG[0]), ("T.H.O.L.H.B", DIAG[1]), ("thoaihoaonglehaiben", DIAG[1]), ("rò_bao_gân_duỗi", DIAG[2]), ("ro bao gan duio", DIAG[2]),
        ("viem\u00a0cung\u00a0mac", DIAG[3]), ("nand da đầu", DIAG[4]), ("bong gân gò má", None), ("chưa rõ", None), ("XYZ", None),
    ],
)
def test_diagnoses(text, term):
    assert Matcher.of([(t, 1) for t in DIAG], DIAGNOSES).match(text)[0] == term


@pytest.mark.parametrize(("profile", "entries", "letters"), [(DRUGS, DRUG, "abcxyz"), (DIAGNOSES, DIAG, "aeioưạhg ")])
@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_search_finds_what_a_full_search_finds(profile, entries, letters, edits):
    """Every entry within the bound is found: the answer is that of trying all, by distance, frequency and name."""
    rng = random.Random(edits)
    often = {t: i % 2 for i, t in enumerate(entries)}
    m = Matcher.of(often.items(), profile)
    for _ in range(300):
        s = list(rng.choice(entries).lower())
        for _ in range(edits):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [s[i], s[i]], [rng.choice(letters)], [rng.choice(letters), s[i]]]) or [" "]
        text = "".join(s)
        full = []
        for kind, key in profile.keys(profile.clean(text)):
            for t in entries:
                for of, form in profile.forms(t):
                    if of == kind and key and (key == form or kind != "initials" and within(key, form, allowed(key))):
                        full.append((round(distance(key, form, 9), 3), -often[t], t))
        assert m.match(text) == ((min(full)[2], min(full)[0]) if full else (None, -1.0)), text


def test_keystrokes_of_short_entries():
    assert Matcher.of([("sởi", 1), ("gút", 1)], DIAGNOSES).match("sowir") == ("sởi", 0.0)


def test_frequency_breaks_ties():
    m = Matcher.of([("abcdefgh", 1), ("abcdefgk", 9)], DRUGS)
    assert m.match("abcdefgm")[0] in ("abcdefgh", "abcdefgk")
    assert Matcher.of([("abcdefgv", 1), ("abcdefgt", 9)], DRUGS).match("abcdefgq")[0] == "abcdefgt"


def test_table(spark, monkeypatch):
    rows = [(1, "drug", "bradaprazon"), (2, "drug", None), (3, None, "x"), (4, "diagnosis", "nang da dau"), (5, "other", "y"), (6, "drug", "z" * 20000)]
    df = spark.createDataFrame(rows, "id long, type string, text string").withColumn("term", F.lit("clash"))
    refs = {
        "drug": spark.createDataFrame([(t, 1) for t in [*DRUG, None, DRUG[0]]], "term string, frequency long"),
        "diagnosis": spark.createDataFrame([(t, None) for t in DIAG], "term string, frequency long"),
    }
    want = {1: "bradaprazone", 2: None, 3: None, 4: "nang da đầu", 5: None, 6: None}
    for most in (canonical.BROADCAST, 2):  # a short list, and one that is too long to be broadcast
        monkeypatch.setattr(canonical, "BROADCAST", most)
        got = map_to_reference(df, "id", F.col("type"), F.col("text"), refs).collect()
        assert {r["id"]: r["term"] for r in got} == want and len(got) == 6
    empty = {k: v.limit(0) for k, v in refs.items()}
    assert {r["term"] for r in map_to_reference(df, "id", F.col("type"), F.col("text"), empty).collect()} == {None}
    assert map_to_reference(df.limit(0), "id", F.col("type"), F.col("text"), refs).count() == 0


def test_long_lists_choose_like_short(spark, monkeypatch):
    """Ties are decided by frequency, and repeated keys keep a row each, however long the list is."""
    entries = [("abcdefgv", 9), ("abcdefgt", 1), ("hijklmno", 1), ("hijklmnr", 5), *((t, 1) for t in DRUG)]
    texts = ["abcdefgq", "abcdefgq", "hijklmnq", "abcdefgv", "bradaprazon", "nothing like it", None]
    df = spark.createDataFrame([(i // 2, "drug", t) for i, t in enumerate(texts)], "id long, type string, text string")
    refs = {"drug": spark.createDataFrame([(t, n) for t, n in entries], "term string, frequency long")}
    made = []
    for most in (canonical.BROADCAST, 1):
        monkeypatch.setattr(canonical, "BROADCAST", most)
        made.append(sorted(map(str, map_to_reference(df, "id", F.col("type"), F.col("text"), refs).collect())))
    assert len(made[0]) == len(texts) and made[0] == made[1]
    assert sum("'abcdefgv'" in r for r in made[0]) == 3
