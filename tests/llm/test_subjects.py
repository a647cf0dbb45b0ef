"""Subject areas: held-out accuracy on the labelled documents, and odd inputs."""

import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from notelode.llm import subjects
from notelode.llm.sentences import Openings
from notelode.llm.subjects import assign, assign_subjects, fit_subjects, language, terms

DATA = "/root/testdata/sf0.1"


def test_languages():
    for text, k in [("Bệnh nhân ổn", 0), ("We saw the cat", 1), ("Der Schlaf war gut", 2), ("Faut-il croire", 3), ("睡眠尚可", 4), ("体温は", 5), ("พบไข้", 6), ("12 %", -1)]:
        assert language(text, text) == k


def test_terms():
    assert terms("12,5 %") == [] and len(terms("dau nguc trai")) == 5 and terms("A b") == terms("x")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_held_out(spark):
    """Half of the labelled documents make the seeds, the other half is asked; some labels are wrong on purpose."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/subject_labels.parquet").distinct()
    names = [r["subject"] for r in spark.read.parquet(f"{DATA}/subjects.parquet").collect()]
    got, want = defaultdict(set), defaultdict(set)
    for r in assign_subjects(docs, "doc_id", "text", labels.filter("pmod(hash(doc_id), 2) = 0"), names).collect():
        got[r["doc_id"]].add(r["subject"])
    for r in labels.filter("pmod(hash(doc_id), 2) = 1").collect():
        want[r["doc_id"]].add(r["subject"])
    hit = sum(len(got[d] & want[d]) for d in want)
    assert 2 * hit / (sum(len(got[d]) for d in want) + sum(map(len, want.values()))) > 0.93


def test_odd_inputs(spark, monkeypatch):
    monkeypatch.setattr(subjects, "RANK", 4)
    rows = [(i, f"Tim đập nhanh nhịp lệch. Mạch vành hẹp dần. Số {i}.", "s") for i in range(30)]
    rows += [(100 + i, "Gan to mềm. Dạ dày loét nông.", "s") for i in range(30)] + [(200 + i, "Hẹn khám lại. Đã dặn dò.", "s") for i in range(300)]
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "12", "s")]
    df = spark.createDataFrame(rows, "d long, t string, subject string")
    labels = spark.createDataFrame([(i, "heart") for i in range(10)] + [(100 + i, "belly") for i in range(10)] + [(0, "heart"), (5, None), (7, "other")], "d long, subject string")
    got = {(r["d"], r["subject"]) for r in assign_subjects(df, "d", "t", labels, ["heart", "belly", "unused"]).collect()}
    assert got == {(i, "heart") for i in range(30)} | {(100 + i, "belly") for i in range(30)}
    assert assign_subjects(df, "d", "t", labels.limit(0), ["heart"]).count() == 0
    assert assign_subjects(df.limit(0), "d", "t", labels, ["heart"]).count() == 0
    assert assign_subjects(df, "d", "t", labels, []).count() == 0


def _small(spark):
    """Two areas of 30 texts each, 40 texts of none, and copies of one text that make up a third of all rows."""
    rows = [(i, f"Tim đập nhanh nhịp lệch. Mạch vành hẹp dần. Số {'bcdghklmrt'[i % 10] * 2} {'auv'[i // 10] * 3}.") for i in range(30)]
    rows += [(100 + i, f"Gan to mềm. Dạ dày loét nông. Số {'bcdghklmrt'[i % 10] * 2} {'xeo'[i // 10] * 3}.") for i in range(30)]
    rows += [(200 + i, f"Hẹn khám lại {'bcdghklmrt'[i % 10] * 2}. Đã dặn dò {'pnsq'[i // 10] * 3}.") for i in range(40)]
    rows += [(300 + i, "Thận ứ nước độ hai. Niệu quản có sỏi nhỏ. Bể thận giãn vừa.") for i in range(50)]
    labels = [(i, "heart") for i in range(10)] + [(100 + i, "belly") for i in range(10)] + [(300 + i, "kidney") for i in range(5)]
    return spark.createDataFrame(rows, "d long, t string"), spark.createDataFrame(labels, "d long, subject string")


def test_copies_make_up_a_third(spark, monkeypatch):
    monkeypatch.setattr(subjects, "RANK", 8)
    df, labels = _small(spark)
    got = {(r["d"], r["subject"]) for r in assign_subjects(df, "d", "t", labels, ["heart", "belly", "kidney"]).collect()}
    assert got == {(i, "heart") for i in range(30)} | {(100 + i, "belly") for i in range(30)} | {(300 + i, "kidney") for i in range(50)}


def test_few_texts_of_a_language(spark, monkeypatch):
    """Copies of one English text and ten different German ones, beside many of another language."""
    monkeypatch.setattr(subjects, "RANK", 8)
    df, labels = _small(spark)
    few = [(400 + i, "The heart was beating fast. The pulse is irregular and weak.") for i in range(24)]
    few += [(500 + i, f"Der Magen ist entzündet {w}. Die Leber war vergrößert {w}.") for i, w in enumerate("aaa bbb ccc ddd eee fff ggg hhh iii jjj".split())]
    df = df.union(spark.createDataFrame(few, df.schema))
    labels = labels.union(spark.createDataFrame([(400, "heart"), (500, "belly"), (501, "belly")], labels.schema))
    got = {(r["d"], r["subject"]) for r in assign_subjects(df, "d", "t", labels, ["heart", "belly", "kidney"]).collect()}
    assert {x for x in got if x[0] >= 400} == {(400 + i, "heart") for i in range(24)} | {(500 + i, "belly") for i in range(10)}


def test_terms_have_numbers_of_their_own(spark):
    """As many numbers as terms, and counts by language and term equal to a plain count."""
    words = [a + b + c + d for a in "bcdghklmnprstvx" for b in "aeiou" for c in "bcdghklmnprstvx" for d in "aeiou"]
    pairs = [f"{a} {b}" for a in words[:150] for b in words[:150]]
    made = [n for w in words for n in terms(w)] + [max(set(terms(p)) - set(terms(p.split()[0])) - set(terms(p.split()[1]))) for p in pairs]
    assert len(set(made)) == len(words) + len(pairs)

    rows = [(["the " + words[i % 7] + " and " + words[i]], i % 3 + 1) for i in range(400)]
    want = defaultdict(lambda: [0, 0])
    for (t,), copies in rows:
        for n in terms(t):
            want[n] = [want[n][0] + 1, want[n][1] + copies]
    df = spark.createDataFrame([(c, [1] * len(x), [terms(t) for t in x]) for x, c in rows], "copies bigint, langs array<int>, terms array<array<bigint>>")
    got = df.mapInArrow(subjects._counted, "lang int, term bigint, texts bigint, documents bigint").groupBy("lang", "term").sum("texts", "documents").collect()
    assert {r[1]: [r[2], r[3]] for r in got} == dict(want) and {r[0] for r in got} == {1}


def test_fit_and_assign_apart(spark, monkeypatch):
    monkeypatch.setattr(subjects, "RANK", 4)
    docs, labels = _small(spark)
    model = fit_subjects(docs, "d", "t", labels, ["heart", "belly", "kidney"])
    want = sorted(map(tuple, assign_subjects(docs, "d", "t", labels, ["heart", "belly", "kidney"]).collect()))
    assert want and sorted(map(tuple, assign(docs, "d", "t", model).collect())) == want
    new = spark.createDataFrame([(1, "Tim đập nhanh nhịp lệch. Mạch vành hẹp dần."), (2, "Hẹn khám lại. Đã dặn dò."), (3, None)], "d long, t string")
    assert [tuple(r) for r in assign(new, "d", "t", model).collect()] == [(1, "heart")]
    assert assign(new.limit(0), "d", "t", model).count() == 0
    assert fit_subjects(docs, "d", "t", labels.limit(0), ["heart"]) is None


def test_sums_come_in_pieces(spark, monkeypatch):
    """Sums of many partitions: few results are shuffled, and no row that the driver gets is larger than a piece."""
    monkeypatch.setattr(subjects, "PIECE", 512, raising=False)
    most = []
    kind = type(spark.range(1))
    collect = kind.collect

    def spy(df):
        rows = collect(df)
        most.extend(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(kind, "collect", spy)
    slots = spark.sparkContext.defaultParallelism

    def run(batches):
        n = sum(x for b in batches for x in b.column(0).to_pylist())
        return {"tasks": np.ones(1, dtype=np.int32), "sum": np.full((3, 100), n, dtype=np.float32), "big": np.full(2, 2**30, dtype=np.int32), "none": np.zeros((0, 2))}

    made = subjects._summed(spark.range(0, 1000, 1, 20 * slots), run)
    assert 0 < made["tasks"][0] <= 4 * slots and made["big"][0] == made["tasks"][0] * 2**30
    assert made["sum"].shape == (3, 100) and (made["sum"] == 499500).all()
    assert 0 < max(most) <= 512
    docs, labels = _small(spark)
    most.clear()
    assert assign_subjects(docs, "d", "t", labels, ["heart", "belly", "kidney"]).count() == 110
    assert 0 < max(most) <= 512


def test_blocks_equal_plain_sums():
    """Places by blocks are those of one sum for each sentence; columns beyond 65,535 are kept as they are."""
    rng = np.random.default_rng(2)
    for width in (300, 70_000):
        docs = [[sorted(rng.choice(width, rng.integers(0, 20), replace=False).tolist()) for _ in range(rng.integers(0, 90))] for _ in range(40)]
        langs = [[int(rng.integers(0, 7)) for _ in x] for x in docs]
        batch = pa.RecordBatch.from_arrays(
            [pa.array([bytes([i]) for i in range(40)]), pa.array([1] * 40), pa.array(langs, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.list_(pa.int64())))], ["h", "copies", "langs", "terms"]
        ).slice(3)
        shared = type("Shared", (), {"value": np.arange(width)})
        (c,) = subjects._chunks(subjects._encoder(shared)(iter([batch])))
        each = [(d, k, x) for d, (ks, xs) in enumerate(zip(langs[3:], docs[3:])) for k, x in zip(ks, xs)]
        assert c.doc.tolist() == [d for d, _, _ in each] and c.lang.tolist() == [k for _, k, _ in each] and c.column.tolist() == [t for _, _, x in each for t in x]
        weight, basis = rng.random((7, width)).astype(np.float32), rng.standard_normal((width, 5)).astype(np.float32)
        v, heavy, share = subjects._Space(weight, 1.0, basis, np.ones(5, dtype=np.float32)).place(c)
        for i, (_, k, x) in enumerate(each):
            y = weight[k, x] @ basis[x] if x else np.zeros(5)
            assert np.allclose(v[i] * np.linalg.norm(y), y, atol=1e-4) and np.isclose(heavy[i], np.linalg.norm(weight[k, x]), atol=1e-4)
            assert np.isclose(share[i], np.linalg.norm(y) / max(heavy[i], 1e-9), atol=1e-4)


def test_terms_by_the_batch():
    """Numbers of many sentences at a time are those of a plain reckoning for each; the languages with terms are listed."""
    import hashlib

    def number(x):
        return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) & (2**63 - 1)

    def plain(s):
        s = s.lower()
        words = [number(w) for w in re.findall("[a-z]{2,}", s)]
        out = {*words, *((a * 31 + b) & (2**63 - 1) for a, b in zip(words, words[1:]))}
        for n, pattern in ((4, "[฀-๿]{4,}"), (2, "[぀-鿿]{2,}")):
            out |= {number(r[i : i + n]) for r in re.findall(pattern, s) for i in range(len(r) - n + 1)}
        return sorted(out)

    said = ["", "12 %", "Dau nguc trai", "dau dau dau", "睡眠尚可 than phien", "ผู้ป่วยมีไข้สูง", "x", "体温は37度", "THE heart the heart"]
    for some in (said, said[:2], [], ["12"]):
        sizes, numbers = subjects._numbered(some)
        assert sizes.tolist() == [len(plain(s)) for s in some] and numbers.tolist() == [n for s in some for n in plain(s)]
    texts = ["Dau nguc trai. The heart was seen.", None, "12 %", "睡眠尚可。"]
    batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"b", b"c", b"d"]), pa.array(texts), pa.array([1] * 4)], ["h", "t", "copies"])
    (got,) = subjects._sentences(batch, Openings())
    for langs, found, spoken in zip(*(got.column(x).to_pylist() for x in ("langs", "terms", "spoken"))):
        assert spoken == sorted({k for k, x in zip(langs, found) if x})
