"""Visual forms: equal looks are equal, others are not; pairs against a plain loop."""

from notelode.llm.visual import look_alike_pairs, with_form

SAME = [
    ("sốt", "so\u0302\u0301t"),
    ("AB 12", "ＡＢ\u300012"),
    ("bom so 7", "bоm\u00a0sо 7"),  # two Cyrillic letters
    ("khoa", "kh\u200boa\ufeff"),
    ("finger", "ﬁnger"),
    ("2-3", "2\u20113"),
    ("日本", "⽇本"),
    ("ต่ำ", "ต่\u0e4d\u0e32"),
    ("Đài", "Ðài"),
]
OTHER = [("10⁹", "109"), ("a b", "a  b"), ("A", "a"), ("x\ny", "x y"), ("o", "0"), ("“a”", '"a"'), ("sot", "sốt"), ("a\n\nb", "a\nb")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r["k"]: r["form"] for r in with_form(df, "k", "text").collect()}


def test_same_and_other(spark):
    got = forms(spark, [t for pair in SAME + OTHER for t in pair])
    for i, pair in enumerate(SAME + OTHER):
        assert (got[2 * i] == got[2 * i + 1]) == (i < len(SAME)), pair


def test_form_is_its_own_form(spark):
    texts = [t for pair in SAME for t in pair]
    once = forms(spark, texts)
    assert forms(spark, [once[i] for i in range(len(texts))]) == once


def test_pairs(spark):
    texts = [t for pair in SAME + OTHER for t in pair] + [None, "", "  ", "\u3000\u3000", "sốt", "sốt", "so\u0302\u0301t"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "k long, t string, form int")
    form = forms(spark, texts)
    want = {
        (i, j)
        for i in range(len(texts))
        for j in range(i + 1, len(texts))
        if texts[i] and texts[j] and texts[i] != texts[j] and form[i] == form[j] and form[i].strip()
    }
    got = [tuple(r) for r in look_alike_pairs(df, "k", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert look_alike_pairs(df.limit(0), "k", "t").count() == 0


def test_copies_are_not_compared(spark):
    df = spark.createDataFrame([(i, "Như trên") for i in range(3000)] + [(3000, "Nhu\u031b trên")], "k long, t string")
    assert look_alike_pairs(df, "k", "t").count() == 3000
