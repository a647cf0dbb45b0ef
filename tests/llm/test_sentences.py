"""Sentences: hand-cut examples, and that every character is in exactly one."""

import random

import pytest

from notelode.llm.sentences import Openings, counted, fit, sentences, split

CASES = [
    ("Theo BS. trực, mạch 82. Bàn giao: ho, sốt, v.v. Đã dặn dò kỹ!", 3),
    ("Ca trực ghi: v.v. đều đã in. Kali 2.1. Sáng nay ổn.", 3),
    ('Nhóm ghi: “Để tôi xem. Đừng vội!” rồi chuyển sang việc khác.', 1),
    ('Người trực hỏi: "Liệu có nặng lên không?" và chưa ai trả lời.', 1),
    ("Vì mưa nên phải gọi thêm người… nhưng không kịp. Chờ ý kiến hội chẩn… Đã dặn dò kỹ!", 3),
    ("Tóm tắt:\n- Sốt nhẹ\n- Ho khan, v.v.\nĐã dặn dò kỹ!", 4),
    ("Gãy kín mắt cá ngoài nên phải gọi thêm người đến hỗ trợ ngay, khác\nvới bản ghi cũ. Đã dặn dò kỹ!", 2),
    ("Seen by Dr. Ann Lee on the ward. See sect. 10.3 for details, i.e. page 4. Nothing else changed!", 3),
    ("Dr. vom Dienst vermerkte: u. a. Husten, z. B. am 3. Tag. Sonst nichts Neues!", 2),
    ("« Pas d'urgence ! » a dit l'équipe. Voir le bon no. HD/25. Rien d'autre à signaler !", 3),
    ("护士说：“先观察。别着急！”随后记录了咳嗽。睡眠尚可。11月5日复查！其余无变化。", 4),
    ("「様子を見ましょう。急がなくていい。」と当直は述べた。その他に変化なし！体温38.3℃。", 3),
    ("ผู้ป่วยนอนหลับดี พบข้อไหล่ติดมา 7 วัน ดูใบเลขที่ KD.0734615 อุณหภูมิ 39.1 องศา", 4),
    ("วันที่ 14-11-2025 พบไข้อีก ให้ยา 2 มก. วันละ 2 ครั้ง", 2),
]


@pytest.mark.parametrize(("text", "n"), CASES)
def test_cases(text, n):
    assert len(split(text)) == n, [text[b:e] for b, e in split(text)]


def test_every_character_once():
    rng = random.Random(5)
    parts = ["BS. trực", "v.v.", "。", "“", "”", "\n", "\n\n", "- ", "1. ", "Đã dặn.", " ", "\u200b", "ไทย ", "x!", "?", "...", "\u3000", "😀", "e\u0301"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        seen = [0] * len(text)
        for b, e in split(text):
            assert b < e and not text[b].isspace() and not text[e - 1].isspace()
            for i in range(b, e):
                seen[i] += 1
        assert all(n == 1 or (n == 0 and (c.isspace() or c == "\u200b")) for n, c in zip(seen, text)), repr(text)


def test_many_ends_that_are_none():
    text = "Bệnh nhân nói" + " a... b" * 16 + " rồi ngủ."
    assert split(text) == [(0, len(text))]


OTHERS = [
    ("Tôi đi chợ mua cá. mẹ tôi nấu cơm. trời mưa to.", 3),
    ("Mr. Smith met Rev. Jones. Gen. Lee left.", 2),
    ("He works at I.B.M. in N.Y. It is 3.5 km away. He paid $4.50.", 3),
    ("Am 6. Tag kam er. Z. B. mit Fieber.", 2),
    ("यह एक वाक्य है। यह दूसरा है।", 2),
    ("هل أنت بخير؟ نعم أنا بخير.", 2),
]


@pytest.mark.parametrize(("text", "n"), OTHERS)
def test_texts_of_other_kinds(text, n):
    assert len(split(text)) == n, [text[b:e] for b, e in split(text)]


def test_openings_are_learned_without_labels():
    starts = ["Gọi lại", "Mời ông", "Xin bà"]
    texts = [f"- {starts[i % 3]} vào ngày {i}. {starts[(i + 1) % 3]} ra ngày {i}, xem thêm abb. {i} bên dưới" for i in range(60)]
    known = Openings.of(counted(texts))
    careless = "gọi lại lúc chiều mời ông sang ngay. xin bà chờ"
    assert [careless[b:e] for b, e in split(careless, known)] == ["gọi lại lúc chiều", "mời ông sang ngay.", "xin bà chờ"]
    assert len(split(careless)) < 3


def test_counts_of_parts_add_up(spark):
    texts = [f"- Gọi lại ngày {i}. Mời ông v.v. Xin bà" for i in range(30)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", " "]], "t string")
    assert fit(df, "t") == Openings.of(counted(texts))
    assert fit(df.limit(0), "t") == Openings()


@pytest.mark.parametrize(("a", "b"), ["“”", "«»", '""', "„“"])
@pytest.mark.parametrize("n", [2, 4, 7, 40])
def test_quoted_speech_stays_whole(a, b, n):
    said = ". ".join(["Tôi đau ngực", "Tôi khó thở", "Tôi ngủ kém", "Tôi ăn ít", "Tôi sốt cao", "Tôi ho khan", "Tôi mệt lắm"][i % 7] for i in range(n))
    text = f"Bà kể: {a}{said}.{b} Đã khám. Đã dặn."
    assert [text[x:y] for x, y in split(text)] == [f"Bà kể: {a}{said}.{b}", "Đã khám.", "Đã dặn."]


def test_mark_left_open():
    assert len(split("Bà kể “đau ngực. Đã khám. Đã dặn. Hẹn tái khám.")) == 4


def test_table(spark):
    long = "Đã dặn dò kỹ! " * 4000
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, " \n\t", 3), (4, "A. ", 4), (5, long, 5), (5, "Một.", 6)], "k int, text string, t int")
    rows = sentences(df, "k", "text").collect()
    assert sorted((r["k"], r["end_pos"]) for r in rows if r["k"] != 5) == [(4, 2)]
    assert sum(r["k"] == 5 for r in rows) == 4001
    assert sentences(df.limit(0), "k", "text").count() == 0
