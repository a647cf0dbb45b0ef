"""Personal items: examples of every kind and disguise, things that aren't personal, and that the rest stays."""

import pytest

from notelode.llm import personal
from notelode.llm.personal import find, personal_items, redact, redacted

CASES = [
    ("Gọi số 0549 502973 nếu có kết quả.", [("phone", "0549 502973")]),
    ("Zalo +84 549 310 256 không ai nghe?", [("phone", "+84 549 310 256")]),
    ("Số cũ (0240) 3914.893, số mới 0954.311.065.", [("phone", "(0240) 3914.893"), ("phone", "0954.311.065")]),
    ("máy không năm bốn ba năm bảy không sáu hai không.", [("phone", "không năm bốn ba năm bảy không sáu hai không")]),
    ("Zalo không chín năm bảy một tám ba tám tám bảy không ai nghe?", [("phone", "không chín năm bảy một tám ba tám tám bảy")]),
    ("called from 555 555 0137 ext. 4 at 8:28.", [("phone", "555 555 0137 ext. 4")]),
    ("Frau Edelgard von Krötzinger ist unter +49 (0)30 23125-033 erreichbar.", [("name", "Edelgard von Krötzinger"), ("phone", "+49 (0)30 23125-033")]),
    ("Mme Aubine Courtavel est joignable au 01.99.00.01.21.", [("name", "Aubine Courtavel"), ("phone", "01.99.00.01.21")]),
    ("患者陆屿屿，电话+86 000 5550 6863。", [("name", "陆屿屿"), ("phone", "+86 000 5550 6863")]),
    ("gửi trac_tieu[at]hoso[dot]vansao[dot]test nhưng bị dội", [("email", "trac_tieu[at]hoso[dot]vansao[dot]test")]),
    ("về huu.giap (a) hoso . vansao . test trong ngày.", [("email", "huu.giap (a) hoso . vansao . test")]),
    ("ส่งผลไปที่ jarvis.oakenbury＠post.harrowmere.example", [("email", "jarvis.oakenbury＠post.harrowmere.example")]),
    ("CCCD 098 743 088 339 đã đối chiếu.", [("id_number", "098 743 088 339")]),
    ("Thẻ BHYT: TE 1 97 78828 51205", [("id_number", "TE 1 97 78828 51205")]),
    ("Passport XQ 0722776 was copied.", [("id_number", "XQ 0722776")]),
    ("证件号99390619661007698X已核对。", [("id_number", "99390619661007698X")]),
    ("Người giám hộ: Doãn Vân Bội, 19A Nắng Sớm, Q. Cẩm Đài.", [("name", "Doãn Vân Bội"), ("address", "19A Nắng Sớm, Q. Cẩm Đài")]),
    ("Bà MẠC THOA (số định danh 097592771220) xin ra viện.", [("name", "MẠC THOA"), ("id_number", "097592771220")]),
    ("ở số 143, ngõ 24, đường Cây Thị, phường Vân Sào, thành phố Mộc Tùng; nay", [("address", "số 143, ngõ 24, đường Cây Thị, phường Vân Sào, thành phố Mộc Tùng")]),
    ("• Châu Lãm Trác - 979628519 - 0957 453 761", [("name", "Châu Lãm Trác"), ("id_number", "979628519"), ("phone", "0957 453 761")]),
    ("Cậu D​oãn V​ân Bội", [("name", "D​oãn V​ân Bội")]),
    ("Lives at Flat 248, Old Weir Court, Munkwell with a sister.", [("address", "Flat 248, Old Weir Court, Munkwell")]),
    ("住所は白霧市みどり台3-156-7。", [("address", "白霧市みどり台3-156-7")]),
    # Things, not persons.
    ("Mẫu số 0846.661.855 đã chuyển lúc 14h57. Máy bơm số 0897387.967 đang bảo trì.", []),
    ("Sample no. SP 37.470582 left at 1h00. Filed under LT00001948.", []),
    ("Truyền dịch tốc độ 79 ml/giờ @ bơm số 7. Hết cao Hạc Vân. Thang điểm Mộc Khuê được 4 điểm.", []),
    ("Lô thuốc V9407-T, hạn dùng 4.5.2024. Họp lại ở phòng 4/114 nhà C.", []),
]


@pytest.mark.parametrize(("text", "items"), CASES)
def test_cases(text, items):
    assert [(k, text[b:e]) for k, b, e in find(text)] == items


# A shortest match of every pattern of an address, and of each choice that has a word of its own.
ADDRESSES = [
    *(f"So 1, {x} 1, {y} A, {z}B, {w}C" for x in ("ngo", "hem", "ngach", "kiet") for y in ("duong", "pho") for z in ("phuong", "xa", "thi tran", "P.") for w in ("thanh pho", "TP.", "tinh")),
    *(f"1/1 {y} A, {z}B, {w}C" for y in ("duong", "pho") for z in ("phuong", "P.") for w in ("thanh pho", "TP.")),
    *(f"1 A, {z}B" for z in ("Q.", "quan", "P.", "phuong", "TP.", "huyen")),
    "Can 1 chung cu A, duong B, C",
    *(f"To 1 khu pho A, {z} B" for z in ("thi tran", "phuong", "xa")),
    *(f"{x} 1, xa A, {z} B" for x in ("Thon", "Ap", "Xom", "Ban", "Khu", "Doi") for z in ("huyen", "thi xa")),
    *(f"1 A {x}, Bb" for x in ("Close", "Row", "Lane", "Street", "Road", "Avenue", "Court", "Hill", "Way")),
    *(f"Flat 1, Aa {x}, Bb" for x in ("Court", "House", "Tower", "Mansions")),
    *(f"Aa{x} 1, Bb" for x in ("stieg", "weg", "gasse", "platz", "allee", "strasse", "straße", "str.")),
    *(f"1, {x}Aa, Bb" for x in ("rue", "av.", "avenue", "bd", "boulevard", "chemin", "place")),
    "现住白霧市山山1号",
    "住所は山市山1",
    "1 หมู่ 1 ตำบลก",
    "1 ถนนก เมืองก",
]


@pytest.mark.parametrize("address", ADDRESSES)
def test_no_address_is_passed_over(address):
    assert any(p.search(address) and any(w in address for w in words) for words, p in zip(personal._PLACES, personal._ADDRESSES, strict=True))


def test_every_address_pattern_is_asked():
    assert all(any(p.search(a) for a in ADDRESSES) for p in personal._ADDRESSES)
    text = "Ở 12 Hòa Bình, phường Bến Lau, từ lâu."
    assert [(k, text[b:e]) for k, b, e in find(text)] == [("address", "12 Hòa Bình, phường Bến Lau")]


def test_rest_stays():
    text = "Gọi số 0549 502973 nếu\r\ncó kết quả. BS. Vương Sĩ Vĩnh ký."
    assert redact(text) == "Gọi số [PHONE] nếu\r\ncó kết quả. BS. [NAME] ký."
    for text, items in CASES:
        if not items:
            assert redact(text) == text


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Gọi số 0549 502973.", "x"), (3, "Gọi số 0549 502973.", "y"), (4, "ổn " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc long, note string, kind string")
    got = personal_items(df, "doc", "note").collect()
    assert [tuple(r) for r in got] == [(3, "phone", 7, 18)] * 2
    assert sorted((r["doc"], r["text"]) for r in redacted(df, "doc", "note").collect() if r["doc"] < 4 and r["text"]) == [(3, "Gọi số [PHONE].")] * 2
    assert redacted(df, "doc", "note").filter("text IS NULL").count() == 1
    assert personal_items(df.limit(0), "doc", "note").count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "item"),
    [
        ("Write to anna.k at example dot com today.", "email", "anna.k at example dot com"),
        ("Gửi về lan chấm tran a còng mail chấm vn nhé", "email", "lan chấm tran a còng mail chấm vn"),
        ("Tel.: null drei null, acht sieben sechs fünf vier drei zwei eins", "phone", "null drei null, acht sieben sechs fünf vier drei zwei eins"),
        ("zéro un deux trois quatre cinq six sept huit neuf", "phone", "zéro un deux trois quatre cinq six sept huit neuf"),
        ("联系电话零九零一二三四五六七八。", "phone", "零九零一二三四五六七八"), ("โทร ศูนย์แปดหนึ่งสองสามสี่ห้าหกเจ็ด ค่ะ", "phone", "ศูนย์แปดหนึ่งสองสามสี่ห้าหกเจ็ด"),
        ("Patient Sarah Connor was admitted.", "name", "Sarah Connor"), ("Lê Văn Tám nhập viện hôm qua.", "name", "Lê Văn Tám"),
        ("电话 13812345678", "phone", "13812345678"), ("SSN 123-45-6789 on file", "id_number", "123-45-6789"),
        ("12 Nguyễn Huệ, quận 1, TP. Hồ Chí Minh", "address", "12 Nguyễn Huệ, quận 1, TP. Hồ Chí Minh"),
    ],
)
def test_items_of_other_texts(text, kind, item):
    assert [(k, text[b:e]) for k, b, e in find(text)] == [(kind, item)]


def test_places_after_what_is_uncovered():
    text = "ca 1: a@b.vn; không chín không ba một hai ba bốn năm sáu, sau đó c [at] d.vn và 0905 123 456."
    assert [text[b:e] for _, b, e in find(text)] == ["a@b.vn", "không chín không ba một hai ba bốn năm sáu", "c [at] d.vn", "0905 123 456"]
