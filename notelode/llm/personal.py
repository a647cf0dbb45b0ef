"""Personal information in free text: names, phones, e-mail addresses, identity numbers, postal addresses.

Detection reads a text through two transducers that keep, for every character they put out, the place it came from.
The first shows look-alikes, wide forms and hidden characters as plain letters; the second turns spelled digits into
digits and disguised at-signs and dots into signs. Patterns then find items in what is read, cues before them tell
personal numbers from those of things, and each item is mapped back to its source characters, so that everything
around it stays as it was.

A null text has no item and stays null.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.reading import read
from notelode.session import spread

KINDS = ("name", "phone", "email", "id_number", "address")

# Digit words of each language from zero to nine, bare, with other words for some.
_DIGITS = {
    w: str(i % 10)
    for words in (
        "khong mot hai ba bon nam sau bay tam chin", "zero one two three four five six seven eight nine",
        "null eins zwei drei vier funf sechs sieben acht neun", "zero un deux trois quatre cinq six sept huit neuf",
        "ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า", "〇 一 二 三 四 五 六 七 八 九",
    )
    for i, w in enumerate(words.split())
} | {"le": "0", "linh": "0", "tu": "4", "lam": "5", "oh": "0", "nought": "0", "zwo": "2", "une": "1", "零": "0", "幺": "1", "両": "2"}
_longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
_LATIN_DIGIT = _longest(w for w in _DIGITS if w.isascii())
_THAI_DIGIT = _longest(w for w in _DIGITS if "฀" <= w[0] <= "๿")
_HAN_DIGIT = "".join(w for w in _DIGITS if "⺀" <= w[0])
_ONE = re.compile(rf"{_LATIN_DIGIT}|{_THAI_DIGIT}|[{_HAN_DIGIT}]", re.I)
#: Everything that is written otherwise than it reads: numbers in words, whole addresses in words, disguised signs.
_COVERED = re.compile(
    rf"(?P<number>(?<![A-Za-z])(?:{_LATIN_DIGIT})(?:[ \n,.-]{{1,2}}(?:{_LATIN_DIGIT})){{6,}}(?![A-Za-z])"
    rf"|(?:{_THAI_DIGIT})(?:[ -]?(?:{_THAI_DIGIT})){{6,}}|[{_HAN_DIGIT}](?:[ の-]?[{_HAN_DIGIT}]){{6,}})"
    r"|(?P<words>(?<![A-Za-z0-9])[A-Za-z0-9][\w.+-]*(?: (?:dot|cham|point|punkt) [\w+-]+)* (?:at|a cong|arobase) [A-Za-z0-9-]+(?: (?:dot|cham|point|punkt) [A-Za-z0-9-]+)+)"
    r"|(?P<at>(?<=[A-Za-z0-9])[ \n]?(?:\[at\]|\(at\)|\{at\}|\(a\)|\[a\]|\[@\]|\(@\)|@)[ \n]?(?=[A-Za-z0-9]))"
    r"|(?P<dot>[ \n]?(?:\[dot\]|\(dot\)|\{dot\}|\[\.\]|\(\.\)|\(cham\)|\[cham\])[ \n]?)",
    re.I,
)
_SIGN = re.compile(r" (?:(at|a cong|arobase)|dot|cham|point|punkt) ", re.I)
_RUN = re.compile(rf"[{_HAN_DIGIT}](?:[ の-]?[{_HAN_DIGIT}]){{6}}|(?:{_THAI_DIGIT})(?:[ -]?(?:{_THAI_DIGIT})){{6}}")
_LETTERS = re.compile("[a-z]+")
_LATIN_DIGITS = frozenset(w for w in _DIGITS if w.isascii())
_SIGN_WORDS = ("@", "[at]", "(at)", "{at}", "(a)", "[a]", "dot", "cham", "point", "punkt", "[.]")


def _is_plain(s: str) -> bool:
    """Whether a text surely has nothing to uncover: no sign, no seven digit words in a row."""
    low = s.lower()
    if any(w in low for w in _SIGN_WORDS):
        return False
    words = _LETTERS.findall(low)
    if "1111111" in "".join(["1" if w in _LATIN_DIGITS else "0" for w in words]):
        return False
    return low.isascii() or not _RUN.search(low)


#: A run of a text as uncovered, and where it comes from: start in it, start and end in the text as read, whether it stands for all of that.
Run = tuple[int, int, int, bool]


def uncover(s: str) -> tuple[str, list[Run]]:
    """The second transducer: the text with plain digits and signs, and the runs it is made of."""
    if _is_plain(s):
        return s, [(0, 0, len(s), False)]
    out: list[str] = []
    runs: list[Run] = []
    made = at = 0

    def put(new: str, b: int, e: int, stands: bool) -> None:
        nonlocal made
        if new:
            out.append(new)
            runs.append((made, b, e, stands))
            made += len(new)

    for m in _COVERED.finditer(s):
        b, e = m.span()
        put(s[at:b], at, b, False)
        at = e
        if m["number"]:
            words = list(_ONE.finditer(s, b, e))
            # Without marks some digits are other words too ("not", "after", "year"), which may open what follows a number of ten.
            if len(words) == 11 and words[-1][0].lower() in ("khong", "sau", "nam"):
                words.pop()
            at = words[-1].end()
            put("".join(_DIGITS[w[0].lower()] for w in words), b, at, True)
        elif m["words"]:
            for x in _SIGN.finditer(s, b, e):
                put(s[b : x.start()], b, x.start(), False)
                put("@" if x[1] else ".", x.start(), x.end(), True)
                b = x.end()
            put(s[b:e], b, e, False)
        else:
            put("@" if m["at"] else ".", b, e, True)
    put(s[at:], at, len(s), False)
    return "".join(out), runs


def _source(runs: list[Run], places: Sequence[int], b: int, e: int) -> tuple[int, int]:
    """The source span of a span of what was uncovered."""
    start, first, end, stands = runs[bisect_right(runs, b, key=lambda r: r[0]) - 1]
    begin = places[first if stands else first + b - start]
    start, first, end, stands = runs[bisect_right(runs, e - 1, key=lambda r: r[0]) - 1]
    return begin, places[end - 1 if stands else first + e - 1 - start] + 1


_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:(?:\.[A-Za-z0-9-]+)+|(?:[ \n]\.[ \n][A-Za-z0-9-]+)+)")

#: Characters before a number that are looked at: longer than any cue with its blanks.
BEFORE = 64
#: Words before a number of a thing.
_THING = re.compile(
    r"(?<![A-Za-z])(?:mau so|may bom so|bom so|so phieu|phieu|ma to|ma|to|ngan|ban ghi|lo thuoc|lo|phien ban|phong|muc|tr\.|sample no\.?|sample|form|"
    r"sheet|filed under|ref\.?|pump|code|room|lot|device|serial|schein nr\.?|bogen|unter lfd|bon no\.?|fiche|sous|echantillon no\.?|probe nr\.?|gerat nr\.?|"
    r"lot no\.?|单号|表单|存于|样本号?|设备号?|批号|伝票|用紙|棚|検体番号|เลขที่ใบ|ใบเลขที่|เอกสารเลขที่|แฟ้ม|SP)[ \n:.#]*(?:SP[ \n]?)?$",
    re.I,
)
_GUARD = r"(?<![A-Za-z0-9_./@+-])"
_END = r"(?![A-Za-z0-9_@]|[-./]\d)"
_PHONES = [
    r"\+8[16][ -]?(?:\(\d{2,4}\)|\d{2,4})[ -]?\d{4}[ -]?\d{4}",
    # Mobile and fixed numbers of the place the notes come from.
    r"(?:\(\+84\)|\+84)[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{3}",
    r"0\d{3}(?:[ .-]?\d{3}[ .-]?\d{3})",
    r"(?:\(0\d{2,3}\)[ -]?|0\d{3}[ -])\d{3,4}[ .-]?\d{3}",
    # Abroad.
    r"(?:\+1[ .-])?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?:[ ]?(?:ext\.?|x)[ ]?\d{1,5})?",
    # Mobile numbers of China by structure.
    r"1[3-9]\d{9}",
    r"\d{3}-\d{4}(?:[ ]?(?:ext\.?|x)[ ]?\d{1,5})?",
    r"\+49[ ]?\(0\)[ ]?\d{2,4}[ /-]?\d{3,5}[ -]?\d{2,4}|0\d{2,4}[ /]\d{4,5}[ -]?\d{3,4}",
    r"(?:\+33[ .]?\d|0\d)(?:[ .]\d{2}){4}",
    r"(?:\+86[ -]?)?(?:\(\d{3,4}\)|\d{3,4}[ -])[ ]?\d{4}[ -]?\d{4}",
    r"(?:\+81[ -]?)?(?:\(\d{2,4}\)|\d{2,4}-)\d{4}-\d{4}",
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}",
]
_PHONE = re.compile(_GUARD.replace("./", "") + f"(?:{'|'.join(_PHONES)})" + _END)
#: Identity numbers; those of the group "own" are known by their structure.
_ID = re.compile(
    _GUARD
    + r"(?:(?P<own>[A-Z]{2}[ ]?\d[ ]?\d{2}[ ]?\d{5}[ ]?\d{5}"  # health insurance
    + r"|\d-\d{4}-\d{5}-\d{2}-\d|\d{17}[\dXx]|\d{3}-\d{2}-\d{4})"
    + r"|0\d{2}[ .]?\d{3}[ .]?\d{3}[ .]?\d{3}|\d{9}|\d{3}\.\d{3}\.\d{3}|\d{3} \d{3} \d{3}"
    + r"|(?:[A-Z]{2}[ ]?|[A-Z])\d{7})"  # passport
    + _END
)
#: Words before an identity number. A plain run of digits needs one, or a place between dashes beside a name.
_CARD = re.compile(
    r"(?:cccd|cmnd|can cuoc|dinh danh|ho chieu so|ho chieu|the bhyt|bhyt|giay to kem theo|giay to|passport|ausweis|piece|id no\.?|identity card|insurance no\.?|"
    r"证件号码?|身份证号?|护照号?|旅券番号|保険証番号|บัตรเลขที่|บัตรประชาชน|หนังสือเดินทาง)[ \n:.]*(?:so)?[ \n:]*$",
    re.I,
)

# Family names, bare.
_FAMILY = (
    "Nguyen Tran Le Pham Hoang Huynh Phan Vu Vo Dang Bui Do Ho Ngo Duong Ly Dinh Doan Lam Mai Truong Cao Ha Luong Trinh Dao Ta To "
    "Chau Giap Than Mac Pho Luu Tang Nguy Dam Quach Vuong Luc Kieu Cu Banh Nghiem Khuc Tieu Ninh Luu Thach Thai Quan Phung La Tu Bach"
).split()
#: Family names that are also common words or parts of place names; they need a cue.
_WEAK = set("Le Ho Ha Lam Cao Mai Do To La Tu Ta Bach Dao Thach Thai Quan Ly Vu Vo Dang Bui Duong".split())
_STRONG = [n for n in _FAMILY if n not in _WEAK]
_CAP = r"(?:[A-Z][a-z]+)"
_VI_MIXED = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(_STRONG)})(?:[ ]{_CAP}){{1,3}}(?![A-Za-z])")
# Middle names, bare, which tell a name from other words after a weak family name.
_MIDDLE = "Van|Thi|Huu|Duc|Ngoc|Quoc|Xuan|Dinh|Ba|Quang|Cong|Trong|Tien|Viet|Gia|Thuy|Kim|Khac|Manh|Hong|Minh|Thanh"
_VI_MIDDLE = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(sorted(_WEAK))}) (?:{_MIDDLE})(?: {_CAP}){{1,2}}(?![A-Za-z])(?! (?:Street|Road|Hospital))")
_VI_UPPER = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(n.upper() for n in _STRONG)})(?:[ ][A-Z]{{2,}}){{1,3}}(?![A-Za-z])")
_VI_CUED = re.compile(
    rf"(?:[Bb]enh nhan|[Nn]guoi benh|[Nn]guoi giam ho:|[Hh]o va ten:|[Cc]on (?:gai|trai) ten|\b(?:[Bb]a|[Oo]ng|[Aa]nh|[Cc]hi|BS\.|KTV\.|DD\.|ThS\.))[ \n]+"
    rf"((?:{'|'.join(_FAMILY)})(?:[ ]{_CAP}){{1,3}}|(?:{'|'.join(n.upper() for n in _FAMILY)})(?:[ ][A-Z]{{2,}}){{1,3}})(?![A-Za-z])"
)
_W = r"(?:[A-Z][a-z]+|[A-Z]{3,})"
_LATIN = rf"(?:{_W}|[A-Z]\.)(?:[ ][A-Z]\.)?[ ](?:(?:von|van|de|du|der|zu)[ ])?{_W}(?:-{_W})?"
_LATIN_CUED = re.compile(
    rf"(?:[Kk]in is|[Ff]amily contact|[Ss]een by Dr\.|by Prof\.|[Pp]atient(?:in|e)?(?: named)?|[Nn]urse|[Nn]ame:|Miss|M\.|Monsieur|Madame|Hr\.|Fr\.|Schwester|Pfleger|Mr\.?|Mrs\.?|Ms\.?|Frau|Herr|gez\.|Mme|Mlle|[Ll]e Dr\.|[Ll]a Dr\.|Dr\.)[ \n]+({_LATIN})(?![A-Za-z])"
)
_LATIN_ASKED = re.compile(rf"({_LATIN})[ \n](?:asked twice|called from|signed for|is reachable|est joignable|ist unter)")
_HAN = r"[一-鿿々]"
_CJK_CUED = [
    re.compile(rf"(?:家属|家屬|患者|病人|护士|医生)({_HAN}{{2,4}}?)(?=要求|[,，;；。]|签|来电|陪|的电话)"),
    re.compile(rf"患者({_HAN}{{1,4}}[  ]?{_HAN}{{1,4}})(?=様|さん|氏)"),
]
_THAI_CUED = re.compile(r"(?:ผู้ป่วยชื่อ|ญาติชื่อ|คุณ|นางสาว|นาย)([฀-๿]{2,}[ ][฀-๿]{2,})")

_P = r"(?:[A-Z][A-Za-z]*(?:[ ][A-Z][A-Za-z]*){0,3})"  # a place name
_ADDRESSES = [
    re.compile(x)
    for x in (
        rf"(?<![\w])[Ss]o \d+[A-Z]?(?:/\d+)*, (?:ngo|hem|ngach|kiet) \d+(?:/\d+)*, (?:duong|pho) {_P}, (?:phuong|xa|thi tran|P\.) ?{_P}(?:, (?:quan|huyen|thi xa|Q\.) ?{_P})?, (?:thanh pho|TP\.|tinh) ?{_P}",
        rf"(?<![\w./])\d+(?:/\d+)+ (?:duong|pho) {_P}, (?:phuong|P\.) ?{_P}, (?:thanh pho|TP\.) ?{_P}",
        rf"(?<![\w./])\d+[A-Z]? (?:duong |pho )?{_P}, (?:Q\.|quan|P\.|phuong|TP\.|huyen) ?(?:{_P}|\d{{1,2}})(?:, (?:TP\.|thanh pho) ?{_P})?",
        rf"(?<![\w])[Cc]an (?:ho )?\w*\d[\d.]* chung cu {_P}, duong {_P}, {_P}",
        rf"(?<![\w])[Tt]o \d+,? khu pho {_P}, (?:thi tran|phuong|xa) {_P}(?:, (?:huyen|thi xa|thanh pho|quan) {_P})?",
        rf"(?<![\w])(?:[Tt]hon|[Aa]p|[Xx]om|[Bb]an|[Kk]hu|[Dd]oi) \d+, xa {_P}, (?:huyen|thi xa) {_P}(?:, tinh {_P})?",
        r"(?<![\w./])\d+ (?:[A-Z][A-Za-z]*\.? )?(?:[A-Z][A-Za-z]*(?:['’]s)? )+?(?:Close|Row|Lane|Street|Road|Avenue|Court|Hill|Way), [A-Z][a-z]+(?: [A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})?",
        r"(?<![\w])Flat \d+, (?:[A-Z][a-z]+ )+(?:Court|House|Tower|Mansions), [A-Z][a-z]+(?: [A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})?",
        r"(?<![\w])[A-Z][a-z]+(?:stieg|weg|gasse|platz|allee|strasse|straße|str\.) \d+(?: ?[a-z])?, (?:\d{5} )?[A-Z][a-z]+",
        r"(?<![\w./])\d+(?: bis| ter)?, (?:rue|av\.|avenue|bd|boulevard|chemin|place)(?: (?:des|du|de la|de|de l'))? ?[A-Z][a-z]+(?:-[A-Z][a-z]+)*, (?:\d{5} )?[A-Z][a-z]+",
        r"(?:(?<=现住)|(?<=住址)|(?<=地址)|(?<=住在)|(?<=[:：]))[一-鿿]{2,4}[市县区][一-鿿]{2,12}?\d+号(?:\d+[栋幢号楼])?(?:\d+单元)?(?:\d+室)?",
        r"(?:(?<=住所は)|(?<=住所:)|(?<=住所：))[一-鿿]{1,5}[市町村区][一-鿿ぁ-んァ-ヶー]{1,10}?\d+(?:-\d+){0,3}(?:番地?(?:の?\d+)?(?:号)?)?",
        r"\d+(?:/\d+)? หมู่ \d+ ต(?:ำ|ํา)บล[฀-๿]+|\d+(?:/\d+)? ถนน[฀-๿]+ เมือง[฀-๿]+",
    )
]
#: Of each address pattern, words of which one is in whatever it matches.
_PLACES = [
    w.split("|")
    for w in (
        "ngo|hem|ngach|kiet", "duong|pho", "Q.|quan|P.|phuong|TP.|huyen", "chung cu", "khu pho", ", xa ", "Close|Row|Lane|Street|Road|Avenue|Court|Hill|Way",
        "Flat", "stieg|weg|gasse|platz|allee|stra|str.", "rue|av.|avenue|bd|boulevard|chemin|place", "号", "住所", "หมู่|ถนน",
    )
]
_TABLE = re.compile(r"[A-Za-z] - $")


def _number(t: str, m: re.Match) -> bool:
    """Whether the number is not one of a thing."""
    return not _THING.search(t[max(0, m.start() - BEFORE) : m.start()])


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items in a text, in its own code points, by place; items don't overlap."""
    s, places = read(text)
    t, runs = uncover(s)
    found: list[tuple[int, int, str]] = []
    free = bytearray(len(t))

    def take(kind: str, b: int, e: int) -> None:
        if b < e and not any(free[b:e]):
            free[b:e] = b"\1" * (e - b)
            found.append((b, e, kind))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            take("email", m.start(), m.end())
    for words, p in zip(_PLACES, _ADDRESSES, strict=True):
        if any(w in t for w in words):
            for m in p.finditer(t):
                take("address", m.start(), m.end())
    if _TWO_DIGITS.search(t):
        for m in _ID.finditer(t):
            before = t[max(0, m.start() - BEFORE) : m.start()]
            dashed = _TABLE.search(before) and t[m.end() : m.end() + 3] == " - "
            if _CARD.search(before) or dashed or m["own"] and not _THING.search(before):
                take("id_number", m.start(), m.end())
        for m in _PHONE.finditer(t):
            if _number(t, m):
                take("phone", m.start(), m.end())
        # Things have no number in words, so one that no pattern knows is to be called or shown.
        for b, first, end, stands in runs:
            n = next((i for i, c in enumerate(t[b : b + 32]) if not c.isdigit()), len(t) - b) if stands else 0
            if 7 <= n <= 15 and end - first > n - 1 and not _THING.search(before := t[max(0, b - BEFORE) : b]):
                take("id_number" if _CARD.search(before) else "phone", b, b + n)
    for words, p in _NAMES:
        if words is None or any(w in t for w in words):
            for m in p.finditer(t):
                take("name", m.start(p.groups), m.end(p.groups))
    return [(kind, *_source(runs, places, b, e)) for b, e, kind in sorted(found)]


_TWO_DIGITS = re.compile(r"\d{2}")
#: Name patterns, by rank, and words of which one is in whatever they match. A pattern's group, if it has one, is the name.
_NAMES = [
    (None, _VI_CUED), (None, _LATIN_CUED), (("asked", "called", "signed", "is reachable", "est joignable", "ist unter"), _LATIN_ASKED),
    *((("家", "患者", "病人", "护士", "医生"), p) for p in _CJK_CUED), (("ชื่อ", "คุณ", "นาง", "นาย"), _THAI_CUED), (None, _VI_MIXED), (None, _VI_UPPER), (None, _VI_MIDDLE),
]


def redact(text: str | None) -> str | None:
    """The text with each item replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, b, e in find(text):
        out += [text[at:b], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [(k, *x) for k, t in zip(b["k"], b["t"], strict=True) if isinstance(t, str) and t for x in find(t)]
        if made:
            yield pd.DataFrame(made, columns=["k", "kind", "start_pos", "end_pos"])


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"k": b["k"], "text": [redact(t) if isinstance(t, str) else None for t in b["t"]]})


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))


def personal_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start_pos, end_pos: one row per item."""
    kind = dict(df.dtypes)[key]
    made = _texts(df, key, text).mapInPandas(_found, f"k {kind}, kind string, start_pos bigint, end_pos bigint")
    return made.withColumnRenamed("k", key)


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: each text with typed placeholders, otherwise as it was."""
    made = _texts(df, key, text).mapInPandas(_redacted, f"k {dict(df.dtypes)[key]}, text string")
    return made.withColumnRenamed("k", key)
