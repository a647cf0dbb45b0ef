"""Sentences of texts in any script, each with its place.

A text is cut into blocks that no sentence crosses: list items, headings, paragraphs; a line that was only wrapped goes
on. Within a block every mark or blank that may end a sentence is a candidate, and dynamic programming over whole spans
between candidates (semi-Markov) finds the best cut: a span is scored by how it opens, by its closing word and mark, by
its length, by whether its quotations are closed, and by whether it is complete.

How sentences open and which abbreviations may end one is learned from all texts, without labels: words that stand at
the beginning of lines, where a sentence opens for sure, are compared with the same words elsewhere (Openings). Without
such counts, as for a single text, case and marks decide alone.

A null or blank text has no sentence. Every character that isn't blank is in exactly one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.reading import read
from notelode.session import cut, spread

# Abbreviations, bare and in lower case. After some a sentence goes on; others may end one.
_LEAD = set(
    "bs ths ts pgs ktv bcn ks cn dd ls tk cki ckii d.h q tp tx "
    "dr prof st mr mrs ms mx nr no nos sect sec vol fig figs art ch eq ref tel ext dept ed eds approx est fr sr jr rev gen col capt cpt lt maj sgt "
    "cmdr adm gov pres sen rep hon messrs mme mlle mt ft rd ave "
    "tr p pp s cf vgl z z.b u u.a bzw bspw evtl ggf inkl gez str hr dipl ing med gebr hl sog bd av bl env éd pl".split()
)
_MAY_END = set("gs v.v vv etc i.e e.g vs min max p.o tgl usw ca resp std wk mo inc ltd co corp mg ml kg a.m p.m u.s".split())
#: Before small letters these are words, also of other spelling with marks.
_FOR_NUMBERS = {"ca", "no"}
# How a sentence goes on after a quotation in Chinese and Japanese.
_GOES_ON = ("随后", "然后", "と", "って", "の", "、", "，", ",")
# Thai words that go on after a number, and units that end in a point.
_THAI_GOES_ON = ("วัน", "องศา", "ครั้ง", "และ", "น.", "มก", "หมู่", "ตำบล", "ตําบล", "ถนน", "เมือง", "ปี", "มล", "คน", "เดือน", "อำเภอ", "จังหวัด", "ชั่วโมง")
_THAI_UNITS = ("มก.", "มล.", "มก", "กก.", "ซม.")
#: Ordinals of German end in a point.
_ORDINAL = re.compile(r"(?:^|[\s(])(?:am|im|vom|zum|beim|bis|ab|seit|der|die|das|den|dem|des|jeden?|jedem)[ \n]+\d{1,2}$", re.I)

_ENDS = ".!?…।॥؟۔"
_CLOSERS = "\"”’»」』)]}'›“"
_MARK = rf"(?P<mark>[{_ENDS}。！？｡]+)(?P<close>(?:[\u00a0 ]?»|[\"”’」』)\]}}'“])*)(?P<gap>[ \t\n]*)"
#: Places where a sentence may end: in texts with Thai letters also blanks and line ends.
_CUT = re.compile(_MARK)
_THAI_CUT = re.compile(rf"{_MARK}|(?P<thai>(?<=[฀-๿0-9A-Za-z/%)])[ \n]+(?=[฀-๿]))|(?P<line>(?<![{_ENDS}。！？ ])\n)")
_BARE = re.compile(r"(?<=[a-z0-9%)])[ \n](?=[a-z]{2})")
#: Words and signs after which nothing opens without a mark.
_HANGS = re.compile(r"(?:\b(?:qua|thi|va|ve|la|nhung|khi|nen|cho|tu|voi|khac|lai|nhan|toi|thanh|vi|mat|trong|o|the|a|of|and|to|der|die|und|de|la|le|et)|[:,;(])$")
_ITEM = re.compile(r"[ \t]*[-+*•‣▪●○◦–—·][ \t]+\S")
_NUMBERED = re.compile(r"[ \t]*(?:\d{1,3}\.|[IVX]{1,5}\.|[一二三四五六七八九十]{1,3}、)[ \t]*\S")
_MARKER = re.compile(r"[ \t]*(?:[-+*•‣▪●○◦–—·][ \t]+|(?:\d{1,3}\.|[IVX]{1,5}\.|[一二三四五六七八九十]{1,3}、)[ \t]*)?")
_BRACKET = re.compile(r"[ \t]*\[[^\]\n]*\][ \t]*$")
_ENDED = re.compile(rf"[{_ENDS}。！？][\"”’»」』)\]'“ ]*$")
_QUOTES = {"“": 1, "„": 1, "«": 1, "「": 1, "『": 1, "”": -1, "»": -1, "」": -1, "』": -1}
#: Lines at least this long, with the next word, may have been wrapped.
WRAP = 56

#: Least times that words open lines, as a part of all lines and at all; least part of their places that are such.
LEAST_PART, LEAST, OPENS = 2e-5, 3, 0.06
#: Words in the middle of sentences in at most this part of their places open one even without a mark before them.
RUNS_ON = 0.12

_TOKEN = re.compile(r"[A-Za-z]+|\d+|[฀-๿]+|[぀-鿿]+")


def _keys(s: str, at: int, limit: int) -> tuple[str, ...]:
    """What the words at a place are counted as: the first two and the first, in lower case, numbers as 0."""
    m = _TOKEN.match(s, at, limit)
    if not m:
        return ()
    a = m[0]
    c = a[0]
    if c > "ÿ":
        return (a[:6], a[:3]) if c < "຀" else (a[:2],)
    a = "0" if c.isdigit() else a.lower()
    end = m.end()
    if end + 1 < limit and s[end] in " \n" and (b := _TOKEN.match(s, end + 1, limit)):
        b = b[0]
        two = f"{a} {'0' if b[0].isdigit() else b[:6].lower()}"
        return (two,) if a == "0" else (two, a)
    return (a,) if a != "0" else ()


#: Kinds of places: a line's beginning in capitals or not, after a mark, after a word; an abbreviation's at a line's end and elsewhere.
_UPPER, _LOWER, _MARKED, _PLAIN, _LAST, _DOTTED, _BEFORE_LOW = range(7)


class _Kinds(dict):
    """What stands between two words: the kind of place behind it, and what a point in it says; found out once for each."""

    def __missing__(self, gap: str) -> tuple[int, int]:
        before, _, below = gap.partition("\n")
        place, point = -1, -1
        if below or "\n" in gap:
            last = "\n" + below.rpartition("\n")[2]
            apart = "\n" in below.strip(" \t") and not below.replace("\n", "").strip() or re.search(r"\n[ \t]*\n", gap) is not None
            item = _ITEM.match(last[1:] + "x") is not None
            sure = apart or item or _ENDED.search(before) is not None or before.rstrip().endswith((":", "："))
            place = _UPPER if sure else _PLAIN
            point = _LAST if before.startswith(".") and (apart or item) else -1
        else:
            bare = gap.rstrip(" \t\"“„«‘'(")
            if bare != gap or not gap:
                place = _MARKED if bare[-1:] and bare[-1] in ".!?…。！？」”" else _PLAIN
            elif gap[-1] in "。！？」”、，：；":
                place = _MARKED if gap[-1] in "。！？」”" else _PLAIN
            if gap.startswith(". "):
                point = _DOTTED
        self[gap] = place, point
        return self[gap]


_KINDS = _Kinds()
_WORDS = re.compile(r"([A-Za-z]+|\d+|[฀-๿]+|[぀-鿿]+)")


def counted(texts: Iterable[str]) -> Counter:
    """Times of each (key, kind of place) in texts; the empty key counts lines."""
    found: list[list[str]] = [[] for _ in range(7)]
    out: Counter = Counter()
    opened = 0

    def flush() -> None:
        for kind, keys in enumerate(found):
            for k, n in Counter(keys).items():
                out[k, kind] += n
            keys.clear()

    for text in texts:
        s, _ = read(text)
        parts = _WORDS.split(s)
        if len(parts) < 2:
            continue
        gaps = [_KINDS[x] if len(x) < 16 else _Kinds.__missing__({}, x) for x in parts[::2]]
        words = parts[1::2]
        gaps[0] = _UPPER, -1
        last = parts[-1]
        n = len(words)
        low = [w.lower() if w[0] > "9" else "0" for w in words]
        tight = [x == " " or x == "\n" for x in parts[2:-1:2]]
        for i, word in enumerate(words):
            kind, c = gaps[i][0], word[0]
            if kind >= 0:
                if kind == _UPPER:
                    opened += 1
                    if c.islower():
                        kind = _LOWER
                put = found[kind]
                if c > "ÿ":
                    put += (word[:6], word[:3]) if c < "຀" else (word[:2],)
                else:
                    a = low[i]
                    if i + 1 < n and tight[i]:
                        put.append(a + " " + low[i + 1][:6])
                    if a != "0":
                        put.append(a)
            point = gaps[i + 1][1]
            if point >= 0 and c > "9":
                if i + 1 == n:
                    continue
                if point == _DOTTED and words[i + 1][0].islower():
                    point = _BEFORE_LOW
                a, k = low[i], i
                while k and parts[2 * k] == "." and len(a) < 8 and words[k - 1].isalpha():
                    k -= 1
                    a = f"{low[k]}.{a}"
                if len(a) <= 8 and (k == 0 or parts[2 * k][-1:] in " \n\t(\"“„«‘'["):
                    found[point].append(a + ".")
        if last.startswith(".") and words[-1].isalpha() and len(words[-1]) <= 8 and parts[-3][-1:] in ("", " ", "\n"):
            found[_LAST].append(words[-1].lower() + ".")
        if len(found[_PLAIN]) > 100_000:
            flush()
    flush()
    if opened:
        out["", _UPPER] = opened
    return out


@dataclass
class Openings:
    """Words that open sentences, and abbreviations, as the counts of a corpus show them."""

    #: Of each kept key: times at a line's beginning in capitals, and not, after a mark, after a word, and so on.
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[tuple[str, int], int]) -> Openings:
        lines = counts.get(("", _UPPER), 0)
        table: dict[str, list[int]] = {}
        for (key, kind), n in counts.items():
            if key:
                table.setdefault(key, [0] * 7)[kind] += n
        least = max(LEAST, LEAST_PART * lines)
        return cls({k: tuple(x) for k, x in table.items() if x[_UPPER] + x[_LOWER] >= least or sum(x[_LAST:]) >= least})

    def opens(self, s: str, at: int, most: float = 1.0) -> bool:
        """Whether sentences open like this; with at most this part of such places after a word."""
        for k in _keys(s, at, min(len(s), at + 48)):
            if x := self.seen.get(k):
                n = x[_UPPER] + x[_LOWER]
                if n + x[_MARKED] + x[_PLAIN]:
                    return n >= OPENS * (n + x[_MARKED] + x[_PLAIN]) and x[_PLAIN] <= most * (n + x[_MARKED] + x[_PLAIN])
        return False

    def is_capital(self, s: str, at: int) -> bool:
        """Whether what stands here opens lines, and nearly always with a capital."""
        for k in _keys(s, at, min(len(s), at + 48)):
            if x := self.seen.get(k):
                return x[_UPPER] >= 3 * x[_LOWER] and x[_UPPER] > 2 and self.opens(s, at)
        return False

    def ends(self, word: str) -> float | None:
        """Part of an abbreviation's places that are at a line's end; None if it wasn't met often enough."""
        x = self.seen.get(word + ".")
        return x[_LAST] / sum(x[_LAST:]) if x and sum(x[_LAST:]) else None

    def is_short(self, word: str) -> bool:
        """Whether a word with a point goes on in lower case so often that it must be an abbreviation."""
        x = self.seen.get(word + ".")
        return bool(x) and x[_BEFORE_LOW] > 0.5 * sum(x[_LAST:])


def _is_heading(line: str) -> bool:
    s = line.strip()
    if s.endswith((":", "：")) and len(s) < 60 or _BRACKET.match(line):
        return True
    if _NUMBERED.match(line) and len(s) < 50 and not _ENDED.search(s):
        return True
    return s.isupper() and len(s) < 50 and not _ENDED.search(s) and not any(c.isdigit() for c in s)


def blocks(s: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the parts that no sentence crosses; whole ones are one sentence each."""
    at, lines = 0, []
    for line in s.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    start = None  # of the paragraph under way
    item = False
    # A text that was wrapped has lines that break off before a word in lower case.
    broken = sum(1 for (_, a), (_, b) in zip(lines, lines[1:]) if len(a) > 40 and not _ENDED.search(a) and b[:1].islower() and not _ITEM.match(a)) > 1
    for k, (at, line) in enumerate(lines):
        if not line.strip():
            if start is not None:
                yield start, lines[k - 1][0] + len(lines[k - 1][1]), item
                start = None
            continue
        if start is not None:
            before = lines[k - 1][1]
            word = line.split(None, 1)[0]
            # Scripts without blanks aren't wrapped within a run of letters, so a run says nothing about the width.
            room = len(word) if word[0] < "\u2e80" else 2
            wrapped = len(before) + 1 + room > WRAP or broken and (". " in before or len(before) > 30)
            ended = bool(_ENDED.search(before))
            # A wrapped line may happen to begin with a dash or a number.
            runs_on = wrapped and not ended and not item and re.match(r"[ \t]*(?:[-–—][ \t]+[a-z]|\d{1,3}\.)", line)
            marked = (_ITEM.match(line) or _is_heading(line)) and not runs_on
            own = marked or _is_heading(before) and not _NUMBERED.match(before) or item and _is_heading(before)
            # Items and lines of a form aren't wrapped.
            # Where lines are wrapped anyhow, one that goes on in small letters is no label.
            label = "[A-Z]" if broken else r"[^\s:]"
            form = word[:1].isupper() and re.match(rf"[ \t]*{label}[^:.!?]{{1,24}}:[ \t]?\S|[ \t]*[A-Z]\w+(?: [A-Z]\w+){{1,3}} - ", before)
            if own or item or not ended and (form or not wrapped):
                yield start, lines[k - 1][0] + len(before), item
                start = None
        if start is None:
            start, item = at, bool(_ITEM.match(line)) or _is_heading(line)
    if start is not None:
        yield start, len(s), item


def is_careless(s: str, parts: list[tuple[int, int, bool]], known: Openings) -> bool:
    """Whether sentences of the text open in lower case: where they open for sure, or with words that open with capitals."""
    for m in _LOW.finditer(s):
        if known.is_capital(s, m.end()):
            return True
        # Without counts, an ordinary word with a point before one in lower case says the same.
        if not known.seen and m[0][-2] == "." and (left := _LEFT.search(s[max(0, m.end() - 26) : m.end() - 2])[0].lower()).isalpha() and left not in _LEAD | _MAY_END:
            return True
    low = high = 0
    for b, e, _ in parts:
        m = _LETTER.search(s, b, min(e, b + 12))
        if not m:
            continue
        if not m[0].islower():
            high += 1
        elif not known.seen or known.is_capital(s, m.start()):
            low += 1
    return low > 0 and (bool(known.seen) or low >= high)


_LOW, _LETTER = re.compile(rf"[a-z0-9)%]{{2}}[{_ENDS}] (?=[a-z]{{2}})"), re.compile("[A-Za-z]")


def _closing(s: str, m: re.Match, left: str, known: Openings) -> float:
    """How well a word with a mark after it closes a sentence; the mark is in the Latin manner, a blank follows."""
    mark, at = m["mark"], m.start()
    if mark[0] == "…" or mark.startswith(".."):
        return 1.0
    if mark[0] != ".":
        return 2.0
    if s[at - 1 : at] in (" ", ""):
        return -8.0
    if m["close"]:
        return 1.0
    if left in _FOR_NUMBERS and s[m.end()].islower():
        return 1.5
    if len(left) == 1 and left.isalpha() or left in _LEAD or left in _MAY_END or known.is_short(left):
        part = known.ends(left)
        if part is None:
            return -1.0 if left in _MAY_END else -8.0
        return -1.0 if part >= 0.04 else -8.0
    if _ORDINAL.search(s, max(0, at - 12), at):
        return -8.0
    return 1.0 if left[-1:].isdigit() else 1.5


def _opening(s: str, at: int, mark: str, close: str, careless: bool, known: Openings) -> float:
    """How well what stands here opens a sentence, after a mark and a blank."""
    first = s[at]
    if first in ",;:)":
        return -8.0
    opens = known.opens(s, at + (first in "\"“„«‘'[(" and at + 1 < len(s)))
    upper = first.isupper() or first in "\"“„«‘'[(•"
    soft = mark[0] == "…" or mark.startswith("..")
    if upper:
        return 1.0 if first == "(" and soft and not opens else 3.0 if opens else 2.0
    if first.isdigit() or first in "+-":
        return 2.0 if opens or mark[0] in "!?" else 0.0 if careless else -0.5
    if first.islower():
        if opens:
            return 1.5 if not close.strip(" )]") or careless else -5.0
        return -0.5 if careless and not soft and not close else -6.0
    return 1.0


def _boundary(s: str, m: re.Match, careless: bool, begin: int, known: Openings) -> float:
    """How well a candidate closes one sentence and opens the next."""
    after = m.end()
    nxt = s[after : after + 24]
    groups = m.groupdict()
    if groups.get("thai") is not None:
        prev = s[max(begin, m.start() - 3) : m.start()]
        if prev.endswith(_THAI_UNITS) or nxt.startswith(_THAI_GOES_ON) and not nxt.startswith("วันที่"):
            return -5.0
        last = prev[-1:]
        opens = known.opens(s, after)
        if "฀" <= last <= "๿":
            return 3.0 if opens else 2.0
        return 3.0 if opens else 0.5 if last.isdigit() or last in "/-)" or last.isalpha() else -1.0
    if groups.get("line") is not None:  # a wrapped line without a mark
        return 1.0 if "฀" <= nxt[:1] <= "๿" and known.opens(s, after) else -6.0
    mark, close, gap = m["mark"], m["close"], m["gap"]
    if not nxt:
        return 0.0
    first = nxt[0]
    if mark[0] in "。！？｡":
        if not close:
            return 5.0
        return -6.0 if nxt.startswith(_GOES_ON) else 0.5 if not gap and not known.opens(s, after) else 3.0
    here = s[m.start() - 1 : m.start()]
    cjk = "぀" <= first <= "鿿" or "぀" <= here <= "鿿" and mark[0] in "!?" and not gap
    if cjk or (first in "「『“" and mark[0] in "!?" and not gap):
        if nxt.startswith(_GOES_ON):
            return -6.0
        return (0.0 if close else 4.5) if mark[0] in "!?" else -3.0
    if mark[0] in "।॥؟۔":
        return 4.0
    if "฀" <= first <= "๿":
        if mark[0] in "!?":
            return 4.0
        return 2.5 if s[max(0, m.start() - 2) : m.start()] in (" น", "น") or known.opens(s, after) and not s[: m.start()].endswith("มก") else -2.0
    left = _LEFT.search(s[max(begin, m.start() - 24) : m.start()])[0].lower()
    if not gap:
        return _joined(s, m, left, first, careless, known)
    if mark[0] in "!?" and not first.isalpha() and first not in "\"“„«‘'[(•0123456789":
        return -4.0
    return _closing(s, m, left, known) + _opening(s, after, mark, close, careless, known)


_LEFT = re.compile(r"[^\s(\"“„«'‘\[]*$")


def _joined(s: str, m: re.Match, left: str, first: str, careless: bool, known: Openings) -> float:
    """A mark in the Latin manner with no blank after it."""
    mark, close, after = m["mark"], m["close"], m.end()
    if close or not first.isalpha() or mark != "." and mark[0] == ".":
        return 3.0 if mark[0] in "!?" and first.isupper() and not close else -6.0
    opens = known.opens(s, after)
    if mark[0] in "!?…":
        return 3.0 if first.isupper() or opens else -4.0
    part = known.ends(left)
    if left in _MAY_END and (part is None or part >= 0.04):
        return 2.0 if first.isupper() or opens else -6.0
    if left in _LEAD or left in _MAY_END or "@" in left or "[at]" in left or left.endswith(".v") or left == "v" or "@" in re.match(r"\S*", s[after : after + 40])[0]:
        return -6.0
    if not re.search(r".[a-z]$|\d$|[)%]$", left) or re.search(r"\.[a-z]$", left):
        return -6.0
    # Two words stand for a sentence; one may be the end of an address or a number.
    if opens and (first.isupper() or careless and re.match(r"[a-z]+ ", s[after : after + 24])):
        return 3.0
    return 1.5 if first.isupper() and re.match(r"[A-Z][A-Za-z]*[ ,.]", s[after : after + 24]) and re.search(r".[a-z]$|[)%]$", left) else -6.0


#: Thai ends that need more: a date that something was found on, a given name without a family name.
_UNFINISHED = re.compile(r"(?:^|[ ])(?:(?:(?:ตาม|จาก|ใน|เมื่อ|หลัง|ก่อน|ตั้งแต่)[฀-๿]*)?วันที่ |[฀-๿]*ชื่อ)\S+$")


_QUOTED, _THAI = re.compile('[“„«「『”»」』"]'), re.compile("[฀-๿]")


def _span(s: str, b: int, e: int, quoted: bool, thai: bool) -> float:
    """Score of a span for itself: length, quotations, completeness."""
    part = s[b:e].strip()
    n = len(part)
    score = -0.5 if n < 4 else -max(0.0, (n - 220) / 40)
    if not quoted and not thai:
        return score
    level = 0
    for c, x in ((c, _QUOTES[c]) for c in part if c in _QUOTES):
        # A mark like “ closes where „ has opened.
        level += -1 if c == "“" and level > 0 and "„" in part else x
    if level or part.count('"') % 2:
        score -= 5.0
    if thai and _UNFINISHED.search(part):
        score -= 6.0
    return score


def _quotations(s: str, b: int, e: int) -> list[tuple[int, int]]:
    """Places of the opening and closing marks of the outermost quotations in a block; marks without a fellow don't count."""
    out: list[tuple[int, int]] = []
    opened: list[tuple[int, str]] = []
    for m in _QUOTED.finditer(s, b, e):
        c, i = m[0], m.start()
        if c == '"':
            closes = any(x == '"' for _, x in opened)
        else:
            closes = _QUOTES[c] < 0 or c == "“" and any(x == "„" for _, x in opened)
        if not closes:
            opened.append((i, c))
            continue
        # A mark of the other kind that is still open was left open by mistake.
        while opened and (opened[-1][1] == '"') != (c == '"') and any((x == '"') == (c == '"') for _, x in opened):
            opened.pop()
        if opened and (opened[-1][1] == '"') == (c == '"'):
            at, _ = opened.pop()
            while out and out[-1][0] > at:
                out.pop()
            out.append((at, i))
    return out


def split(text: str, known: Openings = Openings()) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points, half-open."""
    return [(b, e) for b, e, _ in split_shown(text, known)]


def split_shown(text: str, known: Openings = Openings()) -> list[tuple[int, int, str]]:
    """(start, end, sentence as read) of the sentences of a text."""
    s, places = read(text)
    out: list[tuple[int, int]] = []
    parts = list(blocks(s))
    careless = is_careless(s, parts, known)
    for begin, end, whole in parts:
        cuts: list[tuple[int, float]] = []
        quoted, thai = _QUOTED.search(s, begin, end) is not None, _THAI.search(s, begin, end) is not None
        if not whole:
            for m in (_THAI_CUT if thai else _CUT).finditer(s, begin, end):
                at = m.end() if m["mark"] is None else m.end() - len(m["gap"])
                if at >= end or not s[at:end].strip():
                    continue
                cuts.append((at, _boundary(s, m, careless, begin, known)))
            if careless:
                at = {x for x, _ in cuts}
                for m in _BARE.finditer(s, begin, end):
                    if m.end() not in at and known.opens(s, m.end(), RUNS_ON) and not _HANGS.search(s[max(begin, m.start() - 12) : m.start()].lower()):
                        cuts.append((m.end(), 1.0))
                cuts.sort()
        # best[j]: best score of a cut of everything before candidate j; a cut's own score counts once.
        if quoted and cuts:
            # A cut inside a quotation costs by itself, however many sentences are in it.
            inside = _quotations(s, begin, end)
            cuts = [(at, x - 5.0 * any(i < at <= j for i, j in inside)) for at, x in cuts]
        elif not thai:
            # No span has a score of its own unless it is very short or long, so every cut that isn't bad is in the best.
            at = [begin, *(at for at, x in cuts if x >= 0), end]
            if all(4 < y - x < 220 for x, y in zip(at, at[1:])):
                out += _stripped(s, zip(at, at[1:]))
                continue
        ends = [(begin, 0.0), *cuts, (end, 0.0)]
        # most[j]: the largest of best up to j.
        best, came, most = [0.0], [0], [0.0]
        for j in range(1, len(ends)):
            top, arg = -1e18, 0
            for i in range(j - 1, -1, -1):
                # No span is above its length penalty, which grows with it; that may rule out this one and all before it.
                if most[i] - max(0.0, (len(s[ends[i][0] : ends[j][0]].strip()) - 220) / 40) <= top:
                    break
                x = best[i] + _span(s, ends[i][0], ends[j][0], quoted, thai)
                if x > top:
                    top, arg = x, i
            best.append(top + ends[j][1])
            most.append(max(most[-1], best[-1]))
            came.append(arg)
        j, found = len(ends) - 1, []
        while j > 0:
            found.append((ends[came[j]][0], ends[j][0]))
            j = came[j]
        out += _stripped(s, reversed(found))
    return [(b, e, s[x:y]) for (b, e), (x, y) in zip(_located(text, places, out), out, strict=True)]


def _stripped(s: str, spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans without their outer blanks."""
    for b, e in spans:
        while b < e and s[b].isspace():
            b += 1
        while e > b and s[e - 1].isspace():
            e -= 1
        if b < e:
            yield b, e


def _located(text: str, places: Sequence[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the text as read, brought back; characters that read as nothing go with what stands before them."""
    out = []
    for k, (b, e) in enumerate(spans):
        start = places[b] if k else 0
        stop = places[spans[k + 1][0]] if k + 1 < len(spans) else len(text)
        stop = max(stop, places[e - 1] + 1)
        while start < stop and text[start].isspace():
            start += 1
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        out.append((start, stop))
    return out


#: Keys counted in a task before they are passed on.
HELD = 500_000


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(held: Counter) -> pd.DataFrame:
        return pd.DataFrame([(k, kind, n) for (k, kind), n in held.items()], columns=["word", "kind", "n"])

    held: Counter = Counter()
    for b in batches:
        held.update(counted(t for t in b["t"] if isinstance(t, str)))
        if len(held) > HELD:
            yield frame(held)
            held.clear()
    if held:
        yield frame(held)


def fit(df: DataFrame, text: str) -> Openings:
    """Openings of all texts of a table. What is kept is in a fixed part of all lines, so it doesn't grow with the table."""
    made = spread(df.select(F.col(text).alias("t"))).mapInPandas(_counts, "word string, kind int, n bigint")
    made = cut(made.groupBy("word", "kind").agg(F.sum("n").alias("n")))
    lines = made.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, LEAST_PART * lines)
    often = made.filter("word <> ''").groupBy("word").agg(
        F.sum(F.when(F.col("kind") <= _LOWER, F.col("n"))).alias("opening"), F.sum(F.when(F.col("kind") >= _LAST, F.col("n"))).alias("dotted")
    )
    often = often.filter((F.col("opening") >= least) | (F.col("dotted") >= least)).select("word")
    table = made.join(often, "word", "left_semi").toArrow()
    counts = dict(zip(zip(table["word"].to_pylist(), table["kind"].to_pylist(), strict=True), table["n"].to_pylist(), strict=True))
    return Openings.of(counts | {("", _UPPER): lines})


def sentences(df: DataFrame, key: str, text: str, known: Openings | None = None) -> DataFrame:
    """key, start_pos, end_pos: one row per sentence; openings are learned from the table itself where none are given."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, text) if known is None else known)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                made = [(k, x, y) for k, t in zip(part["k"], part["t"], strict=True) if isinstance(t, str) for x, y in split(t, known)]
                if made:
                    yield pd.DataFrame(made, columns=["k", "start_pos", "end_pos"])

    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = dict(df.dtypes)[key]
    return src.mapInPandas(rows, f"k {kind}, start_pos bigint, end_pos bigint").withColumnRenamed("k", key)
