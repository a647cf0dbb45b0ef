"""Characters that hide differences: invisible ones, kinds of blanks, look-alike letters."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

# Letters of other scripts and the Latin letters they look like.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮаеіјорсухѕһԁԛԝ", "ABESIJKMHOPCTYXYaeijopcyxshdqw"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"
_OTHER = "ɡÐƉ", "gĐĐ"
LOOK_ALIKES = dict(zip("".join(x[0] for x in (_CYRILLIC, _GREEK, _OTHER)), "".join(x[1] for x in (_CYRILLIC, _GREEK, _OTHER)), strict=True))

# Joiners and hyphens that show nothing, beside the general category of format characters.
SHOW_NOTHING = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u180b\u180c\u180d\u180f"


@cache
def invisible() -> str:
    """Format characters and variation selectors."""
    found = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf"]
    selectors = [*map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))]
    return "".join(sorted({*found, *selectors, *SHOW_NOTHING}))


@cache
def blanks() -> str:
    """Blanks within a line, the plain one and the tab left out."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Zs" and c != " ")


@cache
def look_alikes() -> dict[str, str]:
    """LOOK_ALIKES, and their forms with marks where Latin has the like."""
    out = dict(LOOK_ALIKES)
    for c in map(chr, range(0x370, 0x530)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in out:
            made = unicodedata.normalize("NFC", out[parts[0]] + parts[1:])
            if len(made) == 1:
                out[c] = made
    return out


@cache
def same_shapes() -> dict[str, str]:
    """Compatibility characters that look as one plain character: wide, narrow and shaped forms, radicals, hyphens."""
    out = {"\u2010": "-", "\u2011": "-"}
    for c in map(chr, range(0x2E80, 0x10000)):
        kind, _, _ = unicodedata.decomposition(c).partition(" ")
        made = unicodedata.normalize("NFKC", c)
        radical = kind == "<compat>" and 0x2E80 <= ord(c) < 0x2FE0
        if len(made) == 1 and (radical or kind in ("<wide>", "<narrow>", "<isolated>", "<final>", "<initial>", "<medial>")):
            out[c] = made
    return out


@cache
def ligatures() -> dict[str, str]:
    """Letters drawn as one sign that read as several."""
    return {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xFB00, 0xFB07))}


@cache
def plain_table() -> dict[int, str | None]:
    """For str.translate: invisible ones away, blanks plain, look-alikes Latin."""
    table: dict[int, str | None] = {ord(c): None for c in invisible()}
    table |= {ord(c): " " for c in blanks()}
    return table | {ord(a): b for a, b in look_alikes().items()}


def plain(text: str) -> str:
    """Compatibility form in lower case, free of invisible characters and look-alikes."""
    return unicodedata.normalize("NFKC", text.translate(plain_table())).lower()


def bare(text: str) -> str:
    """Letters without their marks."""
    parts = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in parts if not unicodedata.combining(c))
