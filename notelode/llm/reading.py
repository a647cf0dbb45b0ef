"""A text as a reader takes it in, with the way back to its characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from notelode.llm.forms import plain_table

def _shown(c: str) -> str:
    """What a character reads as: invisible ones and marks as nothing, look-alikes and shapes as plain letters."""
    table = plain_table()
    if ord(c) in table:
        c = table[ord(c)] or ""
    if not c or "\u0300" <= c <= "\u036f":
        return ""
    if c in "‐‑":
        return "-"
    if c in "…℃" or unicodedata.category(c) == "No":
        return c
    return unicodedata.normalize("NFKC", c)


def _bared(c: str) -> str:
    if c in "đĐ":
        return "d" if c == "đ" else "D"
    if not ("À" <= c <= "ỹ"):
        return c
    return "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")


class _Table(dict):
    """For str.translate: what each character reads as, found out when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = x = c if c in "\n\t" else "".join(map(_bared, _shown(c)))
        if len(x) != 1:
            _ODD.add(c)
        return x


_TABLE = _Table()
#: Characters met so far that don't read as one character.
_ODD: set[str] = set()


def read(text: str) -> tuple[str, Sequence[int]]:
    """The text as read, Latin letters without marks, and the place in text of each of its characters."""
    shown = text.translate(_TABLE)
    if _ODD.isdisjoint(text):
        return shown, range(len(text))
    places: list[int] = []
    for i, c in enumerate(text):
        n = len(_TABLE[ord(c)])
        if n == 1:
            places.append(i)
        elif n:
            places += [i] * n
    return shown, places
