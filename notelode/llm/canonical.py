"""Free spellings mapped to the entries of a reference list.

A dictionary of symmetric deletes finds the entries within a bounded edit distance: an entry and a text that are
within distance k share a string that is left when up to k characters are deleted from the first ones of each. Every
entry is in it in several forms, as people write it: without marks, as keystrokes, with the first word cut to a
letter, as initials, as it sounds. What is found is ranked by a weighted Damerau-Levenshtein distance, then by how
often the entry occurs, then by name. A text that is near no entry is a miss.

Null, blank or unreadable texts are misses. The reference list is sent to every task in parts of at most PART entries;
a longer list is matched part by part and the best match stays, so nothing grows with it but the number of passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.llm.forms import bare, plain
from notelode.session import cores, cut

#: Entries up to which lists are broadcast: a few hundred hashes of 12 bytes each, hence at most about 100 MB.
BROADCAST = 15_000
#: Characters of a form that deletes are taken from, and the most edits.
PREFIX, EDITS = 10, 3

# Keys beside each other, sounds written in two ways, tone letters of the keyboard by combining mark.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_SOUNDS = {("c", "k"), ("i", "y"), ("s", "x"), ("d", "z")}
_TONES = {"́": "s", "̀": "f", "̉": "r", "̃": "x", "̣": "j"}
_VOWELS = {"ă": "aw", "â": "aa", "ê": "ee", "ô": "oo", "ơ": "ow", "ư": "uw", "đ": "dd"}

_NEAR = {p for row in _ROWS for p in zip(row, row[1:])} | {
    p for up, low in zip(_ROWS, _ROWS[1:]) for i, c in enumerate(low) for p in ((up[i], c), (up[i + 1], c)) if i + 1 < len(up)
}
_CHEAP = {**{p: 0.8 for p in _NEAR}, **{p: 0.5 for p in _SOUNDS}}
#: Least weight of an edit.
CHEAPEST = 0.5
_CHEAP |= {(b, a): w for (a, b), w in _CHEAP.items()}


def squeezed(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", bare(text))


def keystrokes(text: str) -> str:
    """A term as typed on a keyboard whose marks weren't turned into letters: the tone follows its syllable."""
    import unicodedata

    out = []
    for word in text.split():
        tone, letters = "", []
        for c in word:
            parts = unicodedata.normalize("NFD", c)
            tone += "".join(_TONES.get(p, "") for p in parts)
            rest = unicodedata.normalize("NFC", "".join(p for p in parts if p not in _TONES))
            letters.append(_VOWELS.get(rest, rest))
        out.append("".join(letters) + tone)
    return squeezed("".join(out))


def sounded(key: str) -> str:
    """Spellings that sound alike become one."""
    for a, b in (("ph", "f"), ("th", "t"), ("x", "ks"), ("c", "k"), ("ie", "i")):
        key = key.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", key).removesuffix("e")


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein (restricted): neighbouring keys, like sounds, doublings and swaps cost less.

    Gives a number above most as soon as that much is certain.
    """
    if a == b:
        return 0.0
    before, last = [], [0.0]
    for j in range(1, len(b) + 1):
        last.append(last[-1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    # A cell off the diagonal by more than the edits allowed, at the least cost of one, can't be on a path worth taking.
    band = int(most / 0.7) + 1
    for i in range(1, len(a) + 1):
        ca = a[i - 1]
        gone = 0.7 if i > 1 and ca == a[i - 2] else 1.0
        row = [last[0] + gone] + [9e9] * len(b)
        for j in range(max(1, i - band), min(len(b), i + band) + 1):
            cb = b[j - 1]
            if ca == cb:
                x = last[j - 1]
            else:
                x = last[j - 1] + _CHEAP.get((ca, cb), 1.0)
                if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                    x = min(x, before[j - 2] + 0.8)
            row[j] = min(x, last[j] + gone, row[j - 1] + (0.7 if j > 1 and cb == b[j - 2] else 1.0))
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def deletes(key: str, edits: int) -> set[str]:
    head = key[:PREFIX]
    return {"".join(head[i] for i in keep) for k in range(edits + 1) for keep in combinations(range(len(head)), max(0, len(head) - k))}


@dataclass(frozen=True)
class Profile:
    """How a kind of text is read: its cleaning, and the forms in which an entry may be written."""

    clean: Callable[[str], str]
    forms: Callable[[str], Iterable[tuple[str, str]]]  # of an entry: (kind, key)
    keys: Callable[[str], Iterable[tuple[str, str]]]  # of a cleaned text: (kind, key)


# Words before a drug's name, and where its dose begins.
_PACKED = re.compile(r"^(?:(?:viên|vien|gói|goi|thuốc|thuoc|ống|ong|lọ|lo|hộp|hop|siro|h/c|hc)[.:]?\s+)+")
_DOSE = re.compile(r"[\s:;,(]*\d.*$", re.S)


def _clean_drug(text: str) -> str:
    return _DOSE.sub("", _PACKED.sub("", plain(text).strip()))


def _drug_keys(text: str) -> list[tuple[str, str]]:
    key = squeezed(text)
    return [("plain", key), ("sound", sounded(key))]


def _clean_words(text: str) -> str:
    return " ".join(re.sub(r"[_\-\s]+", " ", plain(text)).split())


def _words(entry: str) -> list[str]:
    return bare(entry.lower()).split()


def _diagnosis_forms(entry: str) -> list[tuple[str, str]]:
    words = _words(entry)
    cut = "".join([words[0][:1], *words[1:]])
    return [
        ("plain", squeezed(entry)),
        ("keys", keystrokes(entry)),
        ("cut", squeezed(cut)),
        ("initials", squeezed("".join(w[0] for w in words))),
    ]


def _diagnosis_keys(text: str) -> list[tuple[str, str]]:
    key = squeezed(text)
    if re.match(r"^\w\.\s*\w\w", text):  # one letter for the first word
        return [("cut", key)]
    return [("plain", key), ("keys", key), ("initials", key)]


DRUGS = Profile(_clean_drug, lambda entry: _drug_keys(entry.lower()), _drug_keys)
DIAGNOSES = Profile(_clean_words, lambda entry: _diagnosis_forms(entry.lower()), _diagnosis_keys)
PROFILES = {"drug": DRUGS, "diagnosis": DIAGNOSES}


def allowed(key: str) -> int:
    """Edits that a text of this length may have: one for every four characters, one at least, three at most."""
    return 0 if len(key) < 3 else min(EDITS, max(1, len(key) // 4))


def within(a: str, b: str, most: int) -> bool:
    """Whether at most so many insertions, deletions, replacements and swaps of neighbours make a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            x = min(last[j - 1] + (a[i - 1] != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[j - 2] + 1)
            row[j] = x
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _hashes(kind: str, key: str, edits: int) -> np.ndarray:
    """Numbers of the deletes of a key; two that share one by chance are told apart by their distance."""
    return np.array([crc32(f"{kind}|{d}".encode()) for d in (deletes(key, edits) if edits else {key})], dtype=np.int64)


def _searches(profile: Profile, text: str) -> list[tuple[str, str, str, int]]:
    """(kind, key, what its deletes are hashed under, edits) of everything a text is looked up as."""
    found = [(kind, key) for kind, key in profile.keys(profile.clean(text)) if key]
    # Initials are looked up whole. Other keys are hashed by their head, or whole where no edit is allowed.
    return [(kind, key, key[:PREFIX], 0 if kind == "initials" else allowed(key)) for kind, key in found]


def _forms(profile: Profile, term: str) -> list[tuple[str, str, np.ndarray]]:
    """(kind, key, hashes) of the forms of an entry."""
    return [(kind, key, _hashes(kind, key[:PREFIX], 0 if kind == "initials" else EDITS)) for kind, key in profile.forms(term) if key]


def _measure(kind: str, key: str, form: str, edits: int) -> float | None:
    """Weighted distance of a key and a form; None if they are more edits apart."""
    if key == form:
        return 0.0
    return distance(key, form, edits) if edits and within(key, form, edits) else None


class Matcher:
    """Deletes dictionary over one list: sorted hashes, and the form each belongs to, in flat arrays."""

    def __init__(self, forms: list[tuple[str, str, str, int]], hashes: np.ndarray, owner: np.ndarray, profile: Profile):
        order = np.argsort(hashes, kind="stable")
        self.forms, self.hashes, self.owner, self.profile = forms, hashes[order], owner[order], profile

    @classmethod
    def of(cls, entries: Iterable[tuple[str, int]], profile: Profile) -> Matcher:
        forms, hashes = [], []
        for term, n in sorted(entries):
            for kind, key, found in _forms(profile, term):
                forms.append((kind, key, term, n))
                hashes.append(found)
        return cls(forms, *_flat(hashes), profile)

    def _near(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the forms that have any of the hashes."""
        lo, hi = np.searchsorted(self.hashes, wanted, "left"), np.searchsorted(self.hashes, wanted, "right")
        on = hi > lo
        return np.unique(np.concatenate([self.owner[x:y] for x, y in zip(lo[on], hi[on])])) if on.any() else np.zeros(0, dtype=np.int32)

    def match(self, text: str | None) -> tuple[str | None, float]:
        """The entry meant and its distance; (None, -1) for a miss.

        The search goes on from no edit to the most allowed, and stops where an entry of more edits can't be as near.
        """
        if text is None or not len(self.hashes):
            return None, -1.0
        best: tuple[float, int, str] | None = None
        searches = _searches(self.profile, text)
        for edits in range(EDITS + 1):
            open_ = [x for x in searches if x[3] >= edits]
            if not open_ or best is not None and best[0] < edits * CHEAPEST:
                break
            for kind, key, head, most in open_:
                for k in self._near(_hashes(kind, head, edits)).tolist():
                    of, form, term, n = self.forms[k]
                    if of == kind and (x := _measure(kind, key, form, most)) is not None:
                        found = round(x, 3), -n, term
                        best = found if best is None or found < best else best
        return (best[2], best[0]) if best else (None, -1.0)


def _flat(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes in one array, and the number of the form each is of."""
    if not hashes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    return np.concatenate(hashes), np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])


_FORM = "list string, form string, form_key string, term string, n bigint, hashes array<bigint>"


def _dictionary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [
            (name, kind, key, term, n, hashes)
            for name, term, n in zip(b["list"], b["term"], b["n"], strict=True)
            for kind, key, hashes in _forms(PROFILES[name], term)
        ]
        yield pd.DataFrame(made, columns=["list", "form", "form_key", "term", "n", "hashes"])


def _by_broadcast(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """kind, text, term, distance of each text; the dictionary, made by tasks, goes to every task as flat arrays."""
    parts: dict[str, tuple[list, np.ndarray, np.ndarray]] = {}
    table = forms.orderBy("list", "term", "form", "form_key").toArrow()
    names = table["list"].to_numpy()
    rows = list(zip(*(table[c].to_pylist() for c in ("form", "form_key", "term", "n")), strict=True))
    lengths = pc.list_value_length(table["hashes"]).to_numpy()
    flat = pc.list_flatten(table["hashes"]).to_numpy()
    owner = np.repeat(names, lengths)
    for name in set(names):
        mine = names == name
        hashes = flat[owner == name]
        parts[name] = [r for r, on in zip(rows, mine, strict=True) if on], hashes, np.repeat(np.arange(mine.sum(), dtype=np.int32), lengths[mine])
    shared = texts.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {name: Matcher(*part, PROFILES[name]) for name, part in shared.value.items()}
        for b in batches:
            got = [matchers[k].match(t) if k in matchers else (None, -1.0) for k, t in zip(b["kind"], b["text"], strict=True)]
            yield b.assign(term=[x[0] for x in got], distance=[float(x[1]) for x in got])

    return texts.mapInPandas(run, "kind string, text string, term string, distance double")


def _by_join(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """The same for a list of any length: texts and entries meet in a join on the hashes of their deletes."""

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [
                (k, t, kind, key, most, _hashes(kind, head, most))
                for k, t in zip(b["kind"], b["text"], strict=True) if k in PROFILES
                for kind, key, head, most in _searches(PROFILES[k], t)
            ]
            yield pd.DataFrame(made, columns=["kind", "text", "form", "key", "most", "hashes"])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [_measure(*r) for r in zip(b["form"], b["key"], b["form_key"], b["most"], strict=True)]
            yield b.assign(distance=[np.nan if v is None else round(v, 3) for v in x])[["kind", "text", "term", "n", "distance"]].dropna(subset=["distance"])

    asked = texts.mapInPandas(wanted, "kind string, text string, form string, key string, most int, hashes array<bigint>")
    asked = asked.withColumn("hash", F.explode("hashes")).drop("hashes")
    known = forms.withColumn("hash", F.explode("hashes")).drop("hashes").withColumnRenamed("list", "kind")
    met = asked.join(known, ["kind", "form", "hash"]).drop("hash").distinct()
    near = met.mapInPandas(measured, "kind string, text string, term string, n bigint, distance double")
    best = near.groupBy("kind", "text").agg(F.min(F.struct("distance", (-F.col("n")).alias("seldom"), "term")).alias("b"))
    return best.select("kind", "text", "b.term", "b.distance")


def map_to_reference(
    rows: DataFrame, key: str, kind: Column, text: Column, references: dict[str, DataFrame]
) -> DataFrame:
    """One row per row given: key, kind, text, term (null: a miss), distance (-1: a miss).

    kind names the reference list of a row, and PROFILES how its texts are read; a kind without a list is a miss.
    references: term STRING, frequency BIGINT; null terms don't count, of equal ones the largest frequency does.
    Every different text is matched once. Lists of up to BROADCAST entries together are broadcast, longer ones joined.
    """
    src = rows.select(F.col(key).alias("key"), kind.alias("kind"), text.alias("text"))
    lists = None
    for name, entries in references.items():
        kept = entries.filter("term IS NOT NULL").groupBy("term").agg(F.coalesce(F.max("frequency"), F.lit(0)).cast("bigint").alias("n"))
        kept = kept.select(F.lit(name).alias("list"), "term", "n")
        lists = kept if lists is None else lists.unionByName(kept)
    # Matching costs far more than moving a short row: a fixed number of parts, which small data aren't gathered from.
    texts = src.filter("kind IS NOT NULL AND text IS NOT NULL").select("kind", "text")
    texts = texts.repartition(cores(rows.sparkSession), "kind", "text").distinct()
    if lists is None:
        found = texts.withColumns({"term": F.lit(None).cast("string"), "distance": F.lit(-1.0)})
    else:
        lists = cut(lists)
        forms = lists.repartition(cores(rows.sparkSession)).mapInPandas(_dictionary, _FORM)
        found = (_by_broadcast if lists.count() <= BROADCAST else _by_join)(texts, forms)
    out = src.join(found, ["kind", "text"], "left")
    return out.select(F.col("key").alias(key), "kind", "text", "term", F.coalesce("distance", F.lit(-1.0)).alias("distance"))


def latest(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """One row per key, the one loaded last."""
    picked = F.max(F.struct(F.col(at), *(F.col(c) for c in columns)))
    return rows.groupBy(key).agg(picked.alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in columns))


__all__ = ["DIAGNOSES", "DRUGS", "Matcher", "Profile", "distance", "latest", "map_to_reference", "within"]
