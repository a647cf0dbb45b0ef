"""Column functions on text with the semantics of code-point strings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode text processing: 29 characters, more than Java's default six.
WS = r"(?U:[\s\x1c-\x1f])"
#: A place with no word character before, or after it; the same on every JDK.
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: A private character that marks matches, and the one that stands in for it where a text has it.
MARK, STAND_IN = "\ue000", "\uf8ff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once, then body over it; keeps the optimizer from copying value into each use."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"^{WS}*\z")


def escape(term: str) -> str:
    """A literal for a Java or RE2 pattern."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in term)


def any_of(terms: Iterable[str]) -> str:
    """A Java pattern that finds the longest of the terms at a place.

    Terms share their prefixes as in a trie, so a place costs one test per different first character instead of one
    per term; a leading class of first characters skips most places at once.
    """
    trie: dict = {}
    for term in terms:
        node = trie
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}
    if not trie:
        return "(?!)"

    def render(node: dict) -> str:
        branches = [escape(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + ("?" if "" in node else "")

    return rf"(?=[{''.join(escape(ch) for ch in sorted(trie))}])" + render(trie)


def marked_parts(line: Column, pattern: str, groups: int) -> Column:
    """Split a line around all matches of a pattern that consists of so many adjacent groups.

    The result alternates: text between, group 1 .. n, text between, ... A group that took no part is empty.
    """
    shown = "".join(f"{MARK}${i + 1}" for i in range(groups)) + MARK
    safe = F.translate(line, MARK, STAND_IN)
    return F.split(F.regexp_replace(safe, pattern, shown), MARK, -1)


#: Elements of an array that are gone through together.
BLOCK = 32


def running(numbers: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """op over the first 0, 1, .. n elements of an array of whole numbers; op is associative, zero its neutral element.

    A fold that lengthens an array copies it at every step. Here no fold gives out more than a number: one over each
    block, one over the blocks before, and one over what stands before an element in its block.
    """
    none = F.lit(zero)
    whole = lambda xs: F.aggregate(xs, none, op)
    upto = lambda n: F.sequence(F.lit(0), n)

    def placed(v: Column, blocks: Column) -> Column:
        inside = lambda i: whole(F.slice(v, i - i % BLOCK + 1, i % BLOCK))
        return F.transform(upto(F.size(v)), lambda i: op(F.get(blocks, (i / BLOCK).cast("int")), inside(i)))

    def before(v: Column) -> Column:
        each = F.transform(upto((F.size(v) / BLOCK).cast("int")), lambda i: whole(F.slice(v, i * BLOCK + 1, BLOCK)))
        sums = let(each, lambda s: F.transform(upto(F.size(s)), lambda i: whole(F.slice(s, 1, i))))
        return let(sums, lambda blocks: placed(v, blocks))

    return let(numbers, before)


SPANS = "array<struct<s:int,e:int,groups:array<string>,ends:array<int>>>"


def spans(parts: Column, groups: int) -> Column:
    """array<struct<s, e, groups, ends>> of all matches: place, texts of the groups, and the n + 1 places that bound them."""
    period = groups + 1

    def found(parts: Column) -> Column:
        # Starting places of all parts by a running sum of lengths.
        return let(
            running(F.transform(parts, F.length), lambda x, y: x + y, 0),
            lambda b: F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1, F.lit(period)),
                lambda i: F.struct(
                    F.get(b, i).alias("s"),
                    F.get(b, i + groups).alias("e"),
                    F.slice(parts, i + 1, groups).alias("groups"),
                    F.slice(b, i + 1, groups + 1).alias("ends"),
                ),
            ),
        ).cast(SPANS)

    # Most lines have no match; they end here.
    return let(parts, lambda p: F.when(F.size(p) > 1, found(p)).otherwise(F.array().cast(SPANS)))
