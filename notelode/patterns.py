"""Pattern strings for Java's regular expressions, built once on the driver from a lexicon."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from notelode.functions.text import NO_WORD_AFTER, NO_WORD_BEFORE, WS, any_of, escape
from notelode.lexicon import Lexicon, without_subsumed

# The tokens that may follow a drug: amounts, bare units, routes, forms, frequencies, release.
_UNITS = "mg|mcg|g|ml|iu|unit|units|meq"
_BARE_UNITS = "mg|mcg|g|ml"
_PER = "ml|mg|g"
_ROUTES = "po|iv|im|sc|subcut|subq|pr|sl|top|inh|neb"
_FORMS = "oral|suspension|tablet|tablets|capsule|capsules|cream|ointment|drops|syrup|inhaler|patch|injection|solution|elixir"
_FREQUENCIES = rf"daily|qd|bid|tid|qid|qhs|qam|qpm|prn|q\p{{Nd}}+h|q\p{{Nd}}+-\p{{Nd}}+h|weekly|x{WS}*\p{{Nd}}+"
_RELEASES = "extended[- ]release|xl|xr|er|cr|sr"
# Units of a lab value, links between a lab name and its value.
_LAB_UNITS = "mg/dl|mmol/l|g/dl|%|u/l|/mm3"
_LAB_LINKS = "là|:"

_DIGIT = r"\p{Nd}"
HEADER = rf"^{WS}*{_DIGIT}+\.(?s:.)"


@dataclass(frozen=True)
class Patterns:
    drug: str  # two groups: term, dose
    diagnosis: str  # one group
    symptom: str  # one group
    lab: str  # three groups: name, link, value
    lab_hint: str
    lab_names: str
    negation: str
    family: str
    historical: str
    longest: int  # of the cues
    sections: str


def _dose() -> str:
    # An amount, and what may follow it.
    amount = rf"{_DIGIT}+[.,]?{_DIGIT}*"
    tokens = "|".join(
        [
            rf"{amount}(?:-{amount})?{WS}*(?:{_UNITS}){NO_WORD_AFTER}(?:/(?:{_PER}))?",
            rf"(?:{_BARE_UNITS}){NO_WORD_AFTER}",
            _ROUTES,
            _FORMS,
            _FREQUENCIES,
            _RELEASES,
        ]
    )
    # Nothing follows the loop, so it never has to give a token back: possessive, hence no recursion on long runs.
    return rf"(?:(?:{WS}|[,:])*(?:{tokens}){NO_WORD_AFTER})*+"


#: Matches nowhere: an empty list means that nothing is on it.
NOTHING = "(?!)"


def _listed(terms: Iterable[str]) -> str:
    return "|".join(map(escape, terms)) or NOTHING


def _cues(cues: tuple[str, ...]) -> str:
    """Any cue between word boundaries. A cue that begins with another one and a blank adds nothing to a test of existence."""
    if not cues:
        return NOTHING
    few = [c for c in cues if not any(c != o and c.startswith(o + " ") for o in cues)]
    return NO_WORD_BEFORE + "(?:" + "|".join(map(escape, few)) + ")" + NO_WORD_AFTER


def _check(drugs: Iterable[str]) -> None:
    """A dose is taken in together with its drug, which is right as long as no drug begins in a dose and goes on after it."""
    tokens = "|".join([_UNITS, _BARE_UNITS, _ROUTES, _FORMS, "daily|qd|bid|tid|qid|qhs|qam|qpm|prn|weekly", "extended-release|extended release|xl|xr|er|cr|sr"])
    ends = {w[i:] for w in tokens.split("|") for i in range(len(w))}
    for term in drugs:
        for m in re.finditer(r"\w(?!\w)", term[:-1]):
            head = re.sub(r"^\d+[.,]?\d*\s*", "", term[: m.end()])
            if head in ends:
                raise ValueError(f"drugs: a term must not begin like the end of a dose: {term!r}")


def build(lexicon: Lexicon) -> Patterns:
    _check(lexicon.drugs)
    # What a lab name and a value look like.
    name = rf"[a-zA-ZÀ-ỹ][a-zA-ZÀ-ỹ0-9 %/\-]{{1,40}}?(?:{WS}*\([^)]{{1,60}}\))?"
    value = rf"-?{_DIGIT}+[.,]?{_DIGIT}*{WS}*(?:{_LAB_UNITS})?"
    return Patterns(
        drug=f"(?iu)({any_of(lexicon.drugs)})({_dose()})",
        diagnosis=f"(?iu)({any_of(lexicon.diagnoses)})",
        symptom=f"(?iu)({any_of(lexicon.symptoms)})",
        lab=f"(?iu)({name})({WS}*(?:{_LAB_LINKS}){WS}*)({value})",
        lab_hint=rf"(?iu)(?:{_LAB_LINKS}){WS}*-?{_DIGIT}",
        lab_names=_listed(without_subsumed(lexicon.labs)),
        negation=_cues(lexicon.negation),
        family=_cues(lexicon.family),
        historical=_cues(lexicon.historical),
        longest=max(map(len, (*lexicon.negation, *lexicon.family, *lexicon.historical)), default=0),
        sections=_listed(without_subsumed(lexicon.sections)),
    )
