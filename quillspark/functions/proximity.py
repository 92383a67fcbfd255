"""Compiles proximity search terms to Java regular expressions.

A term is a sequence of slots; a slot is a word, several words, or alternatives `(a|b)`. Between slots stands nW (at most n
words between, in this order) or nD (either order). In words `+` is any ending, `?` one optional character, `#` one character,
`_` and `-` a hyphen, underscore or blank.
"""

from __future__ import annotations

import re

_GAP = re.compile(r"\s+(\d+)([WD])\s+")
_SPECIAL = {"+": r"\w*", "?": r"\w?", "#": r"\w", "_": r"[-_\s]", "-": r"[-_\s]"}


def _slot(text: str) -> str:
    options = text[1:-1].split("|") if text.startswith("(") else [text]
    return "(?:" + "|".join(r"\s+".join("".join(_SPECIAL.get(c) or re.escape(c) for c in w) for w in o.lower().split()) for o in options) + ")"


def term_regex(term: str) -> str:
    pieces = _GAP.split(term.strip())
    slots, gaps = [_slot(s) for s in pieces[::3]], list(zip(pieces[1::3], pieces[2::3], strict=True))
    between = [rf"(?:\W+\w+){{0,{n}}}\W+" for n, _ in gaps]
    forms = ["".join(x for pair in zip(slots, [*between, ""], strict=True) for x in pair)]
    if any(kind == "D" for _, kind in gaps):
        if len(slots) != 2:
            raise ValueError("nD takes two slots")
        forms.append(slots[1] + between[0] + slots[0])
    return "(?:" + "|".join(forms) + ")"


def terms_regex(terms: list[str]) -> str:
    """One pattern for any of the terms, for rlike: case-blind and with Unicode word characters. It starts at a word's start only."""
    return r"(?iU)\b(?:" + "|".join(map(term_regex, terms)) + ")"
