"""Company names: normal forms, core keys, persons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx


def words_of(name: Column) -> Column:
    """Upper-case alphanumeric words of a name, one blank between."""
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))


def norm(name: Column) -> Column:
    """Without exchange tags in brackets, then as words_of."""
    return words_of(F.regexp_replace(F.upper(name), r"\((LAST KNOWN|NEW|OLD|DEL|POST|PRE)[^)]*\)", " "))


def shortened(tokens: Column) -> Column:
    """Tokens with their short forms."""
    table = F.create_map(*(F.lit(x) for pair in lx.SHORT_FORMS.items() for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def core(name: Column) -> Column:
    """The core key: short forms, all trailing legal words gone, then leading THE gone; empty if nothing is left."""
    text = F.array_join(shortened(F.split(norm(name), " ")), " ")
    tail = "|".join(lx.LEGAL)
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(^| )(({tail})( |$))+$", ""), "^(THE( |$))+", ""))


def clean_once(name: Column) -> Column:
    """Upper case, no commas and dots, one trailing legal suffix gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), "[,.]", ""), rf"\s+({'|'.join(lx.ONE_SUFFIX)})$", ""))


def without_country(name: Column) -> Column:
    """Without a trailing bracketed country."""
    return F.regexp_replace(name, r"\s*\([^)]+\)\s*$", "")


def has_legal(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, lx.LEGAL_STRICT)))


def is_person(name: Column, given: Column) -> Column:
    """Surname and given names or initials, two to four words, without legal or institution words. given: array of names."""
    t = F.split(words_of(name), " ")
    rest = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    names = F.forall(rest, lambda x: F.array_contains(given, x) | x.rlike("^[A-Z]$"))
    return F.size(t).between(2, 4) & ~has_legal(t) & ~F.arrays_overlap(t, F.array(*map(F.lit, lx.INSTITUTIONS))) & names
