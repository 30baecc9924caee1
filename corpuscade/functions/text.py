"""Sentences, tokens, search terms and bigrams of a text, all as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every character of a text falls into exactly one sentence, so joining the
# sentences gives the text back.
SENTENCE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
TOKEN = r"\S+"
TERM = r"[\p{L}\p{N}]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used: a lambda's argument
    is not evaluated again, while equal expressions inside a lambda are."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def bigrams(term_list: Column) -> Column:
    """Neighbouring term pairs, written ``a b``; empty below two terms."""
    return F.when(
        F.size(term_list) >= 2,
        F.zip_with(
            F.slice(term_list, F.lit(1), F.size(term_list) - 1),
            F.slice(term_list, F.lit(2), F.size(term_list) - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def share(asked: Column, held: Column) -> Column:
    """Share of the different items of ``asked`` that are in ``held``; 0 if there are none."""

    def found(q: Column) -> Column:
        return F.coalesce(F.size(F.array_intersect(q, held)).cast("double") / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))

    return once(F.array_distinct(asked), found)


def features(text: Column) -> Column:
    """Distinct terms and bigrams; a bigram holds a space, a term never does."""
    return once(terms(text), lambda t: F.concat(F.array_distinct(t), F.array_distinct(bigrams(t))))
