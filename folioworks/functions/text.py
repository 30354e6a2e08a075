"""Text expressions: normalization, tokens, snippets, keyword terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as the text rules know it, snippet size, synonyms of keyword terms.
SPACE_CLASS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
OTHER_SPACE = SPACE_CLASS.replace(r"\s", r"\t-\r")
# A run that is not one space already; most characters fail at the range before it.
SPACE_RUN = f"(?![!-~])(?: {SPACE_CLASS}|{OTHER_SPACE}){SPACE_CLASS}*"
SNIPPET_CHARS = 320
SYNONYMS = {
    "job": ("role", "position", "employment", "experience"),
    "jobs": ("roles", "positions", "employment", "experience"),
    "work": ("employment", "experience", "role"),
    "employer": ("company", "organization"),
    "salary": ("compensation", "pay", "wage"),
    "resume": ("cv", "curriculum"),
    "phone": ("mobile", "cell", "telephone"),
    "address": ("street", "city"),
}


# Characters that composition leaves as they are, whatever stands beside them.
COMPOSED = (
    r"\x{0}-\x{2FF}\x{370}-\x{373}\x{375}-\x{37D}\x{37F}-\x{386}\x{388}-\x{482}\x{48A}-\x{590}\x{2002}-\x{20CF}\x{2100}-\x{2125}\x{2190}-\x{2328}\x{232B}-\x{2ADB}"
    r"\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF01}-\x{FFEF}\x{1F300}-\x{1FAFF}"
)


def by_parts(values: pa.Array, one: Callable[[pa.Array], pa.Array], size: int = 256) -> pa.Array:
    """``one`` of ``size`` rows after the other, so that a worker holds Python objects of few rows only."""
    return pa.concat_arrays([one(values.slice(i, size)) for i in range(0, max(1, len(values)), size)])


@F.arrow_udf(StringType())
def _nfc(x: pa.Array) -> pa.Array:
    return by_parts(x, lambda part: pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in part.to_pylist()], pa.string()))


def nfc(text: Column) -> Column:
    """Canonical composition; texts that it cannot change stay in the JVM values they are."""
    unsure = (F.length(text) != F.octet_length(text)) & ~F.rlike(text, F.lit(rf"\A[\x{{0}}-\x{{2FF}}]*+[{COMPOSED}]*+\z"))
    return F.coalesce(_nfc(F.when(unsure, text)), text)


def collapse_space(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """NFC (unless ``compose`` is off for texts known to be composed), then single spaces."""
    return collapse_space(nfc(text) if compose else text)


def tokens(text: Column) -> Column:
    """White-space tokens; none for an empty text."""
    return F.filter(F.split(collapse_space(text), " "), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def truncate_tokens(text: Column, limit: Column | int) -> Column:
    """The text as it is if it has at most ``limit`` tokens, else its first ones joined by spaces."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    own = tokens(text)
    return F.when(F.size(own) <= limit, text).otherwise(F.array_join(F.slice(own, F.lit(1), limit.cast("int")), " "))


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """A trimmed text of at most ``chars`` characters, else cut at its last space there, with an ellipsis."""
    own = F.trim(text)
    return F.when(F.length(own) <= chars, own).otherwise(F.concat(F.regexp_replace(F.substring(own, 1, chars), " [^ ]*$", ""), F.lit("…")))


def keyword_terms(text: Column) -> Column:
    """Distinct lower-case terms of two letters or digits and more, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))


def expand_terms(text: Column, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> Column:
    """Keyword terms without possessive endings, followed by their synonyms."""
    base = F.regexp_replace(F.lower(text), r"['’]s\b", "")
    terms = F.regexp_extract_all(base, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    extra = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_union(terms, extra)


def escape_like(term: Column) -> Column:
    """A literal for LIKE with backslash as escape."""
    out = F.replace(term, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def contains_ignoring_case(value: Column, term: str) -> Column:
    return F.lower(value).contains(term.lower())
