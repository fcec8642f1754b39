"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from plumbline import fixed

_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
HEDGE_PATTERN = r"(?i)\b(?:" + "|".join(fixed.HEDGES) + r")\b"


def text(c: Column | str) -> Column:
    """Null counts as the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.trim(c, F.lit(_BLANKS))


def content_tokens(c: Column, stop: Sequence[str] = fixed.NANO_STOP) -> Column:
    """Distinct lower-case letter runs of two or more letters that are not stop words.

    One split and one hashed set difference, which also drops repeats, single letters and blanks.
    """
    dropped = F.array(*[F.lit(w) for w in ["", *string.ascii_lowercase, *(w for w in stop if len(w) > 1)]])
    return F.array_except(F.split(F.lower(c), "[^a-z]+"), dropped)


def capitalised_tokens(c: Column) -> Column:
    """Distinct runs that begin with a capital; no word boundary, so ``iPhone`` gives ``Phone``."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Z][a-zA-Z]+"), F.lit(0)))


def white_words(c: Column) -> Column:
    """Words between (Unicode) white space."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def white_tokens(c: Column) -> Column:
    return F.array_distinct(white_words(F.lower(c)))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def joined_size(a: Column, b: Column) -> Column:
    """Size of the union of two arrays without repeats."""
    return F.size(a) + F.size(b) - shared(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over union; an empty union counts as one, so the result is 0."""
    return shared(a, b) / F.greatest(joined_size(a, b), F.lit(1))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two token sets; 0 when nothing is shared."""
    c = shared(a, b)
    precision = c / F.greatest(F.size(a), F.lit(1))
    recall = c / F.greatest(F.size(b), F.lit(1))
    return F.when(c > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def has_hedge(c: Column) -> Column:
    return F.regexp_like(c, F.lit(HEDGE_PATTERN))


def hedge_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HEDGE_PATTERN))


def hedge_density(c: Column) -> Column:
    """Hedges per ten words, at most 1."""
    words = F.greatest(word_count(c), F.lit(1))
    return F.least(hedge_count(c) / (words / F.lit(10.0) + F.lit(1e-6)), F.lit(1.0))


def is_factoid(question: Column) -> Column:
    q = strip(F.lower(question))
    hit = F.lit(False)
    for prefix in fixed.FACTOID_PREFIXES:
        hit = hit | q.startswith(prefix)
    return hit


def long_factoid_answer(question: Column, answer: Column) -> Column:
    return F.when(is_factoid(question) & (word_count(answer) > 8), 1.0).otherwise(0.0)


def safe_name(c: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay; everything else becomes ``_``."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_-]", "_")


def marked_number(c: Column) -> Column:
    """The number after ``####``."""
    return F.regexp_extract(c, r"####\s*(-?[0-9.]+)", 1)


def last_line(c: Column) -> Column:
    lines = F.filter(F.split(strip(c), "\n"), lambda x: F.length(strip(x)) > 0)
    return F.coalesce(strip(F.try_element_at(lines, F.lit(-1))), F.lit(""))


def non_ascii_share(c: Column) -> Column:
    total = F.length(c)
    return F.when(total > 0, F.regexp_count(c, F.lit(r"[^\x00-\x7F]")) / total).otherwise(0.0)


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
