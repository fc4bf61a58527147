"""Organisation identifiers: one canonical spelling for every comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of a bare identifier and the prefix of its canonical form.
BARE_PATTERN = "^0[a-hj-km-np-tv-z0-9]{6}[0-9]{2}$"
CANONICAL_PREFIX = "https://ror.org/"


def strip_ws(c: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bare_id(c: Column) -> Column:
    """The nine lower-case characters of an identifier, NULL where the text is not one.

    Any one of the three written prefixes is accepted, in any case, with blanks around it.
    """
    bare = F.regexp_replace(F.lower(strip_ws(c)), r"^(https://ror\.org/|http://ror\.org/|ror\.org/)", "")
    canonical = c.startswith(CANONICAL_PREFIX) & F.substring(c, len(CANONICAL_PREFIX) + 1, 99).rlike(BARE_PATTERN)
    # Most ids are stored in canonical form: one test spares them four patterns.
    return F.when(canonical, F.substring(c, len(CANONICAL_PREFIX) + 1, 9)).when(bare.rlike(BARE_PATTERN), bare)


def canonical_id(c: Column) -> Column:
    """Bare identifier behind the canonical prefix; NULL where the text is not an identifier."""
    bare = bare_id(c)
    return F.when(bare.isNotNull(), F.concat(F.lit(CANONICAL_PREFIX), bare))


def canonical_set(c: Column) -> Column:
    """Sorted distinct canonical identifiers of an array; members that are no identifier drop out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, canonical_id), lambda x: x.isNotNull())))


def bare_set(c: Column) -> Column:
    """Sorted distinct bare identifiers of an array; NULL array becomes empty."""
    kept = F.filter(F.transform(c, bare_id), lambda x: x.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))
