"""Several values packed in one field, one row per value with its position.

The text is split on its quote characters: odd pieces are literals, even pieces are split
on the delimiters.  Even pieces get a separator in place of each delimiter, all pieces fold
back into one text, and a split on the separator gives the values with their ordinals.
Everything is built-in SQL on one row at a time: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\u001e"
#: Marks of one list style each: a text that opens with the first may go on with the others.
_SUPER = "¹²³⁴⁵⁶⁷⁸⁹⁰"
DELIMITERS = r"[;；|｜\t\r\n]+|\s//?\s|\s*[•·‣▪]\s*"
NUMBERING = rf"(?U)^\s*(?:\(\s*(?:\p{{Nd}}{{1,2}}|[a-z])\s*\)|\[\s*(?:\p{{Nd}}{{1,2}}|[a-z])\s*\]|\p{{Nd}}{{1,2}}[.)](?!\p{{Nd}})|[{_SUPER}]+|[a-z]\)|[•·‣▪*\-–]\s)\s*"


def _mark_lists(s: Column) -> Column:
    """Put a separator before each further mark of a text that opens with a list mark."""
    paren = F.when(s.rlike(r"^\s*\(\s*1\s*\)"), F.regexp_replace(s, r"[,;]?\s*\(\s*\d{1,2}\s*\)", SEP + "(1)"))
    letter = F.when(s.rlike(r"^\s*\(\s*a\s*\)"), F.regexp_replace(s, r"[,;]?\s*\(\s*[a-z]\s*\)", SEP + "(a)"))
    square = F.when(s.rlike(r"^\s*\[\s*1\s*\]"), F.regexp_replace(s, r"[,;]?\s*\[\s*\d{1,2}\s*\]", SEP + "[1]"))
    upper = F.when(s.rlike("^\\s*¹"), F.regexp_replace(s, rf"[,;]?\s*[{_SUPER}]+", SEP + "¹"))
    dotted = F.when(s.rlike(r"^\s*1\.\s") & s.rlike(r"[\s,;]2\.\s"), F.regexp_replace(s, r"[,;]?(?:^|\s)\d{1,2}\.\s", SEP + "1. "))
    ringed = F.when(s.rlike(r"^\s*1\)") & s.rlike(r"[\s,;]2\)"), F.regexp_replace(s, r"[,;]?(?:^|\s)\d{1,2}\)\s?", SEP + "1) "))
    return F.coalesce(paren, letter, square, upper, dotted, ringed, s)


def _quoted(s: Column, opening: str, closing: str) -> Column:
    """Separators in the even pieces of ``s``; the quote characters stay in place."""
    pieces = F.split(s, f"[{opening}{closing}]" if opening != closing else opening, -1)

    def even(p: Column) -> Column:
        lone = p.rlike(r"^\s*[,，]\s*$")
        return F.when(lone, F.lit(SEP)).otherwise(F.regexp_replace(p, DELIMITERS, SEP))

    def fold(acc: Column, p: Column) -> Column:
        odd = acc["n"] % 2 == 1
        piece = F.when(odd, F.concat(F.lit(opening), p, F.lit(closing))).otherwise(even(p))
        return F.struct((acc["n"] + 1).alias("n"), F.concat(acc["t"], piece).alias("t"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), fold, lambda a: a["t"])


def _unquoted(p: Column) -> Column:
    """Take off straight quotes that enclose the whole value and undo doubling or escaping inside."""
    inner = F.regexp_extract(p, r'(?s)^"(.*)"$', 1)
    closed = p.rlike(r'(?s)^"(?:[^"]|"")*"$')
    return F.when(closed, F.replace(F.replace(inner, F.lit('""'), F.lit('"')), F.lit('\\"'), F.lit('"'))).otherwise(p)


def _uncurled(p: Column) -> Column:
    """Take off typographic quotes that enclose the whole value."""
    curly = p.rlike("(?s)^«[^«»]*»$") | p.rlike("(?s)^“[^“”]*”$")
    return F.when(curly, F.regexp_extract(p, "(?s)^.(.*).$", 1)).otherwise(p)


def _unmarked(p: Column) -> Column:
    trimmed = F.regexp_replace(p, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, NUMBERING, ""), r"(?U)\s+$", "")


def _tidy(pieces: Column) -> Column:
    """Each step is a pass of its own: a step that names its value several times would run all before it as often."""
    inner = F.transform(F.transform(F.transform(pieces, _unmarked), _unquoted), _uncurled)
    return F.transform(inner, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""), r"(?U)[\s,，;；|]+$", ""))


def split_packed(text: Column) -> Column:
    """Array of the values packed in ``text``, in order, blanks and numbering taken off.

    NULL gives NULL, an empty or blank text gives an empty array, a text without delimiter
    gives one value.  Texts with an odd number of straight quotes have no quoting.  The
    whole text counts, however long.
    """
    listed = text.rlike(r'(?s)^\s*\[\s*".*"\s*\]\s*$')
    body = F.when(listed, F.replace(F.regexp_extract(text, r"(?s)^\s*\[(.*)\]\s*$", 1), F.lit('\\"'), F.lit('""'))).otherwise(text)
    straight = F.length(body) - F.length(F.replace(body, F.lit('"')))
    has_straight = (straight > 0) & (straight % 2 == 0)
    marked = (
        F.when(has_straight, _quoted(body, '"', '"'))
        .when(body.rlike("«[^«»]*»"), _quoted(body, "«", "»"))
        .when(body.rlike("“[^“”]*”"), _quoted(body, "“", "”"))
        .otherwise(F.regexp_replace(_mark_lists(body), DELIMITERS, SEP))
    )
    return F.filter(_tidy(F.split(marked, SEP, -1)), lambda p: F.length(p) > 0)


def explode_packed(df: DataFrame, key: str, text_col: str, least: int = 2) -> DataFrame:
    """(key, pos, part_text) for every row that packs at least ``least`` values; pos from 1.

    Rows with a NULL or blank text give nothing.  Repeated rows give repeated parts.
    """
    parts = df.select(F.col(key), split_packed(F.col(text_col)).alias("parts")).where(F.size("parts") >= least)
    out = parts.select(key, F.posexplode("parts").alias("pos", "part_text"))
    return out.select(key, (F.col("pos") + 1).cast("bigint").alias("pos"), "part_text")
