"""Visually identical text with different characters.

Each letter has a resolved script set: its own script and those in which a letter looks like it.  The
sets of a token's letters are intersected; a token with letters of several scripts that meet in one is mixed,
one that several scripts can spell is a whole-script confusable.  Both are respelled in the one
consistent script.  What is left is folded: width forms, ligatures, invisible characters, kinds of blanks,
composed accents.  Two texts look the same exactly when their consistent forms are equal; case, accents,
digits and spelling stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.session import cut

# Fixed values (look-alike letters of the Unicode confusables data, as far as Latin text meets them).
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaesijopcyxhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρυ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXoavpu"
# Letters that look alike, one class a word, the Latin letter first where there is one (Latin, Greek, Cyrillic, Armenian, Cherokee, Coptic).
CLASSES = (
    "AΑАᎪ BΒВᏴ CСϹᏟⅭ EΕЕᎬ FϜ GԌᏀ HΗНᎻ IΙІӀ JЈᎫͿ KΚКᏦ LᏞ MΜМᎷ NΝ OΟОՕ PΡРᏢ QԚ RᎡ SЅՏᏚ TΤТᎢ UՍ VѴᏙ WԜᎳ XΧХ YΥҮ ZΖᏃ "
    "aа cсϲ dԁ eе gɡց hһհ iі jјϳ lӏ nո oοоօ pρр qԛզ sѕ uυս vνѵ wԝ xх yу "
    "ΓГ ΛЛ ΠП ΦФ κк τт ωѡ"
).split()
#: Code points that have no width or are invisible where they stand.
INVISIBLE = "[­͏؜᠎​-‏‪-‮⁠-⁤﻿︀-️]"
#: Blanks of other width or breaking behaviour; all look like a blank.
BLANKS = "[   -   　]"
HYPHENS = "[‐‑]"

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
_HALF = "".join(chr(c) for c in range(0xFF65, 0xFF9E))
_KATA = "".join(unicodedata.normalize("NFKC", ch) for ch in _HALF)
_LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
#: Texts of these alone are their own form: printable ASCII, composed Latin letters, and
#: unified ideographs, full kana, syllables and plain Arabic letters, none of which has a double here.
PLAIN = "^[ -~\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u017f\\u0621-\\u064a\\u3041-\\u3096\\u30a1-\\u30fa\\u30fc\\u4e00-\\u9fff\\uac00-\\ud7a3]*$"

SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")
_COMMON = frozenset(SCRIPTS)


def script(ch: str) -> str | None:
    """Script of a letter, of those whose letters are confused; None for all other characters."""
    name = unicodedata.name(ch, "")
    return next((s for s in SCRIPTS if name.startswith(s + " ")), None)


#: Letter -> script -> the letter of that script that looks the same, itself included.
TWINS: dict[str, dict[str, str]] = {}
for _class in CLASSES:
    _by: dict[str, str] = {}
    for _ch in _class:
        if s := script(_ch):
            _by.setdefault(s, _ch)
    for _ch in _class:
        TWINS[_ch] = {**_by, **({s: _ch} if (s := script(_ch)) else {})}


@lru_cache(maxsize=100_000)
def script_set(ch: str) -> frozenset[str]:
    """Resolved script set: the scripts in which some letter looks like this one; all for what is no such letter."""
    if ch in TWINS:
        return frozenset(TWINS[ch])
    own = script(unicodedata.normalize("NFD", ch)[0])
    return frozenset((own,)) if own else _COMMON


def _token_scripts(token: str) -> frozenset[str]:
    """Intersection of the script sets of a token's letters; empty where no one script can spell it."""
    left = _COMMON
    for ch in token:
        left = left & script_set(ch)
    return left


def _in_script(token: str, name: str) -> str:
    return "".join(TWINS[ch].get(name, ch) if ch in TWINS else ch for ch in token)


_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f][^\W\d_]*)*")


def consistent(text: str) -> str:
    """The text with every token in one script, by the resolved script sets of its letters.

    A token whose sets meet in one script is spelled in it, which mends mixed tokens.  Where they meet in several, any of
    them spells the token (a whole-script confusable): the script that the text's unambiguous tokens are in
    decides, Latin if there are none or as many of each.  A token that no script can spell whole
    keeps the letters that only one has and takes for all others the script of most of these.
    """
    tokens = {t: _token_scripts(t) for t in set(_WORD.findall(text))}
    sure = Counter(next(iter(s)) for s in tokens.values() if len(s) == 1)
    order = sorted(SCRIPTS, key=lambda s: (-sure[s], SCRIPTS.index(s)))

    def spell(m: re.Match) -> str:
        t = m.group(0)
        able = tokens[t]
        if len(able) == len(SCRIPTS):
            return t
        if able:
            return _in_script(t, next(s for s in order if s in able))
        only = Counter(next(iter(s)) for s in map(script_set, t) if len(s) == 1)
        return _in_script(t, min(only, key=lambda s: (-only[s], SCRIPTS.index(s)))) if only else t

    return _WORD.sub(spell, text)


def fold_forms(c: Column) -> Column:
    """Width forms, blanks, hyphens and invisible characters; built-in SQL only."""
    x = F.regexp_replace(c, INVISIBLE, "")
    x = F.regexp_replace(F.regexp_replace(x, BLANKS, " "), HYPHENS, "-")
    x = F.translate(x, _FULL + _HALF, _ASCII + _KATA)
    return F.regexp_replace(x, "^ +| +$", "")


_MARKS = str.maketrans({"\uff9e": "\u3099", "\uff9f": "\u309a", **_LIGATURES})
_STYLED = re.compile("[\U0001d400-\U0001d7ff]")


def consistent_text(s: str) -> str:
    """Ligatures, halfwidth voicing marks and mathematical letters in their plain form, composed, in consistent scripts."""
    s = _STYLED.sub(lambda m: unicodedata.normalize("NFKC", m.group(0)), s.translate(_MARKS))
    return consistent(unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def consistent_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else consistent_text(s))


def is_plain(c: Column) -> Column:
    """True for texts that are their own form: no letter, blank or mark that has a double."""
    return c.rlike(PLAIN) & ~c.rlike("^ | $")


def normalised(df: DataFrame, text_col: str, form: str = "form") -> DataFrame:
    """Add the consistent form of ``text_col``; texts with equal forms look the same.

    NULL stays NULL, an empty text stays empty, the whole text counts.  A column of ``df``
    named like ``form`` is replaced.  Plain texts are their own form; only the
    others are folded and visit Python.
    """
    t = F.col(text_col)
    plain = F.coalesce(is_plain(t), F.lit(True))
    same = df.where(plain).withColumn(form, t)
    return same.unionByName(_respelled(df.where(~plain), text_col, form))


def _respelled(odd: DataFrame, text_col: str, form: str) -> DataFrame:
    return odd.withColumn(form, consistent_form(fold_forms(F.col(text_col))))


def lookalike_classes(df: DataFrame, key: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): which different texts look the same, and which keys hold each text.

    ``pairs`` (t, t2, form): each spelling but the least of a form with that least one, its representative.  ``members``
    (k, t, form): the keys of these texts.  Rows without key or text take no part; repeated
    rows count once.  Two plain texts with one form are the same string, so a class has a
    text that is not plain.  Those few are respelled once each; of the plain rows only the ones that
    equal such a form go on, so a text that a third of all rows share in one spelling meets nothing.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text_col).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    plain = is_plain(F.col("t"))
    odd = cut(_respelled(rows.where(~plain).select("t").distinct(), "t", "form"))
    twins = rows.where(plain).select("t").join(odd.select(F.col("form").alias("t")).distinct(), "t", "left_semi").distinct().withColumn("form", F.col("t"))
    spellings = odd.unionByName(twins)
    least = spellings.groupBy("form").agg(F.min("t").alias("t2"), F.count("*").alias("n")).where("n > 1").drop("n")
    alike = cut(spellings.join(least, "form").select("t", "t2", "form"))
    return alike.where("t <> t2"), rows.distinct().join(alike.select("t", "form"), "t")


def lookalike_pairs(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key_a, key_b): smaller key first, texts differ as strings and look the same.

    The classes of :func:`lookalike_classes`, written out between keys of different spellings.
    """
    members = cut(lookalike_classes(df, key, text_col)[1])
    other = members.select(F.col("k").alias("k2"), F.col("t").alias("t2"), "form")
    pairs = members.join(other, "form").where((F.col("t") != F.col("t2")) & (F.col("k") < F.col("k2")))
    return pairs.select(F.col("k").alias("key_a"), F.col("k2").alias("key_b")).distinct()


def lookalikes_of(names: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key_a, key_b) where a mention's text differs from the name of its id but looks the same.

    ``names`` (id, name), ``mentions`` (id, key, text).  Equi-joins on the id; of a pair that
    differs and looks the same one text is not plain, so plain mentions meet only the names
    that are not plain, and all others are never joined.
    """
    odd_names = cut(names.where(~is_plain(F.col("name"))))
    differing = mentions.where(~is_plain(F.col("text"))).join(names, "id").where(F.col("text") != F.col("name"))
    if not odd_names.isEmpty():
        differing = differing.unionByName(mentions.where(is_plain(F.col("text"))).join(odd_names, "id"))
    differing = cut(differing.select("id", "key", "text", "name").distinct())
    both = normalised(normalised(differing, "text", "f1"), "name", "f2")
    return both.where(F.col("f1") == F.col("f2")).select(F.col("id").alias("key_a"), F.col("key").alias("key_b")).distinct()
