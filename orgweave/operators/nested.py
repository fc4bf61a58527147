"""Deeply nested records to flat, linked tables.

Every record is parsed into (record_id, member, path, ordinals, value) triples: ``path`` names the
leaf with ``[]`` at each list, ``ordinals`` holds one position per ``[]``, ``member`` tells the
records apart that one text wraps in a list.  Paths that share
their deepest repeated ancestor form one group, and each group pivots into one table whose
key is (record_id, member, ordinals) and whose parent key is the same list without its last place.

Two parsers give the same triples: :func:`triples_from_json` stream-parses text of any shape in one
pass per record (Arrow batches), without building its tree, :func:`triples_from_struct` unfolds a typed column inside
the JVM.  Neither needs a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE_FIELDS = "record_id bigint, member int, path string, ordinals array<int>, value string"


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_OPEN, _CLOSE, _KEY, _LEAF = range(4)


def events(text: str) -> Iterator[tuple[int, object]]:
    """Events of a JSON text in document order, read once from front to back; no tree is built.

    ``_OPEN`` with the bracket, ``_CLOSE``, ``_KEY`` and ``_LEAF`` with the value.  Raises ValueError
    where the text is no JSON document.
    """
    closing = {"{": "}", "[": "]"}
    inside: list[str] = []
    at, end = _BLANK.match(text).end(), len(text)
    wants = "value"  # or: first (value or ]), name (key or }), key, next (comma or end)
    while True:
        ch = text[at : at + 1]
        if wants == "next":
            if not inside:
                if at != end:
                    raise ValueError(f"text after the document at {at}")
                return
            if ch == ",":
                wants, at = "key" if inside[-1] == "{" else "value", _BLANK.match(text, at + 1).end()
                continue
            if ch != closing[inside[-1]]:
                raise ValueError(f"no comma at {at}")
        if ch == "}" and wants in ("name", "next") or ch == "]" and wants in ("first", "next"):
            inside.pop()
            yield _CLOSE, None
            wants, at = "next", at + 1
        elif wants in ("name", "key"):
            if ch != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1, True)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            yield _KEY, key
            wants, at = "value", at + 1
        elif ch == '"':
            value, at = scanstring(text, at + 1, True)
            yield _LEAF, value
            wants = "next"
        elif ch in ("{", "["):
            inside.append(ch)
            yield _OPEN, ch
            wants, at = "name" if ch == "{" else "first", at + 1
        elif word := next((w for w in _WORDS if text.startswith(w, at)), None):
            yield _LEAF, _WORDS[word]
            wants, at = "next", at + len(word)
        elif number := _NUMBER.match(text, at):
            yield _LEAF, float(number[0]) if number[1] or number[2] else int(number[0])
            wants, at = "next", number.end()
        else:
            raise ValueError(f"no value at {at}")
        at = _BLANK.match(text, at).end()


def _scalar(v: object) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return str(int(v))
    return v if isinstance(v, str) else json.dumps(v)


@dataclass(slots=True)
class _Open:
    """A container that is being read: its path (None where it is passed over), place and member."""

    listed: bool
    path: str | None
    at: tuple[int, ...]
    top: bool
    member: int
    begun: int
    key: str = ""
    place: int = -1
    unwrapped: bool = False


def leaves(text: str, lists: frozenset[str], embedded: frozenset[str], envelopes: frozenset[str], path: str = "", at: tuple[int, ...] = (), member: int = -1) -> list[tuple[int, str, tuple[int, ...], str]]:
    """(member, path, ordinals, value) of every leaf, from one pass over the events of ``text``.

    ``lists``: paths that hold lists; a lone value there counts as a list of one.
    ``embedded``: paths whose text value is itself a JSON document.
    ``envelopes``: keys at the top that only wrap the record, so what stands beside them is left
    out; a list at the top or in an envelope wraps several, numbered by ``member`` from 0.
    Open containers are held on a stack of their own, so any depth is fine.
    """
    out: list[tuple[int, str, tuple[int, ...], str]] = []
    stack: list[_Open] = []
    count = member if path else -1
    for kind, value in events(text):
        if kind == _KEY:
            stack[-1].key = value
            continue
        if kind == _CLOSE:
            stack.pop()
            continue
        top, here, places, mine = not path, path, at, count
        if stack:
            up = stack[-1]
            top, here, places, mine = False, up.path, up.at, up.member
            if up.listed:
                up.place += 1
            if up.path is None or up.unwrapped and not up.listed:
                here = None
            elif up.listed and up.top:
                top = True
            elif up.listed:
                here, places = f"{up.path}[]", (*up.at, up.place)
            elif up.top and up.key in envelopes and kind == _OPEN:
                del out[up.begun :]
                up.unwrapped, top, count = True, True, up.member - 1
            else:
                here = f"{up.path}.{up.key}" if up.path else up.key
        if here is not None and kind == _LEAF:
            if value is None or top:
                continue
            if here in embedded and isinstance(value, str):
                try:
                    out += leaves(value, lists, embedded, envelopes, here, places, mine)
                except ValueError:
                    pass
                continue
        lone = here is not None and here in lists and not here.endswith("[]") and value != "["
        if kind == _LEAF:
            if here is not None:
                out.append((mine, f"{here}[]", (*places, 0), _scalar(value)) if lone else (mine, here, places, _scalar(value)))
            continue
        if top and value == "{":
            count += 1
            mine = count
        if lone:
            here, places = f"{here}[]", (*places, 0)
        stack.append(_Open(value == "[", here, places, top, mine, len(out)))
    return out


def triples_from_json(
    df: DataFrame,
    id_col: str,
    payload_col: str,
    *,
    lists: Sequence[str] = (),
    embedded: Sequence[str] = (),
    envelopes: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Triples of JSON texts whose shapes vary from row to row.

    Defined results: NULL, empty and unreadable payloads give no triple; a byte-order mark
    before the document is skipped; JSON nulls give no triple but count as list places; a
    lone value at a path of ``lists`` is a list of one; repeated rows give repeated triples.
    ``keep`` limits the output to the named leaf paths (all when empty), so that unused
    leaves never leave the Python worker.
    """
    ls, em, en, kp = frozenset(lists), frozenset(embedded), frozenset(envelopes), frozenset(keep)
    schema = pa.schema([("record_id", pa.int64()), ("member", pa.int32()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("value", pa.string())])

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, members, paths, ords, values = [], [], [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                try:
                    found = leaves(text.lstrip("﻿"), ls, em, en)
                except (ValueError, RecursionError):  # the latter for documents in documents without end
                    continue
                for member, path, at, value in found:
                    if not kp or path in kp:
                        ids.append(rid)
                        members.append(member)
                        paths.append(path)
                        ords.append(at)
                        values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(members, pa.int32()), pa.array(paths, pa.string()), pa.array(ords, pa.list_(pa.int32())), pa.array(values, pa.string())], schema=schema
            )

    return df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).cast("string").alias("payload")).mapInArrow(shred, TRIPLE_FIELDS)


def _unfold(value: Column, dtype: T.DataType, path: str, at: Column, keep: Sequence[str]) -> list[Column]:
    """Expressions that each give an array of (path, ordinals, value) structs."""
    if keep and not any(k == path or k.startswith((path + ".", path + "[]")) or not path for k in keep):
        return []
    if isinstance(dtype, T.StructType):
        return [e for f in dtype.fields for e in _unfold(value.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name, at, keep)]
    if isinstance(dtype, T.ArrayType):
        probe = _unfold(F.lit(None).cast(dtype.elementType), dtype.elementType, f"{path}[]", at, keep)
        if not probe:
            return []

        def inner(x: Column, i: Column) -> Column:
            parts = _unfold(x, dtype.elementType, f"{path}[]", F.concat(at, F.array(i.cast("int"))), keep)
            return F.concat(*parts) if len(parts) > 1 else parts[0]

        empty = F.array().cast("array<struct<path:string,ordinals:array<int>,value:string>>")
        return [F.coalesce(F.flatten(F.transform(value, inner)), empty)]
    if keep and path not in keep:
        return []
    return [F.filter(F.array(F.struct(F.lit(path).alias("path"), at.alias("ordinals"), value.cast("string").alias("value"))), lambda t: t["value"].isNotNull())]


def triples_from_struct(df: DataFrame, id_col: str, nested_col: str, *, root: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """Triples of a typed nested column, unfolded by higher-order functions and one explode.

    ``root`` is the path of the column itself, so that triples line up with those of JSON
    records that hold the column below a key.  NULL values give no triple but count as list
    places, exactly as in :func:`triples_from_json`.
    """
    dtype = df.schema[nested_col].dataType
    parts = _unfold(F.col(f"`{nested_col}`"), dtype, root, F.array().cast("array<int>"), keep)
    if not parts:
        raise ValueError(f"no leaf of {nested_col} is kept")
    unfolded = F.concat(*parts) if len(parts) > 1 else parts[0]
    return df.select(F.col(id_col).cast("bigint").alias("record_id"), F.explode(unfolded).alias("t")).select("record_id", F.lit(0).alias("member"), "t.path", "t.ordinals", "t.value")


def groups_of(paths: Sequence[str]) -> dict[str, list[str]]:
    """Leaf paths by their deepest repeated ancestor ('' for leaves outside any list)."""
    out: dict[str, list[str]] = {}
    for p in paths:
        head, mark, _ = p.rpartition("[]")
        out.setdefault(head + mark, []).append(p)
    return out


def leaf_name(path: str) -> str:
    """Column name of a leaf within its group's table."""
    head, mark, tail = path.rpartition("[]")
    return tail.lstrip(".").replace(".", "_") or head.rpartition(".")[2]


def pivot_groups(triples: DataFrame, paths: Sequence[str]) -> DataFrame:
    """All groups of ``paths`` as one wide table: (record_id, member, ancestor, ordinals, one column per leaf).

    One partial and one final aggregation on (record_id, member, ancestor, ordinals) serve every
    group, and nothing is gathered per record, so a record that holds a third of all leaves
    is no hot spot.  Leaves of one name in several groups share a column.  A leaf stated
    twice under one key keeps its smallest value, so repeated records count once.
    """
    names = sorted({leaf_name(p) for p in paths})
    head = F.regexp_extract("path", r"^(.*\[\])?[^\[\]]*$", 1)
    own = {n: [p for p in paths if leaf_name(p) == n] for n in names}
    leaves = [F.min(F.when(F.col("path").isin(own[n]), F.col("value"))).alias(n) for n in names]
    return triples.where(F.col("path").isin(list(paths))).groupBy("record_id", "member", head.alias("ancestor"), "ordinals").agg(*leaves)


def pivot_group(triples: DataFrame, ancestor: str, paths: Sequence[str]) -> DataFrame:
    """The flat table of one group: record_id, member, ordinals (key), parent_ordinals (key of the
    enclosing list's table) and one column per leaf."""
    depth = ancestor.count("[]")
    parent = F.slice("ordinals", 1, depth - 1) if depth > 1 else F.array().cast("array<int>")
    wide = pivot_groups(triples, paths)
    return wide.select("record_id", "member", "ordinals", parent.alias("parent_ordinals"), *[c for c in wide.columns if c not in ("record_id", "member", "ancestor", "ordinals")])


def shred_tables(triples: DataFrame, paths: Sequence[str]) -> dict[str, DataFrame]:
    """Every group of ``paths`` as a flat table, keyed by its repeated ancestor."""
    return {a: pivot_group(triples, a, ps) for a, ps in groups_of(paths).items()}
