"""Evaluation texts leaking into training text, by spaced-seed hashing.

A fixed mask keeps some of the token positions in its span and ignores the others, so a hash
over the kept ones survives substitutions at the ignored ones.  Hashes of the test items are
joined with those of the corpus; around each hit a local alignment counts the words that the
document shares with the item, substitutions, insertions and losses allowed.

Token ids come from the vocabulary of the test items, hence a document without two of their
words in place costs one pass over its text.  The size of the test side is checked; beyond
``broadcast_bound`` words the hashes meet in a shuffle join instead.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.lookalike import CYRILLIC, CYRILLIC_AS_LATIN, GREEK, GREEK_AS_LATIN
from orgweave.session import cut, stash

#: Fixed masks: 1 keeps a position, 0 ignores it.
MASKS = ("1111", "11011", "110101", "101011", "1100101", "1010011", "10010101")
SIEVE = 1 << 20
_FOLD = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
_TAG = re.compile(r"<[^<>]{0,200}>")
_BREAK = re.compile(r"(?<=\w)-[ \t]*\r?\n[>\s]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[\x00-\x7f]*\Z")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿︀-️]")


def words(text: str) -> list[str]:
    """Words of a text apart from layout, markup, case, accents and look-alike characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not _PLAIN.match(text):
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).translate(_FOLD)
        text = "".join(ch for ch in text if not unicodedata.combining(ch))
    if "-\n" in text or "-\r" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(text.lower())


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


@dataclass
class Item:
    eval_id: int
    tokens: np.ndarray
    own: np.ndarray


@dataclass
class TestSide:
    """Test items as token ids, their seeds per mask (sorted hashes with item and position) and their shared sentences."""

    vocabulary: dict[str, int]
    items: list[Item]
    hashes: list[np.ndarray]
    at: list[np.ndarray]
    phrases: list[np.ndarray]
    #: Per mask, which low bits of a hash occur at all: most windows of a corpus stop here.
    sieve: np.ndarray


def _seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows whose kept positions hold known tokens, and where they start."""
    keep = [i for i, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ok = np.ones(n, bool)
    h = np.zeros(n, np.int64)
    for k in keep:
        part = ids[k : k + n]
        ok &= part > 0
        h = h * 1_000_003 + part
    start = np.flatnonzero(ok)
    return h[start], start


def _split(rows: Iterable[tuple[int, str]]) -> dict[int, list[list[str]]]:
    return {eid: [w for s in sentences(text) if (w := words(s))] for eid, text in rows if eid is not None and text}


def test_side(rows: list[tuple[int, str]], shared_by: int = 3) -> TestSide:
    """Prepare the test items.

    A sentence that at least ``shared_by`` items hold in the same words is an instruction or
    a set phrase: its words are no item's own.  Items without text are skipped.
    """
    texts = _split(rows)
    spread = Counter(k for ss in texts.values() for k in {tuple(s) for s in ss})
    return _build({e: [(s, spread[tuple(s)] < shared_by) for s in ss] for e, ss in texts.items()})


def _build(texts: dict[int, list[tuple[list[str], bool]]]) -> TestSide:
    """The side of items given by their sentences in words, each with whether it is the item's own."""
    vocabulary: dict[str, int] = {}
    items = []
    for eid, ss in sorted(texts.items()):
        toks, own = [], []
        for s, mine in ss:
            toks += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in s]
            own += [mine] * len(s)
        if toks:
            items.append(Item(eid, np.array(toks, np.int64), np.array(own, bool)))
    hashes, at = [], []
    for m in MASKS:
        hs, where = [], []
        for i, it in enumerate(items):
            h, start = _seed_hashes(it.tokens, m)
            mine = np.array([it.own[p : p + len(m)].all() for p in start], bool) if len(start) else np.empty(0, bool)
            hs.append(h[mine])
            where.append(np.stack([np.full(mine.sum(), i), start[mine]], 1))
        h = np.concatenate(hs) if hs else np.empty(0, np.int64)
        w = np.concatenate(where) if where else np.empty((0, 2), np.int64)
        order = np.argsort(h, kind="stable")
        hashes.append(h[order])
        at.append(w[order])
    shared = {tuple(s) for ss in texts.values() for s, mine in ss if not mine}
    phrases = [np.array([vocabulary[w] for w in k], np.int64) for k in sorted(shared)]
    sieve = np.zeros((len(MASKS), SIEVE), bool)
    for m, h in enumerate(hashes):
        sieve[m, h & (SIEVE - 1)] = True
    return TestSide(vocabulary, items, hashes, at, phrases, sieve)


def align(doc: np.ndarray, item: Item, mismatch: float = 0.8, gap: float = 0.7) -> tuple[list[int], int]:
    """Document places of the own words matched, and span, of the item's best local alignment.

    A match of an own word scores 1, of another word 0, a substitution and a gap cost less
    than one match, so a passage survives scattered alterations.
    """
    n, m = len(doc), len(item.tokens)
    gain = np.where(item.own, 1.0, 0.0)
    best, end = 0.0, (0, 0)
    score = np.zeros((n + 1, m + 1))
    steps = np.arange(m + 1) * gap
    for i in range(1, n + 1):
        prev = score[i - 1]
        eq = item.tokens == doc[i - 1]
        diag = prev[:-1] + np.where(eq, gain, -mismatch)
        row = np.zeros(m + 1)
        row[1:] = np.maximum(np.maximum(diag, prev[1:] - gap), 0.0)
        row = np.maximum.accumulate(row + steps) - steps
        score[i] = row
        j = int(row.argmax())
        if row[j] > best:
            best, end = float(row[j]), (i, j)
    i, j = end
    matched, last = [], j
    while i > 0 and j > 0 and score[i, j] > 0:
        eq = item.tokens[j - 1] == doc[i - 1]
        if abs(score[i, j] - (score[i - 1, j - 1] + (gain[j - 1] if eq else -mismatch))) < 1e-9:
            if eq and item.own[j - 1]:
                matched.append(i - 1)
            i, j = i - 1, j - 1
        elif abs(score[i, j] - (score[i - 1, j] - gap)) < 1e-9:
            i -= 1
        else:
            j -= 1
    return matched, last - j


def doc_ids(ws: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))


def _all_hits(ids: np.ndarray, side: TestSide) -> np.ndarray:
    """Rows (document position, item index, item position, mask index) of every joined seed."""
    known = np.flatnonzero(ids)
    rows = []
    for m, (mask, hs, at) in enumerate(zip(MASKS, side.hashes, side.at)):
        keep = [i for i, c in enumerate(mask) if c == "1"]
        start = known[known + len(mask) <= len(ids)]  # every mask keeps its first position
        h = ids[start]
        for k in keep[1:]:
            part = ids[start + k]
            go = part > 0
            start, h = start[go], h[go] * 1_000_003 + part[go]
        maybe = side.sieve[m, h & (SIEVE - 1)]
        h, start = h[maybe], start[maybe]
        lo, hi = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
        n = hi - lo
        if n.sum():
            spot = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows.append(np.column_stack([np.repeat(start, n), at[spot], np.full(n.sum(), m)]))
    return np.concatenate(rows) if rows else np.empty((0, 4), np.int64)


def batch_hits(pieces: list[np.ndarray], side: TestSide) -> Iterator[tuple[int, dict[int, list[tuple[int, int, int]]]]]:
    """(document, {item index: [(document position, item position, mask index)]}) for a batch of
    documents, hashed as one run of ids with gaps between.

    One seed covers four words, which is less than :func:`claims` asks of any item of eight words or
    more, so items with a single seed in a document are left out at once.
    """
    gap = max(map(len, MASKS))
    run = np.concatenate([x for p in pieces for x in (p, np.zeros(gap, np.int64))]) if pieces else np.empty(0, np.int64)
    starts = np.cumsum([0] + [len(p) + gap for p in pieces])
    hits = _all_hits(run, side)
    if not len(hits):
        return
    doc = np.searchsorted(starts, hits[:, 0], "right") - 1
    pair = doc * len(side.items) + hits[:, 1]
    order = np.lexsort((hits[:, 3], hits[:, 2], hits[:, 0], pair))
    hits, doc, pair = hits[order], doc[order], pair[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    last = np.append(first[1:], len(pair))
    small = np.array([len(i.tokens) < 8 for i in side.items])
    per_doc: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(dict)
    for a, b in zip(first, last):
        if b - a > 1 or small[hits[a, 1]]:
            d = int(doc[a])
            per_doc[d][int(hits[a, 1])] = [(p - int(starts[d]), q, m) for p, _, q, m in hits[a:b].tolist()]
    yield from per_doc.items()


_KEPT = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]


def claims(ids: np.ndarray, hits: dict[int, list[tuple[int, int, int]]], items: list[Item], least: int, seeded: int = 6, band: int = 6) -> Iterator[tuple[int, int, int, int, int]]:
    """(item index, matched, span, first, last) of the stretches that hold a passage of an item.

    Hits of one item are clustered by document position.  Items resemble each other in their
    set phrases, so the words of a document are credited once: the cluster whose seeds cover
    most words is aligned first, claims the stretch of the document that it matches, and is
    tried again on the rest; other items must reach ``least`` own words outside of claimed
    stretches.  An item with few own words needs nearly all of them.  Clusters with fewer
    than ``seeded`` covered words are below any passage of ``least`` words.
    """
    queue: list[tuple[int, int, set[int], int, int]] = []
    for i, spots in hits.items():
        size = len(items[i].tokens)
        clusters: list[list[tuple[int, int, int]]] = []
        for s in sorted(spots):
            if not clusters or s[0] - clusters[-1][-1][0] > size:
                clusters.append([])
            clusters[-1].append(s)
        for c in clusters:
            cover = {d + k for d, _, m in c for k in _KEPT[m]}
            if len(cover) >= min(seeded, 4 + size // 8):
                queue.append((-len(cover), i, cover, min(d - p for d, p, _ in c) - band, max(d - p for d, p, _ in c) + size + band))
    queue.sort(key=lambda q: q[:2])
    free = ids.copy()
    claimed: set[int] = set()
    while queue:
        _, i, cover, a, b = queue.pop(0)
        left = cover - claimed
        if len(left) < min(seeded, 4 + len(items[i].tokens) // 8):
            continue
        if len(left) < len(cover):
            queue.append((-len(left), i, left, a, b))
            queue.sort(key=lambda q: q[:2])
            continue
        a = max(0, a)
        places, span = align(free[a:b], items[i])
        need = min(least, max(4, int(np.ceil(0.8 * items[i].own.sum()))))
        if len(places) < need:
            continue
        first, last = a + min(places), a + max(places)
        free[first : last + 1] = -1
        claimed |= set(range(first, last + 1))
        yield i, len(places), span, first, last
        queue.append((-len(cover), i, cover, a, b))
        queue.sort(key=lambda q: q[:2])


def verify(ids: np.ndarray, hits: dict[int, list[tuple[int, int, int]]], items: list[Item], least: int, alone: int = 24) -> Iterator[tuple[int, int, int]]:
    """(eval_id, matched, span) of the longest passage of each item that the document holds.

    An item whose words were credited to another is still there where ``alone`` words of it, twice
    what makes a passage, stand in the document nearly without a break: items that share
    so long a passage leak together.
    """
    best: dict[int, tuple[int, int]] = {}
    for i, matched, span, _, _ in claims(ids, hits, items, least):
        best[i] = max(best.get(i, (0, 0)), (matched, span))
    for i, spots in hits.items():
        # An unbroken run has a seed of each mask at almost every word, all at one offset.
        if i not in best and len(spots) >= alone and Counter([d - p for d, p, _ in spots]).most_common(1)[0][1] >= alone:
            a, b = min(d for d, _, _ in spots), max(d for d, _, _ in spots)
            places, span = align(ids[max(0, a - alone) : b + 2 * alone], items[i])
            if len(places) >= alone and len(places) >= 0.85 * max(span, places[0] - places[-1] + 1):
                best[i] = (len(places), span)
    for i, (matched, span) in best.items():
        yield items[i].eval_id, matched, span


def shared_sentences(evals: DataFrame, shared_by: int = 3) -> DataFrame:
    """(eval_id, sentence) for the sentences, as plain words, that several test items hold."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, " ".join(words(s))) for i, t in zip(b["eval_id"], b["text"]) for s in sentences(t)]
            yield pd.DataFrame(rows, columns=["eval_id", "sentence"])

    said = evals.select("eval_id", "text").mapInPandas(split, "eval_id bigint, sentence string").where("sentence <> ''").distinct()
    often = said.groupBy("sentence").agg(F.count("*").alias("n")).where(F.col("n") >= shared_by).select("sentence")
    return said.join(often, "sentence", "left_semi").select("eval_id", "sentence")


def items_of(evals: DataFrame) -> DataFrame:
    """(eval_id, text) of the items that have a text, repeated rows once."""
    return evals.select(F.col("eval_id").cast("bigint").alias("eval_id"), F.col("text").alias("text")).where("eval_id IS NOT NULL AND length(text) > 0").distinct()


def side_words(evals: DataFrame) -> float:
    """About how many words the items have."""
    return evals.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] / 5


def _text_seeds(tokens: list[str], own: list[bool] | None = None) -> Iterator[int]:
    """Hashes of the kept words of every window of every mask, without a vocabulary; 63 bits."""
    h = np.array([zlib.crc32(w.encode()) for w in tokens], np.int64)
    for mask in MASKS:
        n = len(h) - len(mask) + 1
        if n > 0:
            out = np.full(n, len(mask), np.int64)
            for k in (i for i, c in enumerate(mask) if c == "1"):
                out = out * np.int64(6364136223846793005) + h[k : k + n] * np.int64(1_000_003) + k
            if own is not None:
                out = out[[all(own[p : p + len(mask)]) for p in range(n)]]
            yield from out.tolist()


def side_of(met: Sequence[dict]) -> TestSide:
    """The side of the items that a document carries."""
    return _build({m["eval_id"]: [(s.split(" "), bool(o)) for s, o in zip(m["sents"], m["own"])] for m in met})


def with_met_items(docs: DataFrame, evals: DataFrame, shared_by: int = 3) -> DataFrame:
    """``docs`` (doc_id, text) with ``met``: the items, as an array, that a document shares a seed with.

    For test sides too large to hold.  Item seeds and document seeds meet in a shuffle join; a
    bitmap of fixed size, 2**27 bits, built from the item seeds, keeps windows that no item has
    from ever being shuffled.  An item that reaches six covered words has two seeds there, unless it is short.
    """
    spark = docs.sparkSession
    said = shared_sentences(evals, shared_by).withColumn("own", F.lit(False)).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(e, p, " ".join(s)) for e, t in zip(b["eval_id"], b["text"]) for p, s in enumerate(_split([(e, t)])[e])]
            yield pd.DataFrame(rows, columns=["eval_id", "pos", "sentence"])

    parts = evals.mapInPandas(split, "eval_id bigint, pos int, sentence string").join(said, ["eval_id", "sentence"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence", F.coalesce("own", F.lit(True)).alias("own"))))
    items = cut(parts.groupBy("eval_id").agg(ordered.alias("s")).select("eval_id", F.col("s.sentence").alias("sents"), F.col("s.own").alias("own")))

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, sents, own in zip(b["eval_id"], b["sents"], b["own"]):
                toks = [s.split(" ") for s in sents]
                flat, mine = [w for s in toks for w in s], [o for s, o in zip(toks, own) for _ in s]
                rows += [(h, e, len(flat)) for h in set(_text_seeds(flat, mine))]
            yield pd.DataFrame(rows, columns=["h", "eval_id", "size"])

    seeds = stash(items.mapInPandas(of_items, "h bigint, eval_id bigint, size int"))
    low = F.pmod("h", F.lit(1 << 27))
    bits = seeds.groupBy(F.bitmap_bucket_number(low).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("m"))
    sieve = np.zeros((4_098, 4_096), np.uint8)
    for r in bits.collect():
        sieve[r.b] = np.frombuffer(r.m, np.uint8)
    held = spark.sparkContext.broadcast(sieve)

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = held.value.reshape(-1)
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                h = np.array(sorted(set(_text_seeds(words(t)))), np.int64)
                # Bucket numbers count from 1 and bits from 0, as Spark's functions do.
                at = np.mod(h, 1 << 27)
                bucket, bit = (at - 1) // 32_768 + 1, np.mod(at - 1, 32_768)
                bucket[at == 0], bit[at == 0] = 0, 0
                hit = (bitmap[bucket * 4_096 + bit // 8] >> (bit % 8)) & 1
                rows.append((d, t, h[hit == 1].tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "seeds"])

    marked = stash(docs.select("doc_id", "text").mapInPandas(of_docs, "doc_id bigint, text string, seeds array<bigint>").withColumn("key", F.xxhash64("doc_id", "text")))
    pairs = marked.select("key", F.explode("seeds").alias("h")).distinct().join(seeds, "h").groupBy("key", "eval_id").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    pairs = pairs.where("n > 1 OR size < 16").join(items, "eval_id").groupBy("key").agg(F.collect_list(F.struct("eval_id", "sents", "own")).alias("met"))
    hit = marked.where("size(seeds) > 0").select("doc_id", "text", "key").join(pairs, "key").select("doc_id", "text", "met")
    none = F.array().cast(pairs.schema["met"].dataType)
    rest = marked.select("doc_id", "text", "key").join(pairs.select("key"), "key", "left_anti").select("doc_id", "text", none.alias("met"))
    return hit.unionByName(rest)


def find_leaks(documents: DataFrame, evals: DataFrame, least: int = 10, broadcast_bound: int = 2_000_000) -> DataFrame:
    """(doc_id, eval_id, matched, span): every document that holds a passage of a test item.

    ``documents`` (doc_id, text), ``evals`` (eval_id, text); extra columns are ignored,
    NULL or empty texts match nothing, repeated rows count once, a text of any length is
    searched whole.  Nothing but hits leaves the workers while the items have at most
    ``broadcast_bound`` words; a larger test side meets the corpus in a join of the hashes, and each
    document is then aligned with all its items at once, so the result is the same.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    ev = items_of(evals)
    if side_words(ev) <= broadcast_bound:
        side = test_side([(r.eval_id, r.text) for r in ev.collect()])
        held = docs.sparkSession.sparkContext.broadcast(side)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = held.value
            for batch in batches:
                pieces = [doc_ids(words(t), s.vocabulary) for t in batch["text"]]
                out = []
                for k, hits in batch_hits(pieces, s):
                    out += [(batch["doc_id"].iat[k], *x) for x in verify(pieces[k], hits, s.items, least)]
                yield pd.DataFrame(out, columns=["doc_id", "eval_id", "matched", "span"])

        found = docs.mapInPandas(search, "doc_id bigint, eval_id bigint, matched bigint, span bigint")
    else:

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for d, t, met in zip(batch["doc_id"], batch["text"], batch["met"]):
                    s = side_of(met)
                    ids = doc_ids(words(t), s.vocabulary)
                    out += [(d, *x) for _, hits in batch_hits([ids], s) for x in verify(ids, hits, s.items, least)]
                yield pd.DataFrame(out, columns=["doc_id", "eval_id", "matched", "span"])

        found = with_met_items(docs, ev).where("size(met) > 0").mapInPandas(check, "doc_id bigint, eval_id bigint, matched bigint, span bigint")
    return found.groupBy("doc_id", "eval_id").agg(F.max("matched").alias("matched"), F.max("span").alias("span"))
