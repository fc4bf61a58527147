"""Reading level of each document by regularised ordinal regression.

Features: lexical diversity, word rarity against the corpus, connectives, a proxy of clause
depth, lengths of words and sentences, each as the document's mean and as quartiles over its
sentences.  A proportional-odds model with a ridge penalty is calibrated to graded texts.

Only a document's own running prose counts: headings, list items, table rows and stretches
that repeat given foreign passages are left out, and documents whose own text is not English
or is mostly such lines get no level.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm import leakage

# Closed word classes of English.
FUNCTION_WORDS = frozenset(
    "a about after all also although an and any are as at be because been before but by can could did do does each every few for from had has have he her his how i if in into is it its "
    "may might more most must no nor not of off on one only or other our out over own shall she should since so some such than that the their them then there these they this those though "
    "through to too under until up upon us was we were what when where whereby which while who whom whose why will with within without would yet you your".split()
)
CONNECTIVES = frozenset(
    "although albeit because before after whereas whereby whenever while since though unless until notwithstanding despite provided insofar inasmuch however therefore moreover furthermore "
    "nevertheless consequently concomitantly thus hence if so and but or yet".split()
)
SUBORDINATORS = frozenset("although albeit because whereas whereby whenever while since though unless until notwithstanding insofar inasmuch which whose whom that who when where if".split())
ABBREVIATIONS = frozenset("cf inst dept vol no bldg etc st dr prof eg ie e.g i.e univ fig sec ed eds vs approx".split())

# Frequent words of other languages that English does not share, and English endings.
FOREIGN_WORDS = frozenset(
    "el la los las del una y e en por para con que se su tras antes varias dos le les des du un une et est dans avant après deux plusieurs sur au aux der die das den dem des ein eine und ist im "
    "von vor nach zwei mehrere sich bitte wurde il lo gli della di che per non o os da do em não uma het een van met voor".split()
)
ENDINGS = ("tion", "tions", "ity", "ities", "ence", "ance", "ism", "ising", "ises", "ation", "ates", "ing", "ed", "ical", "ary", "ous", "able", "ible", "ment", "ology", "ography", "ency", "ancy", "ates")
_TABLE = re.compile(r"^\s*(?:#{1,6}\s|\d{1,4}\s*[|]|\|)|\s\|\s.*\s\|\s")
_BULLET = re.compile(r"^\s*(?:>\s*)*(?:[-*•·+]\s+|\d{1,3}[.)]\s+)?")
_END = re.compile(r"(?<=[.!?])[\"”’)\]]*\s+(?=[\"“(\[]?[A-Z0-9])")
_LAST = re.compile(r"([A-Za-z.]+)\.[\"”’)\]]*$")
_ALPHA = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_VOWELS = re.compile(r"[aeiouy]+")


def prose_sentences(text: str) -> list[str]:
    """Sentences of one line; a stop after an abbreviation or a single letter ends none."""
    out: list[str] = []
    for piece in _END.split(text):
        last = _LAST.search(out[-1]) if out else None
        if last and (last.group(1).lower() in ABBREVIATIONS or len(last.group(1)) == 1):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return [s for s in out if s.strip()]


def text_units(text: str) -> list[tuple[str, bool]]:
    """(unit, is it a table row or heading): sentences of prose lines, other lines whole.

    A bullet that holds a sentence is prose in markup; one that holds a bare name is a list row.
    """
    units: list[tuple[str, bool]] = []
    for line in leakage._TAG.sub(" ", text).splitlines():
        if line.strip():
            body = _BULLET.sub("", line)
            bare = body != line and not re.search(r"[.!?;:]", body) and len(body.split()) < 6
            if _TABLE.search(line) or bare:
                units.append((body, True))
            else:
                units += [(s, False) for s in prose_sentences(body)]
    return units


def shared_spots(ids: np.ndarray, foreign: leakage.TestSide) -> Iterator[tuple[int, int]]:
    """(place, length) of the shared sentences of the foreign side that open alike and mostly agree."""
    for phrase in foreign.phrases:
        n = len(phrase)
        for k in np.flatnonzero(ids[: max(0, len(ids) - n + 1)] == phrase[0]):
            if (ids[k : k + n] == phrase).mean() > 0.8:
                yield int(k), n


def own_units(units: list[tuple[str, bool]], parts: list[list[str]], ids: np.ndarray, hits: dict, foreign: leakage.TestSide, least: int = 10) -> list[tuple[str, bool]]:
    """The units that do not mostly repeat passages or shared sentences of the foreign side."""
    taken = np.zeros(len(ids), bool)
    for _, _, _, first, last in leakage.claims(ids, hits, foreign.items, least):
        taken[first : last + 1] = True
    for k, n in shared_spots(ids, foreign):
        taken[k : k + n] = True
    ends = np.cumsum([len(p) for p in parts])
    return [u for u, e, p in zip(units, ends, parts) if not p or taken[e - len(p) : e].mean() < 0.5]


def own_batch(texts: list[str], foreign: list[leakage.TestSide | None]) -> list[list[tuple[str, bool]]]:
    """Own units of each text; seeds of texts with one foreign side are looked up in one run.

    Only texts in which seeds or a shared sentence turn up are taken apart sentence by sentence.
    """
    units = [text_units(t) for t in texts]
    sides: dict[int, list[int]] = {}
    for k, f in enumerate(foreign):
        if f is not None:
            sides.setdefault(id(f), []).append(k)
    for ks in sides.values():
        side = foreign[ks[0]]
        ids = [leakage.doc_ids(leakage.words(texts[k]), side.vocabulary) for k in ks]
        met = {i for i, _ in leakage.batch_hits(ids, side)}
        met |= {i for i, x in enumerate(ids) if next(shared_spots(x, side), None)}
        some = sorted(met)
        parts = [[leakage.words(s) for s, _ in units[ks[i]]] for i in some]
        ids = [leakage.doc_ids([w for p in ps for w in p], side.vocabulary) for ps in parts]
        found = dict(leakage.batch_hits(ids, side))
        for j, i in enumerate(some):
            units[ks[i]] = own_units(units[ks[i]], parts[j], ids[j], found.get(j, {}), side)
    return units


def is_english_prose(units: list[tuple[str, bool]], least_words: int = 8) -> bool:
    """Running English prose: Latin letters, English words or endings, more prose than rows."""
    words, letters, rows = [], 0, 0
    for s, listed in units:
        found = _ALPHA.findall(s.lower())
        if listed:
            rows += len(found)
        else:
            words += found
            letters += sum(map(len, found)) if s.isascii() else sum(map(str.isalpha, s))
    if len(words) < least_words or len(words) <= rows or sum(map(len, words)) < 0.8 * letters:
        return False
    n = len(words)
    english = foreign = endings = 0
    for w, k in Counter(words).items():
        english += k * (w in FUNCTION_WORDS)
        foreign += k * (w in FOREIGN_WORDS)
        endings += k * (len(w) > 6 and w.endswith(ENDINGS))
    return foreign < english + 0.5 * endings and (english >= 0.2 * n or english + endings >= 0.3 * n)


def sentence_words(s: str) -> list[str]:
    """Words of a sentence in lower case; names in mid-sentence capitals do not count as words."""
    toks = _ALPHA.findall(s)
    if not toks:
        return []
    head = toks[0]
    if len(head) > 1 and not head[1:].islower():
        return [w.lower() for w in toks]
    return [head.lower(), *(w.lower() for w in toks[1:] if not w[0].isupper())]


FEATURES = 42


def features(documents: list[list[str]], rarity: Callable[[str], float]) -> np.ndarray:
    """One feature row per document, given its sentences; all words of the batch are summed up at once."""
    places: dict[str, int] = {}
    ids: list[int] = []
    size: list[int] = []
    marks: list[int] = []
    of: list[int] = []
    for d, sentences in enumerate(documents):
        for s in sentences:
            words = sentence_words(s)
            if words:
                ids += [places.setdefault(w, len(places)) for w in words]
                size.append(len(words))
                marks.append(s.count(",") + s.count(";"))
                of.append(d)
    out = np.zeros((len(documents), FEATURES))
    if not ids:
        return out
    about = np.array([(rarity(w), len(w), max(1, len(_VOWELS.findall(w))), len(w) >= 9, len(w) >= 13, w in CONNECTIVES, w in SUBORDINATORS, w not in FUNCTION_WORDS) for w in places])
    word, n, start = about[ids], np.array(size), np.concatenate([[0], np.cumsum(size)[:-1]])
    content = word[:, 7] > 0
    none = np.add.reduceat(content, start, dtype=np.int64) == 0
    content |= np.repeat(none, n)
    k = np.add.reduceat(content, start, dtype=np.int64)
    means = np.add.reduceat(word[:, :5] * content[:, None], start) / k[:, None]
    longest = np.maximum.reduceat(word[:, 1] * content, start)
    joins = np.add.reduceat(word[:, 5], start) / n
    clauses = (np.array(marks) + np.add.reduceat(word[:, 6], start)) / np.sqrt(n)
    rows = np.column_stack([means, np.log(n), joins, clauses, longest])
    of_doc = np.array(of)
    first = np.flatnonzero(np.concatenate([[True], of_doc[1:] != of_doc[:-1]]))
    ends = np.append(first[1:], len(of_doc))
    upto = np.append(start, len(ids))
    for a, b in zip(first, ends):
        x = rows[a:b]
        mean = (x * n[a:b, None]).sum(0) / n[a:b].sum()
        total, distinct = int(n[a:b].sum()), len(set(ids[upto[a] : upto[b]]))
        quart = np.sort(x, axis=0)[[int(q * (len(x) - 1) + 0.5) for q in (0.2, 0.5, 0.8)]].T.ravel()
        out[of_doc[a]] = [*mean, *x[:, :3].std(0), distinct / math.sqrt(total), math.log(distinct) / math.log(total + 1), math.log(total), *quart]
    return out


@dataclass
class OrdinalModel:
    """Proportional odds: P(level <= k) = logistic(cut_k - w.x) on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.scale) @ self.weight

    def level(self, x: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-(self.cuts[None, :] - self.latent(x)[:, None])))
        p = np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], 1), axis=1)
        return p.argmax(1) + 1


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -4, 4)
    return np.concatenate([z, z**2 - 1], 1)


def fit(x: np.ndarray, y: np.ndarray, levels: int = 5, ridge: float = 3e-3, rounds: int = 1500, rate: float = 0.03) -> OrdinalModel:
    """Ridge-penalised maximum likelihood by full-batch gradient steps with adaptive scaling."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = _expand((x - mean) / scale)
    n, d = z.shape
    share = np.clip(np.cumsum(np.bincount(y, minlength=levels + 1)[1:])[:-1] / n, 1e-3, 1 - 1e-3)
    cuts0 = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(d), [cuts0[0]], np.log(np.maximum(np.diff(cuts0), 1e-2))])
    m = np.zeros_like(theta)
    v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, raw = theta[:d], theta[d:]
        gaps = np.exp(raw[1:])
        cuts = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = z @ w
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi = 1 / (1 + np.exp(-np.clip(edges[y] - eta, -40, 40)))
        lo = 1 / (1 + np.exp(-np.clip(edges[y - 1] - eta, -40, 40)))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gw = z.T @ (dhi - dlo) / n + ridge * w
        gc = np.zeros(levels - 1)
        for k in range(levels - 1):
            gc[k] = (-(dhi * (y == k + 1)).sum() + (dlo * (y == k + 2)).sum()) / n
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * gaps])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = theta[d:]
    return OrdinalModel(mean, scale, theta[:d], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]))


class Rarity:
    """-log share of every word, from counts in two tables of fixed size.

    A word's count is the lesser of two cells, chosen by different bits of one checksum, so no
    word is left out however many there are; words that share both cells share their sum.
    """

    def __init__(self, tables: np.ndarray) -> None:
        self.tables, self.bits = tables, int(tables.shape[1]).bit_length() - 1
        self.total = max(1, int(tables[0].sum()))

    def __call__(self, w: str) -> float:
        c = zlib.crc32(w.encode())
        n = min(self.tables[0, c & ((1 << self.bits) - 1)], self.tables[1, c >> (32 - self.bits)])
        return min(12.0, math.log(self.total / n)) if n else 12.0


def word_rarity(docs: DataFrame, bits: int = 18) -> Rarity:
    """Counts of all words of all documents, combined map-side; 2 * 2**bits sums come to the driver."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''")
    counts = words.groupBy(F.crc32("w").alias("c")).agg(F.count("*").alias("n"))
    cells = F.array(F.col("c").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("c", 32 - bits) + (1 << bits))
    tables = np.zeros(2 << bits, np.int64)
    for r in counts.select("n", F.explode(cells).alias("cell")).groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        tables[r.cell] = r.n
    return Rarity(tables.reshape(2, -1))


def _featured(docs: DataFrame, held) -> DataFrame:  # noqa: ANN001
    """Features, or levels, of ``docs`` (doc_id, text, met); met: test items of a side too large to hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity, foreign, model = held.value
        for batch in batches:
            sides = [foreign if m is None else leakage.side_of(m) for m in batch["met"]] if "met" in batch else [foreign] * len(batch)
            own = own_batch(list(batch["text"]), sides)
            kept = [k for k, units in enumerate(own) if is_english_prose(units)]
            x = features([[s for s, listed in own[k] if not listed] for k in kept], rarity)
            out = {"doc_id": batch["doc_id"].to_numpy()[kept]}
            if model is None:
                out["x"] = list(x)
            else:
                out["reading_level"] = model.level(x).astype(np.int64)
                out["score"] = model.latent(x)
            yield pd.DataFrame(out)

    schema = "doc_id bigint, x array<double>" if held.value[2] is None else "doc_id bigint, reading_level bigint, score double"
    return docs.mapInPandas(run, schema)


def reading_levels(documents: DataFrame, labels: DataFrame, foreign_texts: DataFrame | None = None, max_labels: int = 20_000, broadcast_bound: int = 2_000_000) -> DataFrame:
    """(doc_id, reading_level, score) for every document of running English prose.

    The model is fitted on at most ``max_labels`` graded texts, chosen by a hash of the
    document where there are more; everything else covers all documents, whole texts.
    NULL, empty and placeholder texts, lists and other languages give no row; doc_id is the key,
    a document stated again in the same words has one row, with another text one of its own; without usable
    labels nothing is calibrated and the result is empty.
    ``foreign_texts`` (eval_id, text): passages that are not a document's own.  They are held whole
    up to ``broadcast_bound`` words; beyond, each document carries the items it has a seed of.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rarity = word_rarity(docs)
    side = None
    if foreign_texts is not None:
        ev = leakage.items_of(foreign_texts)
        if leakage.side_words(ev) <= broadcast_bound:
            side = leakage.test_side([(r.eval_id, r.text) for r in ev.collect()])
        else:
            docs = leakage.with_met_items(docs, ev)
    graded = labels.where("doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 5").select(F.col("doc_id").cast("bigint").alias("doc_id"), "grader", F.col("reading_level").cast("int").alias("y")).distinct()
    rows = graded.orderBy(F.xxhash64("doc_id"), "grader").limit(max_labels).collect()
    empty = spark.createDataFrame([], "doc_id bigint, reading_level bigint, score double")
    if not rows:
        return empty
    held = spark.sparkContext.broadcast((rarity, side, None))
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in sorted({r.doc_id for r in rows})], "doc_id bigint"))
    xs = {r.doc_id: np.array(r.x) for r in _featured(docs.join(chosen, "doc_id", "left_semi"), held).collect()}
    pairs = [(xs[r.doc_id], r.y) for r in rows if r.doc_id in xs]
    if len({y for _, y in pairs}) < 2:
        return empty
    model = fit(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]))
    # Rows are made distinct after the text is gone: no text is ever shuffled.
    return _featured(docs, spark.sparkContext.broadcast((rarity, side, model))).distinct()
