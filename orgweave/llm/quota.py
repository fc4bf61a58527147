"""Sample matching target category proportions, as a min-cost flow on cell counts.

Counts of usable rows per cross-classified cell come from one aggregation.  The network has
a node per stratum and per sub-stratum and an arc per cell: arcs carry margins, floors and availability, and slack
arcs take what the rows cannot give.  Their flow is the shortfall.  The integer
quotas of the optimal flow are then drawn at random from the rows, by hash order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category(c: Column) -> Column:
    """Category text apart from case, outer blanks and the word separator."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "_")


@dataclass
class Network:
    """Min-cost flow by successive shortest paths with potentials; integer capacities, costs of 0 or more."""

    head: list[int] = field(default_factory=list)
    cap: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))

    def arc(self, u: int, v: int, cap: int, cost: int) -> int:
        k = len(self.head)
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.head))
            self.head.append(b)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def flow(self, k: int) -> int:
        return self.cap[k ^ 1]

    def solve(self, s: int, t: int) -> int:
        """Send as much as possible from s to t at least cost; returns what was sent."""
        sent, level = 0, defaultdict(int)
        while True:
            dist, via, done, heap = {s: 0}, {}, set(), [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                if u == t:
                    break
                for k in self.out[u]:
                    v = self.head[k]
                    if self.cap[k] > 0 and v not in done:
                        far = d + self.cost[k] + level[u] - level[v]
                        if far < dist.get(v, 1 << 62):
                            dist[v], via[v] = far, k
                            heapq.heappush(heap, (far, v))
            if t not in done:
                return sent
            for v in done:
                level[v] += dist[v] - dist[t]
            push, v = 1 << 62, t
            while v != s:
                push = min(push, self.cap[via[v]])
                v = self.head[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= push
                self.cap[via[v] ^ 1] += push
                v = self.head[via[v] ^ 1]
            sent += push


@dataclass(frozen=True)
class Cell:
    stratum: str
    sub: str
    target: int
    floor: int
    share: float
    written: tuple[str, str] = ("", "")


#: What a unit of slack costs: a row short of a floor, of a target; and a row drawn beyond a margin.
FLOOR, TARGET, BEYOND = 10**6, 10**4, 10**2


def _scaled(cells: Sequence[Cell], total: int | None) -> list[int]:
    """Targets as rows; with ``total`` in proportion to the shares, largest remainders first, floors kept."""
    if total is None:
        return [max(c.target, 0) for c in cells]
    mass = sum(c.share for c in cells) or 1.0
    raw = [c.share / mass * total for c in cells]
    want = [max(c.floor, int(r)) for c, r in zip(cells, raw)]
    for i in sorted(range(len(cells)), key=lambda i: int(raw[i]) - raw[i])[: max(0, total - sum(want))]:
        want[i] += 1
    return want


def cell_quotas(cells: Sequence[Cell], available: dict[tuple[str, str], int], total: int | None = None, beyond: int = BEYOND) -> list[dict]:
    """Quota and shortfall of each cell of the design, from one flow on the cross-classified counts.

    A circulation runs from a source through a node per stratum, an arc per (stratum,
    sub-stratum) and a node per sub-stratum back to the source.  The arc in the middle carries what is
    available; a cell asks for its target there, a whole stratum (blank sub) on the arc into
    its node, a whole sub-stratum (blank stratum) on the arc out of its node: the margins.  What
    is asked for is a lower bound, and an arc of slack beside it, dear for the floor and less so
    for the rest of the target, takes what cannot be given.  Rows beyond a margin cost ``beyond`` each, so a
    margin gives way only where a cell or a floor needs it.  Rows are in one cell each, so none is drawn twice.
    """
    want = _scaled(cells, total)
    listed = {(c.stratum, c.sub) for c in cells}
    strata = {c.stratum for c in cells if c.stratum}
    subs = {c.sub for c in cells if not c.stratum}
    supply: dict[tuple[str, str], int] = defaultdict(int)
    for (st, sub), n in sorted(available.items()):
        if st in strata or sub in subs:
            supply[st, sub if (st, sub) in listed or sub in subs else ""] += n
    for c in cells:
        if c.stratum:
            supply[c.stratum, c.sub] += 0
    # Strata hang together by margins of sub-strata only; each part is solved alone.
    part = {st: "" if any(u in subs for (s, u) in supply if s == st) else st for st in {s for s, _ in supply}}
    out: dict[int, dict] = {}
    for name in sorted(set(part.values())):
        mine = [i for i, c in enumerate(cells) if (part.get(c.stratum) == name if c.stratum else name == "")]
        own = {k: n for k, n in supply.items() if part[k[0]] == name}
        for i, draws, short in _solve([cells[i] for i in mine], [want[i] for i in mine], own, beyond):
            c = cells[mine[i]]
            out[mine[i]] = {"stratum": c.stratum, "sub_stratum": c.sub, "written": c.written, "target": want[mine[i]], "floor": c.floor, "draws": draws, "shortfall": short}
    for i, c in enumerate(cells):
        out.setdefault(i, {"stratum": c.stratum, "sub_stratum": c.sub, "written": c.written, "target": want[i], "floor": c.floor, "draws": {}, "shortfall": want[i]})
    return [out[i] for i in range(len(cells))]


def _solve(cells: Sequence[Cell], want: Sequence[int], supply: dict[tuple[str, str], int], beyond: int) -> list[tuple[int, dict[tuple[str, str], int], int]]:
    """(cell, rows drawn by unit, shortfall) of one connected part of the network."""
    net, ids = Network(), iter(range(3, 1 << 30))
    start, demand, source = 0, 1, 2
    wide = sum(supply.values()) + sum(want) + 1
    shorts: dict[int, list[int]] = defaultdict(list)
    asked: dict[tuple[str, str], int] = {(c.stratum, c.sub): i for i, c in enumerate(cells)}
    owed: dict[int, int] = defaultdict(int)

    def ask(u: int, v: int, i: int | None, most: int, over: int) -> list[int]:
        """Arcs u -> v: the rows asked for as lower bounds with slack back, the rest at a cost."""
        lo = min(cells[i].floor, want[i]) if i is not None else 0
        hi = want[i] if i is not None else 0
        for n, dear in ((lo, FLOOR), (hi - lo, TARGET)):
            if n > 0:
                owed[v] += n
                owed[u] -= n
                shorts[i].append(net.arc(v, u, n, dear))
        return [net.arc(u, v, most, over)]

    rows = {st: (next(ids), next(ids)) for st in sorted({s for s, _ in supply})}
    columns = {sub: next(ids) for sub in sorted({u for _, u in supply})}
    for st, (a, b) in rows.items():
        i = asked.get((st, ""))
        net.arc(source, a, wide, 0)
        ask(a, b, i, wide, beyond if i is not None else 0)
    spare = {}
    for (st, sub), n in sorted(supply.items()):
        i = asked.get((st, sub)) if sub else None
        gate = next(ids)
        spare[st, sub] = net.arc(rows[st][1], gate, n, 0)
        ask(gate, columns[sub], i, n, beyond if i is not None else 0)
    for sub, v in columns.items():
        i = asked.get(("", sub)) if sub else None
        ask(v, source, i, wide, beyond if i is not None else 0)
    for v, n in owed.items():
        if n:
            net.arc(start, v, n, 0) if n > 0 else net.arc(v, demand, -n, 0)
    net.solve(start, demand)
    drawn = {k: net.flow(a) for k, a in spare.items() if net.flow(a)}
    out = []
    for i, c in sorted(enumerate(cells), key=lambda x: (x[1].sub == "", x[1].stratum == "")):
        # A cell reports the rows it asked for; what a margin draws besides stands with the margin.
        left = want[i] if c.sub and c.stratum and ((c.stratum, "") in asked or ("", c.sub) in asked) else wide
        mine = {}
        for k in sorted(drawn):
            if drawn[k] and left and (not c.stratum or k[0] == c.stratum) and (not c.sub or k[1] == c.sub):
                mine[k] = min(left, drawn[k])
                drawn[k] -= mine[k]
                left -= mine[k]
        out.append((i, mine, sum(net.flow(k) for k in shorts[i])))
    return out


def usable_rows(items: DataFrame) -> DataFrame:
    """(item_id, stratum, sub_stratum): rows that may be drawn, categories in one form.

    Demo rows, rows without item or stratum drop out; NULL demo counts as no demo; NULL
    sub-stratum becomes ''.  An item stated under several category pairs has a row for each.
    """
    rows = items.where("item_id IS NOT NULL AND NOT coalesce(demo, false)").select(
        "item_id", category(F.col("stratum")).alias("stratum"), F.coalesce(category(F.col("sub_stratum")), F.lit("")).alias("sub_stratum")
    )
    return rows.where("stratum IS NOT NULL").distinct()


def one_pair(rows: DataFrame) -> DataFrame:
    """The least category pair of each item, so that none can be drawn twice."""
    return rows.groupBy("item_id").agg(F.min(F.struct("stratum", "sub_stratum")).alias("p")).select("item_id", "p.stratum", "p.sub_stratum")


def target_cells(targets: DataFrame, bound: int = 100_000) -> list[Cell]:
    """The configured cells; a design table, whose size is checked before it is read."""
    rows = targets.select(category(F.col("stratum")).alias("st"), F.coalesce(category(F.col("sub_stratum")), F.lit("")).alias("sub"), "target_rows", "min_rows", "target_share", "stratum", "sub_stratum").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} cells")
    kept = {Cell(r.st or "", r.sub, int(r.target_rows or 0), int(r.min_rows or 0), float(r.target_share or 0), (r.stratum or "", r.sub_stratum or "")) for r in rows if r.st or r.sub}
    return sorted({(c.stratum, c.sub): c for c in sorted(kept, key=str)}.values(), key=lambda c: (c.stratum, c.sub))


def units(rows: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """(item_id, stratum, sub_stratum) of the rows that some cell covers; a sub-stratum that no cell names is blank."""
    strata = sorted({c.stratum for c in cells if c.stratum})
    columns = sorted({c.sub for c in cells if not c.stratum})
    listed = sorted({f"{c.stratum}\u001f{c.sub}" for c in cells if c.sub})
    named = F.concat_ws("\u001f", "stratum", "sub_stratum").isin(listed) | F.col("sub_stratum").isin(columns)
    covered = F.col("stratum").isin(strata) | F.col("sub_stratum").isin(columns)
    return rows.where(covered).select("item_id", "stratum", F.when(named, F.col("sub_stratum")).otherwise(F.lit("")).alias("sub_stratum"))


def cell_counts(unit_rows: DataFrame) -> dict[tuple[str, str], int]:
    """Distinct items per unit; as many rows come to the driver as the design has units."""
    counted = unit_rows.distinct().groupBy("stratum", "sub_stratum").agg(F.count("*").alias("n"))
    return {(r.stratum, r.sub_stratum): r.n for r in counted.collect()}


def shortfalls(items: DataFrame, targets: DataFrame) -> list[dict]:
    """Per configured cell, what its target asks beyond the usable items: the flow on its slack arcs.

    Rows beyond a margin are free here, so every cell is judged by what there is and none gives
    way to another.
    """
    cells = target_cells(targets)
    quotas = cell_quotas(cells, cell_counts(units(usable_rows(items), cells)), beyond=0)
    return [q for q in quotas if q["shortfall"] > 0]


def draw(rows: DataFrame, quotas: Sequence[tuple[str, str, int]], seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Exactly ``quota`` rows of each unit, in the order of a seeded hash of the item.

    A histogram of hash buckets per unit (at most units x buckets rows) shows the bucket in
    which each quota ends; rows before it are in, and only the rows of that one bucket are
    ranked.  No unit is ever sorted as a whole, so one that holds a third of all rows costs
    no more than the others.  Ties of the hash fall to the smaller item.
    """
    spark = rows.sparkSession
    q = F.broadcast(spark.createDataFrame([(s, u, n) for s, u, n in quotas if n > 0], "stratum string, sub_stratum string, quota bigint"))
    h = F.xxhash64(F.lit(seed), "item_id")
    hashed = rows.distinct().join(q, ["stratum", "sub_stratum"]).withColumn("h", h).withColumn("b", F.pmod("h", F.lit(buckets)))
    per_bucket = hashed.groupBy("stratum", "sub_stratum", "quota", "b").agg(F.count("*").alias("n"))
    run = Window.partitionBy("stratum", "sub_stratum").orderBy("b")
    cum = per_bucket.withColumn("upto", F.sum("n").over(run)).select("stratum", "sub_stratum", "b", (F.col("upto") - F.col("n")).alias("before"), "upto")
    cum = cum.join(q, ["stratum", "sub_stratum"]).where("before < quota").select("stratum", "sub_stratum", "b", "before", "upto")
    placed = hashed.join(F.broadcast(cum), ["stratum", "sub_stratum", "b"])
    inside = placed.where("upto <= quota")
    edge = placed.where("upto > quota").withColumn("r", F.row_number().over(Window.partitionBy("stratum", "sub_stratum").orderBy("h", "item_id")))
    return inside.select("item_id", "stratum", "sub_stratum").unionByName(edge.where("before + r <= quota").select("item_id", "stratum", "sub_stratum"))


def quota_sample(items: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """The sample and the report of its cells.  Empty tables give an empty sample."""
    cells = target_cells(targets)
    kept = units(one_pair(usable_rows(items)), cells)
    report = cell_quotas(cells, cell_counts(kept), total)
    per_unit: dict[tuple[str, str], int] = defaultdict(int)
    for r in report:
        for unit, n in r["draws"].items():
            per_unit[unit] += n
    return draw(kept, [(s, u, n) for (s, u), n in per_unit.items()], seed), report
