"""Queries of the general problems: nested records (p1), hierarchies (p2), packed fields (p7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.ids import bare_id
from orgweave.operators import hierarchy, nested, packed
from orgweave.plans import oracle
from orgweave.session import table

_ORG = "items[].organization"
#: Leaves of an organisation that the flat tables carry, and how each is called.
LEAVES = {"name": f"{_ORG}.names[].value", "external_id": f"{_ORG}.external_ids[].all[]", "geonames_id": f"{_ORG}.locations[].geonames_id"}
_LISTS = ("items", f"{_ORG}.names", f"{_ORG}.names[].types", f"{_ORG}.external_ids", f"{_ORG}.external_ids[].all", f"{_ORG}.locations", f"{_ORG}.types", f"{_ORG}.domains", f"{_ORG}.links", f"{_ORG}.relationships")
#: Leaves of the full set of flat tables.
TABLE_LEAVES = (
    f"{_ORG}.id", f"{_ORG}.status", f"{_ORG}.established", "items[].substring", "items[].score", "items[].chosen",
    f"{_ORG}.names[].value", f"{_ORG}.names[].lang", f"{_ORG}.names[].types[]",
    f"{_ORG}.external_ids[].type", f"{_ORG}.external_ids[].preferred", f"{_ORG}.external_ids[].all[]",
    f"{_ORG}.locations[].geonames_id", f"{_ORG}.locations[].geonames_details.country_code",
    f"{_ORG}.relationships[].type", f"{_ORG}.relationships[].id",
)


def response_triples(spark: SparkSession, d: str, keep: tuple[str, ...]) -> DataFrame:
    """Triples of the typed and of the raw responses in one form."""
    typed = nested.triples_from_struct(table(spark, d, "matcher_response"), "response_id", "items", root="items", keep=keep)
    raw = nested.triples_from_json(table(spark, d, "raw_response"), "response_id", "payload", lists=_LISTS, embedded=(_ORG, "items", "items[]"), envelopes=("response", "data", "result"), keep=keep)
    return typed.unionByName(raw)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null leaf value with the place of its item, its list and its inner list.

    Members of a text that wraps several responses may state a leaf alike, hence the distinct.
    """
    wide = nested.pivot_groups(response_triples(spark, d, tuple(LEAVES.values())), tuple(LEAVES.values()))
    group = {k: next(iter(nested.groups_of([p]))) for k, p in LEAVES.items()}
    kind = F.coalesce(*[F.when(F.col("ancestor") == a, F.lit(k)) for k, a in group.items()])
    leaf = F.coalesce(*[F.col(nested.leaf_name(p)) for p in LEAVES.values()])
    at = lambda i: F.coalesce(F.try_element_at("ordinals", F.lit(i)), F.lit(0)).cast("bigint")
    return wide.select(F.col("record_id").alias("response_id"), at(1).alias("item_pos"), kind.alias("kind"), at(2).alias("outer_pos"), at(3).alias("inner_pos"), leaf.alias("leaf")).distinct()


def _p1_table(ancestor: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        paths = nested.groups_of(TABLE_LEAVES)[ancestor]
        triples = response_triples(spark, d, tuple(paths))
        return nested.pivot_group(triples, ancestor, paths).withColumnRenamed("record_id", "response_id")

    return query


def stated_links(spark: SparkSession, d: str) -> DataFrame:
    """(link_kind, child, up) from all three places that state links, whichever end states them."""
    rel = table(spark, d, "org_relationship").select(F.col("org_id").alias("a"), F.col("rel_type").alias("t"), F.col("ror_id").alias("b"))
    sets = table(spark, d, "relationship_sets")
    names = ("parent", "child", "predecessor", "successor")
    member = F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.col(n).alias("ids")) for n in names])).alias("s")
    from_sets = sets.select(F.col("ror_id").alias("a"), member).select("a", "s.t", F.explode("s.ids").alias("b"))
    own = table(spark, d, "ror_record").select(F.col("id").alias("a"), F.explode("relationships").alias("r")).select("a", F.col("r.type").alias("t"), F.col("r.id").alias("b"))
    every = rel.unionByName(from_sets).unionByName(own).select(bare_id(F.col("a")).alias("a"), F.lower(F.trim("t")).alias("t"), bare_id(F.col("b")).alias("b"))
    kind = F.when(F.col("t").isin("parent", "child"), "parent").when(F.col("t").isin("successor", "predecessor"), "successor")
    forward = F.col("t").isin("parent", "successor")
    return (
        every.select(kind.alias("link_kind"), F.when(forward, F.col("a")).otherwise(F.col("b")).alias("child"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("up"))
        .where("link_kind IS NOT NULL AND child IS NOT NULL AND up IS NOT NULL")
        .distinct()
    )


def recorded_links(spark: SparkSession, d: str) -> DataFrame:
    """Stated links whose two ends both have a record."""
    ids = table(spark, d, "ror_record").select(bare_id(F.col("id")).alias("rid")).where("rid IS NOT NULL").distinct()
    links = stated_links(spark, d)
    links = links.join(ids.withColumnRenamed("rid", "child"), "child", "left_semi").join(ids.withColumnRenamed("rid", "up"), "up", "left_semi")
    return links.select("link_kind", "child", "up")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds at once: the kind rides in front of the id, so one run of levels serves both."""
    tagged = recorded_links(spark, d).select(F.concat_ws(":", "link_kind", "child").alias("child"), F.concat_ws(":", "link_kind", "up").alias("up"))
    return hierarchy.trees_and_rings(tagged)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    bare = lambda c: F.substring_index(c, ":", -1)
    return _positions(spark, d).select(
        F.substring_index("node", ":", 1).alias("link_kind"), bare(F.col("node")).alias("ror_id"), "outcome", bare(F.col("root")).alias("root_id"), "depth",
        F.regexp_replace("path", "[a-z]+:", "").alias("path"),
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All (ancestor, node, steps) pairs of both link kinds."""
    pairs = hierarchy.ancestor_pairs(_positions(spark, d))
    return pairs.select(F.substring_index("ancestor", ":", 1).alias("link_kind"), F.substring_index("ancestor", ":", -1).alias("ancestor"), F.substring_index("node", ":", -1).alias("node"), "steps")


def p2_cycles(spark: SparkSession, d: str) -> DataFrame:
    r = hierarchy.cycle_report(_positions(spark, d))
    return r.select(F.substring_index("root", ":", 1).alias("link_kind"), F.substring_index("root", ":", -1).alias("root_id"), "members", "below")


def p2_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Links beyond a child's first upward neighbour of a kind, which no tree holds."""
    tagged = recorded_links(spark, d).select("link_kind", F.concat_ws(":", "link_kind", "child").alias("child"), F.concat_ws(":", "link_kind", "up").alias("up"))
    bare = lambda c: F.substring_index(c, ":", -1)
    return hierarchy.further_links(tagged).select(F.substring_index("child", ":", 1).alias("link_kind"), bare(F.col("child")).alias("ror_id"), bare(F.col("up")).alias("up"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "item").where("item_id IS NOT NULL AND raw_affiliation IS NOT NULL").select("item_id", "raw_affiliation")
    return packed.explode_packed(items, "item_id", "raw_affiliation").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    tables = {"p1_items": "items[]", "p1_names": f"{_ORG}.names[]", "p1_name_types": f"{_ORG}.names[].types[]", "p1_external_ids": f"{_ORG}.external_ids[]", "p1_external_id_values": f"{_ORG}.external_ids[].all[]", "p1_locations": f"{_ORG}.locations[]", "p1_relationships": f"{_ORG}.relationships[]"}
    return {"p1_found": p1_found, **{k: _p1_table(a) for k, a in tables.items()}, "p2_found": p2_found, "p2_descendants": p2_descendants, "p2_cycles": p2_cycles, "p2_conflicts": p2_conflicts, "p7_found": p7_found}


_LINKS = (
    "SELECT DISTINCT CASE WHEN rel IN ('parent', 'child') THEN 'parent' ELSE 'successor' END kind, CASE WHEN rel IN ('parent', 'successor') THEN src ELSE dst END child, CASE WHEN rel IN ('parent', 'successor') THEN dst ELSE src END up FROM edges "
    "WHERE rel <> 'related' AND src IN (SELECT rid FROM org) AND dst IN (SELECT rid FROM org)"
)
#: Walks upward from every node until a root or a node seen before.
_WALKS = (
    f"WITH RECURSIVE l AS ({_LINKS}), w AS (SELECT kind, node, node AS cur, [node] AS way FROM (SELECT kind, child AS node FROM l UNION SELECT kind, up FROM l) UNION ALL SELECT w.kind, w.node, l.up, list_append(w.way, l.up) FROM w JOIN l ON l.kind = w.kind AND l.child = w.cur WHERE NOT list_contains(w.way, l.up)), "
    "z AS (SELECT w.kind, w.node, w.way, l.up AS again, list_position(w.way, l.up) AS k FROM w LEFT JOIN l ON l.kind = w.kind AND l.child = w.cur WHERE l.up IS NULL OR list_contains(w.way, l.up)), "
    "pos AS (SELECT kind link_kind, node ror_id, CASE WHEN again IS NULL THEN 'tree' WHEN k = 1 THEN 'ring' ELSE 'below_ring' END outcome, CASE WHEN again IS NULL THEN way[-1] ELSE list_min(way[k:]) END root_id, (CASE WHEN again IS NULL THEN len(way) ELSE k END - 1)::BIGINT AS depth, list_reverse(CASE WHEN again IS NULL THEN way ELSE way[1:k] END) AS way FROM z) "
)


def oracle_sql() -> dict[str, str]:
    """Hierarchies in SQL; shapes of raw JSON and quoting rules are tested by brute force."""
    return oracle.statements({
        "p2_found": _WALKS + "SELECT link_kind, ror_id, outcome, root_id, depth, array_to_string(way, '/') AS path FROM pos",
        "p2_descendants": _WALKS + "SELECT link_kind, way[i] AS ancestor, ror_id AS node, (len(way) - i)::BIGINT steps FROM (SELECT *, unnest(range(1, len(way))) i FROM pos)",
        "p2_cycles": _WALKS + "SELECT link_kind, root_id, count(*) FILTER (WHERE outcome = 'ring') members, count(*) FILTER (WHERE outcome = 'below_ring') below FROM pos WHERE outcome <> 'tree' GROUP BY ALL",
    })
