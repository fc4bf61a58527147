"""Named queries of the scoring engine; their oracle SQL is in :mod:`orgweave.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgweave.functions import ids as I
from orgweave.functions import text as X
from orgweave.operators import graph, labels, matching, metrics
from orgweave.plans import oracle
from orgweave.plans import views as V
from orgweave.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _join(c: str) -> Column:
    return F.array_join(c, "|")


# --- sources and records -------------------------------------------------------------------


@query
def id_normalise(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "org_relationship").select(F.explode(F.array("org_id", "ror_id")).alias("raw")).distinct()
    return raw.select("raw", I.canonical_id(F.col("raw")).alias("ror_id"))


@query
def id_normalise_set(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "relationship_sets").select(I.canonical_id(F.col("ror_id")).alias("ror_id"), _join(I.canonical_set(F.col("related"))).alias("related")).where("related <> ''")
    return r.distinct()


@query
def org_load(s: SparkSession, d: str) -> DataFrame:
    return V.org(s, d).select("rid", "status", F.col("established").cast("bigint").alias("established"), "name", "city", "country")


@query
def org_lookup(s: SparkSession, d: str) -> DataFrame:
    """Records whose identifiers any response mentions: a keyed lookup by semi join."""
    wanted = table(s, d, "matcher_response").select(F.explode("items").alias("i")).select(I.bare_id(F.col("i.organization.id")).alias("rid")).where("rid IS NOT NULL").distinct()
    return V.org(s, d).join(wanted, "rid", "left_semi").select("rid", "name", "status")


@query
def org_summary(s: SparkSession, d: str) -> DataFrame:
    st = V.org(s, d).groupBy(F.concat(F.lit("status:"), F.col("status")).alias("what")).agg(F.count("*").alias("n"))
    rel = V.latest_records(s, d).select(F.explode("relationships").alias("r")).groupBy(F.concat(F.lit("edge:"), F.lower(F.trim("r.type"))).alias("what")).agg(F.count("*").alias("n"))
    return st.unionByName(rel)


@query
def duplicate_records(s: SparkSession, d: str) -> DataFrame:
    """Identifiers with several stored rows, which a strict load would refuse."""
    return table(s, d, "ror_record").groupBy(I.bare_id(F.col("id")).alias("rid")).agg(F.count("*").alias("n")).where("n > 1")


@query
def candidate_parse(s: SparkSession, d: str) -> DataFrame:
    r = V.latest_records(s, d)
    has = lambda t: (lambda n: F.array_contains(n["types"], t))
    val = lambda a: F.transform(a, lambda n: n["value"])
    usable = F.filter("names", lambda n: n["value"].isNotNull())
    shown = F.filter(usable, has("ror_display"))
    acr = val(F.filter(usable, lambda n: F.array_contains(n["types"], "acronym") & ~F.array_contains(n["types"], "ror_display")))
    ali = val(F.filter(usable, lambda n: ~F.array_contains(n["types"], "acronym") & ~F.array_contains(n["types"], "ror_display")))
    place = F.try_element_at("locations", F.lit(1))["geonames_details"]
    name = F.coalesce(F.try_element_at(shown, F.lit(-1))["value"], F.try_element_at(F.concat(ali, acr), F.lit(1)))
    rels = F.size(F.filter("relationships", lambda x: x["type"].isNotNull() & x["label"].isNotNull() & x["id"].isNotNull()))
    return r.select("rid", name.alias("name"), F.array_join(ali, "|").alias("aliases"), F.array_join(acr, "|").alias("acronyms"), place["name"].alias("city"), F.coalesce(place["country_name"], place["country_code"]).alias("country"), F.greatest(rels, F.lit(0)).cast("bigint").alias("relationships"))


@query
def latest_by(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "item").where("item_id IS NOT NULL")
    return r.groupBy("item_id").agg(F.max(F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss")).alias("last_seen"), F.count("*").alias("rows"))


@query
def instance_explode(s: SparkSession, d: str) -> DataFrame:
    """One row per work, own affiliation and up to four other strings of the same work."""
    r = table(s, d, "item").where("context IS NOT NULL AND item_id IS NOT NULL").select("item_id", F.trim("raw_affiliation").alias("raw"), "context.doi", F.col("context.coauthor_affiliations").alias("co")).distinct()
    others = F.slice(F.filter("co", lambda x: (F.trim(x) != F.col("raw")) & (F.trim(x) != "")), 1, 4)
    return r.select("item_id", "doi", F.posexplode(others).alias("pos", "other")).select("item_id", "doi", F.col("pos").cast("bigint").alias("pos"), "other").distinct()


@query
def item_key(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "item").select("raw_affiliation", F.coalesce("context.doi", F.lit("None")).alias("doi")).where("raw_affiliation IS NOT NULL").distinct()
    return r.select("raw_affiliation", "doi", F.substring(F.sha2(F.concat_ws("|", "doi", "raw_affiliation"), 256), 1, 16).alias("key"))


@query
def json_scan(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "events")
    keys = ev.select("event_id", F.explode(F.expr("from_json(props, 'map<string,string>')")).alias("k", "v"))
    return keys.select("event_id", "k", "v")


# --- text ------------------------------------------------------------------------------------


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "item").select(F.col("raw_affiliation").alias("raw")).where("raw IS NOT NULL").distinct()


@query
def script_detect(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select("raw", X.dominant_script(F.col("raw")).alias("script")).where("script IS NOT NULL")


@query
def token_signals(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select("raw", X.token_signals(F.col("raw")).alias("t")).select("raw", "t.hospital", "t.government", "t.company", "t.multi")


@query
def multi_affil(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).where(X.looks_multi(F.col("raw")))


@query
def redact_emails(s: SparkSession, d: str) -> DataFrame:
    r = _raw(s, d).select("raw", X.redact_emails(F.col("raw")).alias("e")).where("e.n > 0")
    return r.select(F.md5("raw").alias("raw_md5"), "e.text", F.col("e.n").cast("bigint").alias("n"))


@query
def redact_many(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "item").where("item_id IS NOT NULL").select("item_id", F.concat(F.array("raw_affiliation"), F.coalesce("context.coauthor_affiliations", F.array().cast("array<string>"))).alias("texts")).distinct()
    red = r.select("item_id", F.transform("texts", lambda x: X.redact_emails(x)).alias("e"))
    return red.select("item_id", F.array_join(F.transform("e", lambda x: x["text"]), "\n").alias("text"), F.aggregate("e", F.lit(0), lambda a, x: a + x["n"]).cast("bigint").alias("n")).where("n > 0").distinct()


@query
def contains_norm(s: SparkSession, d: str) -> DataFrame:
    """Items and whether their affiliation holds the city of each candidate, accents and case apart."""
    c = V.candidates(s, d).where("city IS NOT NULL").select("item_id", "city").distinct()
    r = table(s, d, "item").where("item_id IS NOT NULL AND raw_affiliation IS NOT NULL").select("item_id", "raw_affiliation").distinct().join(c, "item_id")
    return r.select("item_id", "city", X.contains_folded(F.col("raw_affiliation"), F.col("city")).alias("hit"))


@query
def stratum_route(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select(X.stratum_route(F.col("raw")).alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))


@query
def sentences(s: SparkSession, d: str) -> DataFrame:
    paras = table(s, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", X.PARAGRAPH)).alias("para", "p"))
    sents = paras.select("doc_id", "para", F.posexplode(F.split("p", X.SENTENCE)).alias("sent", "t"))
    lead = F.regexp_replace(F.trim("t"), X.LEAD, "")
    flat = F.trim(F.regexp_replace(lead, r"\s+", " "))
    return sents.select("doc_id", F.col("para").cast("bigint").alias("para"), F.col("sent").cast("bigint").alias("sent"), F.md5(flat).alias("md5"), F.length(flat).cast("bigint").alias("len")).where("len > 0")


@query
def digit_lint(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", X.typed_digits(F.col("text")).alias("t"))
    return r.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens")).where("n > 0")


@query
def html_size_budget(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), (F.octet_length("text") <= 4000).alias("within"))


@query
def html_refs(s: SparkSession, d: str) -> DataFrame:
    """Offences of raw payload text against self-containment: schemes, protocol-relative links, imports."""
    p = F.regexp_replace(F.lower("payload"), r"\\(?:/|u002f|x2f)", "/")
    r = table(s, d, "raw_response").where("payload IS NOT NULL").select("response_id", F.regexp_count(p, F.lit("https?://")).cast("bigint").alias("urls"), F.regexp_count(p, F.lit("[=\"'`(]//")).cast("bigint").alias("relative"), F.regexp_count(p, F.lit("@import")).cast("bigint").alias("imports"), F.regexp_count(p, F.lit(r"\bfetch\s*\(")).cast("bigint").alias("fetches"))
    return r.distinct()


@query
def unit_family(s: SparkSession, d: str) -> DataFrame:
    u = _units(s, d)
    return u.select("key", "unit", X.normalise_unit(F.col("unit")).alias("normal"), X.unit_family(F.col("unit")).alias("family"))


def _units(s: SparkSession, d: str) -> DataFrame:
    """Findings-like rows from the events: key, value, unit, n."""
    names = ["Per-Cent", "per_cent", "pp", "proportion", "Fraction of items", "count", "percentage point", "kappa", "%", "ratio"]
    unit = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    value = F.round(F.when(F.col("event_id") % 3 == 0, F.col("value") / 100).otherwise(F.col("value")), 4)
    return table(s, d, "events").select(F.concat(F.lit("k_"), F.col("event_id").cast("string")).alias("key"), value.alias("value"), unit.alias("unit"), F.when(F.col("event_id") % 50 == 0, "small by design").alias("exempt"), F.col("event_id"))


@query
def scale_guard(s: SparkSession, d: str) -> DataFrame:
    return _units(s, d).select("key", X.scale_violation(F.col("value"), F.col("unit"), F.col("exempt")).alias("violation")).where("violation IS NOT NULL")


@query
def finding_validate(s: SparkSession, d: str) -> DataFrame:
    """Violation codes of findings built from label rows."""
    r = table(s, d, "label_event").select("label_id", F.lower("annotator").alias("key"), "note", F.col("elapsed_ms").alias("n"), "submitted_at").distinct()
    codes = F.array(
        F.when(~F.col("key").rlike("^[a-z0-9_]+$"), F.lit("key")), F.when(F.col("n").isNull() | (F.col("n") < 0), F.lit("n")),
        F.when(~F.coalesce(F.col("submitted_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), F.lit(False)), F.lit("date")), F.when(F.trim("note") == "", F.lit("note")),
    )
    return r.select("label_id", F.array_join(F.filter(codes, lambda c: c.isNotNull()), "|").alias("codes")).groupBy("codes").agg(F.count("*").alias("n"))


@query
def placeholders(s: SparkSession, d: str) -> DataFrame:
    """Placeholders of a template per nation, filled from findings where the key is known."""
    r = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = F.concat(F.lit("{{f."), F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", "_")), F.lit("}} in {{f.region}} and {{f.Bad}}"))
    r = r.select("n_nationkey", "r_name", t.alias("t"))
    return r.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.array_join(F.regexp_extract_all("t", F.lit(X.PLACEHOLDER), F.lit(1)), "|").alias("keys"), F.regexp_replace("t", r"\{\{f\.region\}\}", F.col("r_name")).alias("filled"), F.regexp_count("t", F.lit(r"\{\{[^{}]*\}\}")).cast("bigint").alias("attempts"))


@query
def unreferenced_findings(s: SparkSession, d: str) -> DataFrame:
    used = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(s, d, "part").join(used, "p_partkey", "left_anti").select(F.col("p_partkey").cast("bigint").alias("p_partkey"))


@query
def snapshot_hash(s: SparkSession, d: str) -> DataFrame:
    """Hash over the sorted content hashes of every source's documents."""
    r = table(s, d, "documents").where("text IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("source"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("line")).distinct()
    return r.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"), F.count("*").alias("files"))


@query
def color_scale(s: SparkSession, d: str) -> DataFrame:
    steps = s.range(0, 9).withColumn("position", F.col("id") / 8)
    return steps.select(F.col("id").alias("step"), X.mix_hex("#ffffff", "#0072b2", F.col("position")).alias("colour"))


@query
def keyed_upsert(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    new = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("bigint").alias("n"))
    return labels.keyed_upsert(old, new, "key")


# --- graph -----------------------------------------------------------------------------------


@query
def edge_sym(s: SparkSession, d: str) -> DataFrame:
    return graph.symmetrise(V.edges_asserted(s, d))


@query
def edge_counts(s: SparkSession, d: str) -> DataFrame:
    return V.edges_asserted(s, d).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("stating"))


@query
def succession_steps(s: SparkSession, d: str) -> DataFrame:
    return graph.succession_steps(edge_sym(s, d)).select("old", "new", F.col("steps").cast("bigint").alias("steps"))


@query
def ancestry_distance(s: SparkSession, d: str) -> DataFrame:
    return graph.ancestry(edge_sym(s, d)).select("low", "high", F.col("depth").cast("bigint").alias("depth"))


@query
def ancestry_hist(s: SparkSession, d: str) -> DataFrame:
    return ancestry_distance(s, d).groupBy("depth").agg(F.count("*").alias("pairs"))


@query
def active_successors(s: SparkSession, d: str) -> DataFrame:
    return graph.active_successors(edge_sym(s, d), V.org(s, d))


@query
def superseded(s: SparkSession, d: str) -> DataFrame:
    return graph.superseded(V.edges_asserted(s, d), V.org(s, d))


@query
def crosswalk(s: SparkSession, d: str) -> DataFrame:
    return graph.crosswalk(V.latest_records(s, d))


@query
def crosswalk_ambiguous(s: SparkSession, d: str) -> DataFrame:
    return crosswalk(s, d).groupBy("scheme").agg(F.count("*").alias("ids"), F.count(F.when(F.col("n") > 1, 1)).alias("ambiguous"))


# --- label log -------------------------------------------------------------------------------


@query
def labels_live(s: SparkSession, d: str) -> DataFrame:
    return V.live_labels(s, d).select("item_id", "annotator", "label_id", "decision", _join("ids").alias("ids"))


@query
def labels_undo(s: SparkSession, d: str) -> DataFrame:
    return labels.undone(V.live_labels(s, d), 3).groupBy("annotator").agg(F.count("*").alias("n"), F.max("label_id").alias("newest"))


@query
def outcome_key(s: SparkSession, d: str) -> DataFrame:
    return V.live_labels(s, d).groupBy(labels.outcome_key(F.col("decision"), F.col("ids")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def progress(s: SparkSession, d: str) -> DataFrame:
    return labels.progress(V.live_labels(s, d), V.strata(s, d))


@query
def items_unlabelled(s: SparkSession, d: str) -> DataFrame:
    """Items without a live label, with the place that a hash of the id gives them in the queue of their stratum."""
    st = V.strata(s, d).join(V.live_labels(s, d).select("item_id").distinct(), "item_id", "left_anti")
    w = Window.partitionBy("stratum").orderBy(F.sha2("item_id", 256))
    return st.withColumn("place", F.row_number().over(w)).select("item_id", "stratum", F.col("place").cast("bigint").alias("place"))


@query
def iaa_pairs(s: SparkSession, d: str) -> DataFrame:
    return labels.annotator_pairs(V.live_labels(s, d))


@query
def kappa(s: SparkSession, d: str) -> DataFrame:
    """Kappa of every two annotators in every stratum where both labelled an item."""
    return metrics.kappa(iaa_pairs(s, d).join(V.strata(s, d), "item_id"), "a", "b", "stratum")


@query
def decision_derive(s: SparkSession, d: str) -> DataFrame:
    """Stored decision against the one that follows from the proposed set."""
    prop = V.candidates(s, d).where("llm_proposed").groupBy("item_id").agg(F.array_sort(F.collect_set("rid")).alias("p"))
    l = V.live_labels(s, d).where("decision IN ('accepted', 'corrected')").join(prop, "item_id", "left")
    derived = F.when(F.col("ids") == F.coalesce("p", F.array().cast("array<string>")), "accepted").otherwise("corrected")
    return l.groupBy("decision", derived.alias("derived")).agg(F.count("*").alias("n"))


@query
def ids_outside(s: SparkSession, d: str) -> DataFrame:
    ids = V.live_labels(s, d).select("label_id", F.explode("ids").alias("rid"))
    return ids.join(V.org(s, d).select("rid"), "rid", "left_anti").select("label_id", "rid")


@query
def within_release(s: SparkSession, d: str) -> DataFrame:
    return V.candidates(s, d).join(V.org(s, d).select("rid"), "rid", "left_semi").groupBy("item_id").agg(F.count("*").alias("n"))


@query
def gold_integrity(s: SparkSession, d: str) -> DataFrame:
    ids = V.gold(s, d).select("item_id", F.explode("ids").alias("rid")).join(V.org(s, d).select("rid", "status"), "rid", "left")
    succ = graph.symmetrise(V.edges_asserted(s, d)).where("rel = 'successor'").groupBy(F.col("a").alias("rid")).agg(F.array_join(F.array_sort(F.collect_set("b")), "|").alias("successors"))
    return ids.where("status IS NULL OR status <> 'active'").join(succ, "rid", "left").select("item_id", "rid", F.coalesce("status", F.lit("absent")).alias("status"), F.coalesce("successors", F.lit("")).alias("successors"))


@query
def candidate_rank(s: SparkSession, d: str) -> DataFrame:
    """Each item's eight best candidates by score, in pool order where scores tie or are missing."""
    w = Window.partitionBy("item_id").orderBy(F.coalesce("match_score", F.lit(0.0)).desc(), "rank")
    c = V.candidates(s, d).withColumn("place", F.row_number().over(w)).where("place <= 8")
    return c.select("item_id", F.col("place").cast("bigint").alias("place"), "rid", "match_score")


@query
def prompt_build(s: SparkSession, d: str) -> DataFrame:
    c = V.candidates(s, d)
    alias = F.when(F.size("aliases") > 0, F.concat(F.lit(" (aliases: "), F.array_join(F.slice("aliases", 1, 4), ", "), F.lit(")"))).otherwise("")
    place = F.array_join(F.filter(F.array("city", "country"), lambda x: x.isNotNull() & (x != "")), ", ")
    kinds = F.when(F.size("org_types") > 0, F.array_join("org_types", ", ")).otherwise("type unknown")
    line = F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), "rid", F.lit(" "), F.coalesce("name", F.lit("")), alias, F.lit(" ["), F.when(place == "", "location unknown").otherwise(place), F.lit("; "), kinds, F.lit("]"))
    per = c.select("item_id", F.struct("rank", line.alias("line")).alias("l")).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("pool"))
    raw = table(s, d, "item").where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("raw_affiliation").alias("raw"))
    return per.join(raw, "item_id").select("item_id", F.md5(F.concat_ws("\n", F.concat(F.lit("Affiliation string: "), "raw"), F.lit("Candidate pool:"), "pool")).alias("md5"))


@query
def proposal_apply(s: SparkSession, d: str) -> DataFrame:
    """Proposed candidates with the confidence clamped to [0, 1] and blank reasons dropped."""
    c = V.candidates(s, d).where("llm_proposed")
    reason = F.when(F.trim("llm_justification") != "", F.col("llm_justification"))
    return c.select("item_id", F.col("rank").cast("bigint").alias("rank"), "rid", F.when(F.col("llm_confidence").isNotNull(), F.least(F.greatest("llm_confidence", F.lit(0.0)), F.lit(1.0))).alias("confidence"), reason.alias("reason"))


# --- scoring ---------------------------------------------------------------------------------


def _clean_frame(s: SparkSession, d: str) -> DataFrame:
    """Frame rows whose gold names only active records."""
    bad = gold_integrity(s, d).select("item_id").distinct()
    return V.frame(s, d).join(bad, "item_id", "left_anti")


def _relations(s: SparkSession, d: str) -> DataFrame:
    """Pairs of assigned and gold ids per item and source with their relation."""
    sym = cut(edge_sym(s, d))
    chain = graph.succession_steps(sym)
    fr = _clean_frame(s, d).where("decision IN ('accepted', 'corrected')").select("item_id", "source", F.explode("gold_ids").alias("gold"))
    pairs = V.assignment(s, d).join(fr, ["item_id", "source"]).select("item_id", "source", F.col("rid").alias("assigned"), "gold")
    return matching.pair_relations(pairs, sym, chain, V.org(s, d))


def _scores(s: SparkSession, d: str) -> DataFrame:
    a = V.assignment(s, d).groupBy("item_id", "source").agg(F.array_sort(F.collect_set("rid")).alias("assigned_ids"))
    sides = _clean_frame(s, d).join(a, ["item_id", "source"], "left").withColumn("assigned_ids", F.coalesce("assigned_ids", F.array().cast("array<string>")))
    return cut(matching.score_sets(cut(sides), cut(_relations(s, d))))


@query
def pair_relations(s: SparkSession, d: str) -> DataFrame:
    return _relations(s, d).select("item_id", "source", "assigned", "gold", "relation", "active", "chained")


@query
def rule_pairs(s: SparkSession, d: str) -> DataFrame:
    r = _relations(s, d)
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.array(*[F.lit(x) for x in v]).alias("acc")) for k, v in matching.RULES.items()])).alias("k")
    return r.where("active").select("item_id", "source", "assigned", "gold", "relation", rules).where(F.array_contains("k.acc", F.col("relation"))).select("item_id", "source", "assigned", "gold", "k.rule")


@query
def active_assigned(s: SparkSession, d: str) -> DataFrame:
    a = V.assignment(s, d).join(V.org(s, d).select("rid", "status"), "rid", "left")
    return a.groupBy("source", F.coalesce("status", F.lit("absent")).alias("status")).agg(F.count("*").alias("n"))


@query
def stale_assigned(s: SparkSession, d: str) -> DataFrame:
    return _relations(s, d).where("NOT active AND chained").select("item_id", "source", "assigned").distinct()


@query
def ancestry_min(s: SparkSession, d: str) -> DataFrame:
    """Least ancestry distance between the assigned and the gold ids, NULL where there is none."""
    r = _relations(s, d).select("item_id", "source", "assigned", "gold")
    anc = graph.ancestry(edge_sym(s, d))
    up = r.join(anc.select(F.col("low").alias("assigned"), F.col("high").alias("gold"), F.col("depth").alias("d1")), ["assigned", "gold"], "left")
    both = up.join(anc.select(F.col("low").alias("gold"), F.col("high").alias("assigned"), F.col("depth").alias("d2")), ["assigned", "gold"], "left")
    return both.groupBy("item_id", "source").agg(F.min(F.when(F.col("assigned") == F.col("gold"), 0).otherwise(F.least("d1", "d2"))).cast("bigint").alias("distance"))


@query
def score_items(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d)


@query
def bipartite_match(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).where("tp IS NOT NULL AND gold > 0").select("item_id", "source", "rule", F.col("tp").alias("matched"))


@query
def score_invariants(s: SparkSession, d: str) -> DataFrame:
    """Rows whose counts contradict their outcome; there must be none."""
    bad = "(tp IS NOT NULL AND (tp + fp <> assigned OR tp + fn <> gold OR tp < 0 OR fp < 0 OR fn < 0)) OR (outcome = 'correct' AND (fp <> 0 OR fn <> 0)) OR (outcome IN ('stale', 'wrong') AND tp <> 0) OR (outcome IN ('no_assignment', 'gold_ambiguous') AND tp IS NOT NULL)"
    return _scores(s, d).where(bad).select("item_id", "source", "rule", "outcome")


@query
def micro_counts(s: SparkSession, d: str) -> DataFrame:
    return metrics.micro_counts(_scores(s, d), "source", "rule")


@query
def prf_by_stratum(s: SparkSession, d: str) -> DataFrame:
    return metrics.prf_by(_scores(s, d).join(V.strata(s, d), "item_id"), "stratum", "source", "rule")


@query
def coverage(s: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(_scores(s, d))


@query
def outcome_rates(s: SparkSession, d: str) -> DataFrame:
    return metrics.outcome_rates(_scores(s, d))


@query
def stale_sensitivity(s: SparkSession, d: str) -> DataFrame:
    return metrics.stale_sensitivity(_scores(s, d))


@query
def relation_taxonomy(s: SparkSession, d: str) -> DataFrame:
    return _relations(s, d).groupBy("source", "relation").agg(F.count("*").alias("n"))


@query
def rule_ranking(s: SparkSession, d: str) -> DataFrame:
    r = metrics.with_prf(micro_counts(s, d))
    return r.select("rule", "source", "f1", F.rank().over(Window.partitionBy("rule").orderBy(F.col("f1").desc_nulls_last())).cast("bigint").alias("place"))


@query
def losses_table(s: SparkSession, d: str) -> DataFrame:
    """Strata and rules in which the designated source 'matcher' is not the best."""
    p = prf_by_stratum(s, d).select("stratum", "rule", "source", "f1")
    w = Window.partitionBy("stratum", "rule")
    best = p.withColumn("best", F.max("f1").over(w))
    return best.where("source = 'matcher' AND coalesce(f1, -1) < best").select("stratum", "rule", "f1", "best")


@query
def blind_report(s: SparkSession, d: str) -> DataFrame:
    """Rates under neutral letters; the real names join last."""
    names = s.createDataFrame([("matcher", "A"), ("proposer", "B"), ("ranker", "C")], "source string, letter string")
    return metrics.outcome_rates(_scores(s, d)).where("rule = 'exact'").join(F.broadcast(names), "source").select("letter", "outcome", "n", "rate")


@query
def intersection_frame(s: SparkSession, d: str) -> DataFrame:
    """Items that every source assigns something."""
    n = V.assignment(s, d).groupBy("item_id").agg(F.count_distinct("source").alias("k"))
    return n.where(F.col("k") == len(V.SOURCES)).select("item_id")


@query
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    rows = _scores(s, d).where("rule = 'exact'").join(V.strata(s, d), "item_id", "left")
    return metrics.bootstrap(rows.na.fill("unknown", ["stratum"]), ["source"])


# --- clustering ------------------------------------------------------------------------------


def _clusters(s: SparkSession, d: str) -> DataFrame:
    """Items by the record that gold names and the one that the ranker assigns."""
    g = V.gold(s, d).where(F.size("ids") == 1).select("item_id", F.col("ids")[0].alias("gold"))
    a = V.assignment(s, d).where("source = 'ranker'").groupBy("item_id").agg(F.min("rid").alias("found"))
    return cut(metrics.clusters(g.join(a, "item_id")))


@query
def bcubed(s: SparkSession, d: str) -> DataFrame:
    return metrics.bcubed(_clusters(s, d))


@query
def pairwise_prf(s: SparkSession, d: str) -> DataFrame:
    return metrics.pairwise(_clusters(s, d))


@query
def cluster_purity(s: SparkSession, d: str) -> DataFrame:
    return metrics.purity(_clusters(s, d))


@query
def split_merge(s: SparkSession, d: str) -> DataFrame:
    return metrics.split_merge(_clusters(s, d))


@query
def quota_cells(s: SparkSession, d: str) -> DataFrame:
    """Fifths of author-name frequency against the number of venues, as a quota grid."""
    a = table(s, d, "item").where("context.author_name IS NOT NULL").groupBy(F.col("context.author_name").alias("author")).agg(F.count_distinct("item_id").alias("n"), F.count_distinct("context.venue").alias("venues"))
    freq = a.groupBy("n").agg(F.count("*").alias("authors"))
    upto = freq.withColumn("upto", F.sum("authors").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))).withColumn("of", F.sum("authors").over(Window.partitionBy()))
    fifth = upto.select("n", F.floor(F.coalesce("upto", F.lit(0)) * 5 / F.col("of")).cast("bigint").alias("commonality"))
    mobility = F.when(F.col("venues") <= 1, "1").when(F.col("venues") <= 3, "2-3").otherwise("4+")
    return a.join(F.broadcast(fifth), "n").groupBy("commonality", mobility.alias("mobility")).agg(F.count("*").alias("authors"))


@query
def quota_sample(s: SparkSession, d: str) -> DataFrame:
    """Up to 50 items of each stratum, one of each sub-stratum before any second one."""
    sub = F.coalesce(F.regexp_replace(F.lower(F.trim("sub_stratum")), r"[\s_\-]+", "_"), F.lit(""))
    st = F.regexp_replace(F.lower(F.trim("stratum")), r"[\s_\-]+", "_")
    r = table(s, d, "item").where("item_id IS NOT NULL AND stratum IS NOT NULL").groupBy("item_id").agg(F.min(st).alias("stratum"), F.min(sub).alias("sub"))
    r = r.withColumn("h", F.sha2("item_id", 256))
    seen = r.withColumn("k", F.row_number().over(Window.partitionBy("stratum", "sub").orderBy("h")))
    few = seen.where("k <= 50")
    pick = few.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("k", "h")))
    return pick.where("place <= 50").select("item_id", "stratum", "sub", F.col("place").cast("bigint").alias("place"))


@query
def stratum_shortfall(s: SparkSession, d: str) -> DataFrame:
    n = V.strata(s, d).groupBy("stratum").agg(F.count("*").alias("n"))
    t = table(s, d, "strata_target").groupBy(F.lower("stratum").alias("stratum")).agg(F.sum("target_rows").alias("target"))
    return t.join(n, "stratum", "left").select("stratum", "target", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("shortfall"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.statements().items() if k in _QUERIES}
