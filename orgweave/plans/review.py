"""Named queries around labelling and publishing: loads, queues, exports, contracts, replies; each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgweave.operators import contracts
from orgweave.plans import oracle
from orgweave.plans import views as V
from orgweave.session import table

# A reply's code fence, a figure's name, what stands between and before the lines of context.
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
FIGURE_NAME = r"^[a-z0-9][a-z0-9-]*\z"
BETWEEN, DOI, COAUTHOR = " · ", "doi: ", "co-author affiliation: "

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def first_loaded(s: SparkSession, d: str) -> DataFrame:
    """Items as an idempotent load leaves them: of repeated rows the first ingested stays, ties by text."""
    r = table(s, d, "item").where("item_id IS NOT NULL")
    kept = r.groupBy("item_id").agg(F.min(F.struct("ingested_at", F.coalesce("raw_affiliation", F.lit("")).alias("raw"))).alias("i"))
    return kept.select("item_id", "i.raw", F.sha2("item_id", 256).alias("queue_key"))


_FIRST = "SELECT item_id, raw, sha256(item_id) queue_key FROM (SELECT item_id, coalesce(raw_affiliation, '') raw, row_number() OVER (PARTITION BY item_id ORDER BY ingested_at NULLS FIRST, coalesce(raw_affiliation, '')) rn FROM item WHERE item_id IS NOT NULL) WHERE rn = 1"


@query(f"WITH f AS ({_FIRST}) SELECT f.item_id, f.raw, f.queue_key, p.run_id FROM f LEFT JOIN prop p USING (item_id)")
def items_merge(s: SparkSession, d: str) -> DataFrame:
    """Items of an idempotent load with the run of the proposal that the load put last."""
    p = table(s, d, "proposal").where("item_id IS NOT NULL")
    w = Window.partitionBy("item_id").orderBy(F.col("created_at").desc_nulls_last(), "run_id", F.size("candidates").desc())
    newest = p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("item_id", "run_id")
    return first_loaded(s, d).join(newest, "item_id", "left").select("item_id", "raw", "queue_key", "run_id")


@query(f"WITH f AS ({_FIRST}) SELECT l.label_id, l.item_id, f.raw, l.annotator, l.decision, array_to_string(l.ids, '|') ids, l.elapsed_ms FROM live l JOIN f USING (item_id)")
def export_labels(s: SparkSession, d: str) -> DataFrame:
    """Live labels with their items; sorting by label_id is the writer's, which needs one order only."""
    live = V.live_labels(s, d).select("label_id", "item_id", "annotator", "decision", F.array_join("ids", "|").alias("ids"), "elapsed_ms")
    return live.join(first_loaded(s, d).select("item_id", "raw"), "item_id").select("label_id", "item_id", "raw", "annotator", "decision", "ids", "elapsed_ms")


@query(
    f"WITH f AS ({_FIRST}), a AS (SELECT DISTINCT annotator FROM label_event WHERE annotator IS NOT NULL), n AS (SELECT a.annotator, arg_min(f.item_id, f.queue_key) item_id FROM a CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.annotator = a.annotator AND l.item_id = f.item_id) GROUP BY 1) "
    "SELECT annotator, item_id, coalesce(len(p.candidates), 0)::BIGINT candidates FROM n LEFT JOIN prop p USING (item_id)"
)
def queue_next(s: SparkSession, d: str) -> DataFrame:
    """Each annotator's next item, the first in queue order without a live label of theirs, and the size of its pool.

    Items lie in 4096 buckets by the head of their queue key.  An annotator's next item is in
    the first bucket that they have not finished, so only that bucket is searched; nobody
    meets the whole queue.
    """
    items = first_loaded(s, d).select("item_id", "queue_key", F.substring("queue_key", 1, 3).alias("bucket"))
    done = V.live_labels(s, d).select("annotator", "item_id").join(items, "item_id")
    sizes = items.groupBy("bucket").agg(F.count("*").alias("n"))
    buckets = F.array(*[F.lit(r.bucket) for r in sizes.select("bucket").orderBy("bucket").collect()]).cast("array<string>")
    full = done.groupBy("annotator", "bucket").agg(F.count("*").alias("k")).join(sizes, "bucket").where("k = n").groupBy("annotator").agg(F.collect_set("bucket").alias("full"))
    people = table(s, d, "label_event").where("annotator IS NOT NULL").select("annotator").distinct().join(full, "annotator", "left")
    at = F.try_element_at(F.array_except(buckets, F.coalesce("full", F.array().cast("array<string>"))), F.lit(1))
    open_items = people.select("annotator", at.alias("bucket")).join(items, "bucket").join(done.select("annotator", "item_id"), ["annotator", "item_id"], "left_anti")
    nxt = open_items.groupBy("annotator").agg(F.min(F.struct("queue_key", "item_id")).alias("i")).select("annotator", "i.item_id")
    p = table(s, d, "proposal").where("item_id IS NOT NULL").join(nxt.select("item_id").distinct(), "item_id", "left_semi")
    w = Window.partitionBy("item_id").orderBy(F.col("created_at").desc_nulls_last(), "run_id", F.size("candidates").desc())
    pool = p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("item_id", F.size("candidates").alias("n"))
    return nxt.join(pool, "item_id", "left").select("annotator", "item_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("bigint").alias("candidates"))


@query("SELECT o_custkey::BIGINT custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey))::BIGINT orderkey FROM orders GROUP BY 1")
def release_select(s: SparkSession, d: str) -> DataFrame:
    """The newest of several releases: the greatest by date and, on one date, by id."""
    r = table(s, d, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return r.select("custkey", F.col("r.o_orderkey").cast("bigint").alias("orderkey"))


@query(
    "WITH c AS (SELECT DISTINCT item_id, context FROM item WHERE item_id IS NOT NULL AND context IS NOT NULL), l AS (SELECT item_id, list_concat("
    "list_filter([array_to_string(list_filter([context.author_name, context.title, context.venue, CASE WHEN context.\"year\" <> 0 THEN context.\"year\"::VARCHAR END], lambda x: x IS NOT NULL AND x <> ''), ' · '), CASE WHEN context.doi <> '' THEN 'doi: ' || context.doi END], lambda x: x IS NOT NULL AND x <> ''), "
    "list_transform(coalesce(context.coauthor_affiliations, []::VARCHAR[])[1:3], lambda x: 'co-author affiliation: ' || coalesce(x, 'None'))) AS t FROM c) SELECT DISTINCT item_id, md5(array_to_string(t, chr(10))) AS md5, len(t)::BIGINT AS n FROM l"
)
def context_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of context that a prompt adds to an item: header, doi and up to three co-affiliations."""
    c = table(s, d, "item").where("item_id IS NOT NULL AND context IS NOT NULL").select("item_id", "context.*")
    year = F.when(F.col("year") != 0, F.col("year").cast("string"))
    there = lambda x: x.isNotNull() & (x != "")
    header = F.array_join(F.filter(F.array("author_name", "title", "venue", year), there), BETWEEN)
    first = F.filter(F.array(header, F.when(F.col("doi") != "", F.concat(F.lit(DOI), "doi"))), there)
    others = F.transform(F.slice(F.coalesce("coauthor_affiliations", F.array().cast("array<string>")), 1, 3), lambda x: F.concat(F.lit(COAUTHOR), F.coalesce(x, F.lit("None"))))
    lines = F.concat(first, others)
    return c.select("item_id", F.md5(F.array_join(lines, "\n")).alias("md5"), F.size(lines).cast("bigint").alias("n")).distinct()


@query("SELECT item_id, bool_or(coalesce(country IN ('Nigeria', 'Kenya', 'Egypt'), false)) in_country, bool_or(coalesce(list_contains(org_types, 'company'), false)) is_company FROM cand GROUP BY item_id")
def authorship_filters(s: SparkSession, d: str) -> DataFrame:
    """Whether any organisation proposed for an item is in a set of countries, or of a type."""
    c = V.candidates(s, d)
    flag = lambda x: F.bool_or(F.coalesce(x, F.lit(False)))
    return c.groupBy("item_id").agg(flag(F.col("country").isin("Nigeria", "Kenya", "Egypt")).alias("in_country"), flag(F.array_contains("org_types", "company")).alias("is_company"))


def html_escape(c: Column) -> Column:
    """Text safe inside an element and a quoted attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS md5 FROM documents WHERE text IS NOT NULL")
def html_escaped(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(html_escape(F.col("text"))).alias("md5"))


@query("SELECT DISTINCT repo_key AS name, regexp_full_match(repo_key, '[a-z0-9][a-z0-9-]*') valid, CASE WHEN regexp_full_match(repo_key, '[a-z0-9][a-z0-9-]*') THEN 'figures/v1/' || repo_key END id FROM documents WHERE repo_key IS NOT NULL")
def figure_ids(s: SparkSession, d: str) -> DataFrame:
    """Identity of a figure by name: lower-case letters, digits and hyphens only, as it becomes part of a path."""
    r = table(s, d, "documents").where("repo_key IS NOT NULL").select(F.col("repo_key").alias("name")).distinct()
    valid = F.col("name").rlike(FIGURE_NAME)
    return r.select("name", valid.alias("valid"), F.when(valid, F.concat(F.lit("figures/v1/"), "name")).alias("id"))


# --- contracts -------------------------------------------------------------------------------


def _findings(s: SparkSession, d: str) -> DataFrame:
    """Findings-like rows from the label log, with all their faults."""
    r = table(s, d, "label_event")
    return r.select(
        "label_id", F.col("annotator").alias("key"), (F.col("elapsed_ms") / 1000).alias("value"), F.lit(None).cast("string").alias("value_text"), F.when(F.col("label_id") % 2 == 0, "proportion").otherwise(F.col("note")).alias("unit"),
        F.col("elapsed_ms").alias("n"), F.col("decision").alias("computed_by"), F.substring("submitted_at", 1, 10).alias("computed_at"), F.col("item_id").alias("source_snapshot"), F.when(F.col("label_id") % 5 == 0, F.col("note")).alias("scale_exempt_reason"),
    )


_DATE = "(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({c} AS DATE) IS NOT NULL)"


@query(
    "WITH f AS (SELECT DISTINCT label_id, annotator k, elapsed_ms / 1000 v, CASE WHEN label_id % 2 = 0 THEN 'proportion' ELSE note END u, elapsed_ms n, decision b, substr(submitted_at, 1, 10) made, item_id i, CASE WHEN label_id % 5 = 0 THEN note END x FROM label_event), "
    "g AS (SELECT *, trim(regexp_replace(lower(u), '([^[:word:]%]|_)+', ' ', 'g')) un FROM f), h AS (SELECT *, CASE WHEN un = 'pp' OR contains(un, 'percent') OR contains(un, 'per cent') OR contains(un, 'pct') OR contains(un, '%') OR contains(un, 'percentage point') THEN 'percent' WHEN contains(un, 'proportion') OR contains(un, 'fraction') THEN 'proportion' END fam FROM g) "
    "SELECT codes, count(*) n FROM (SELECT concat_ws('|', CASE WHEN NOT coalesce(regexp_full_match(k, '[a-z0-9_]+'), false) THEN 'key' END, CASE WHEN v IS NULL THEN 'value' END, CASE WHEN coalesce(trim(u) = '', true) THEN 'unit' END, CASE WHEN coalesce(n < 0, true) THEN 'n' END, CASE WHEN coalesce(trim(b) = '', true) THEN 'computed_by' END, "
    f"CASE WHEN NOT coalesce({_DATE.format(c='made')}, false) THEN 'computed_at' END, CASE WHEN coalesce(trim(i) = '', true) THEN 'source_snapshot' END, CASE WHEN trim(x) = '' THEN 'exempt' END, CASE WHEN x IS NULL AND v IS NOT NULL AND ((fam = 'percent' AND abs(v) > 0 AND abs(v) <= 1) OR (fam = 'proportion' AND abs(v) > 1)) THEN 'scale' END) codes FROM h) GROUP BY codes"
)
def finding_contract(s: SparkSession, d: str) -> DataFrame:
    """All rules of the findings contract: how many rows break which of them together."""
    r = contracts.finding_codes(_findings(s, d).distinct())
    return r.groupBy(F.array_join("codes", "|").alias("codes")).agg(F.count("*").alias("n"))


@query(
    "SELECT codes, count(*) n FROM (SELECT concat_ws('|', CASE WHEN coalesce(trim(llm_model) = '', true) THEN 'script' END, CASE WHEN coalesce(trim(item_id) = '', true) THEN 'source_snapshot' END, CASE WHEN coalesce(trim(llm_assessment) = '', true) THEN 'query' END, CASE WHEN coalesce(trim(run_id) = '', true) THEN 'run_id' END, "
    f"CASE WHEN candidates IS NULL THEN 'rows_in' END, CASE WHEN NOT coalesce({_DATE.format(c='substr(created_at, 1, 10)')}, false) THEN 'run_at' END) codes FROM proposal) GROUP BY codes"
)
def provenance_contract(s: SparkSession, d: str) -> DataFrame:
    """All rules of the provenance contract over the first-pass runs."""
    n = F.when(F.col("candidates").isNotNull(), F.size("candidates"))
    r = table(s, d, "proposal").select(F.col("llm_model").alias("script"), F.col("item_id").alias("source_snapshot"), F.col("llm_assessment").alias("query"), n.alias("rows_in"), F.coalesce(n, F.lit(0)).alias("rows_out"), "run_id", F.substring("created_at", 1, 10).alias("run_at"))
    return contracts.provenance_codes(r).groupBy(F.array_join("codes", "|").alias("codes")).agg(F.count("*").alias("n"))


def _drafts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("In "), F.col("n_name"), F.lit(" we saw {{f.k_"), k, F.lit("}} | of\nall. Then {{f.k_"), k, F.lit("}} fell to {{f.absent}}!\n\nNo figure here."))
    return table(s, d, "nation").select(F.col("n_name").alias("draft"), text.alias("text"))


@query(
    "WITH f AS (SELECT 'k_' || event_id AS key, round(value, 4) AS value, 'ratio' unit, 1::BIGINT n, substr(sha256(props), 1, 12) snapshot, event_type script FROM events), n AS (SELECT n_name draft, 'k_' || n_nationkey AS k FROM nation), "
    "c AS (SELECT draft, 0 AS pos, 0 AS spot, k AS key, 'In ' || draft || ' we saw {{f.' || k || '}} \\| of all.' sentence FROM n UNION ALL SELECT draft, 1, 0, k, 'Then {{f.' || k || '}} fell to {{f.absent}}!' FROM n UNION ALL SELECT draft, 1, 1, 'absent', 'Then {{f.' || k || '}} fell to {{f.absent}}!' FROM n) "
    "SELECT draft, pos::BIGINT AS pos, spot::BIGINT AS \"at\", key, value, unit, n, snapshot, script, sentence FROM c LEFT JOIN f USING (key)"
)
def claims_rows(s: SparkSession, d: str) -> DataFrame:
    """The claims register: every placeholder of a draft in order, its finding, and the sentence that holds it."""
    f = table(s, d, "events").select(F.concat(F.lit("k_"), F.col("event_id").cast("string")).alias("key"), F.round("value", 4).alias("value"), F.lit("ratio").alias("unit"), F.lit(1).cast("bigint").alias("n"), F.sha2("props", 256).alias("source_snapshot"), F.col("event_type").alias("computed_by"))
    r = contracts.claims(_drafts(s, d), f)
    return r.select("draft", F.col("pos").cast("bigint").alias("pos"), F.col("at").cast("bigint").alias("at"), "key", "value", "unit", "n", "snapshot", "script", "sentence")


# --- replies -----------------------------------------------------------------------------------


def json_span(text: Column) -> Column:
    """The JSON object of a reply: what a code fence holds, else all between the outermost braces; NULL for none."""
    fenced = F.regexp_extract(text, FENCE, 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    span = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(span != "", span)


def _replies(s: SparkSession, d: str) -> DataFrame:
    """(item_id, reply, pool): replies as a model words them, in a fence or in prose, over the pool of a proposal.

    They propose the pool's candidates by turns, one twice, one whose id is outside, confidences beyond
    1 and in words, and blank reasons.
    """
    p = V.candidates(s, d).where("rank <= 3").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rid", "match_score"))).alias("c"))
    a = table(s, d, "proposal").where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("llm_assessment").alias("assessment"))
    one = lambda rid, conf, why: F.concat(F.lit('{"ror_id": "'), rid, F.lit('", "confidence": '), conf, F.lit(', "justification": '), why, F.lit("}"))
    conf = lambda c: F.when(c["rank"] == 2, F.lit('"high"')).when(c["rank"] == 3, F.lit("1.5")).otherwise(F.lit("0.25"))
    said = F.concat(F.transform("c", lambda c: one(c["rid"], conf(c), F.when(c["rank"] == 2, F.lit('" "')).otherwise(F.lit('"named"')))), F.array(one(F.lit("0zzzzzz99"), F.lit("0.5"), F.lit("null")), one(F.col("c")[0]["rid"], F.lit("-2"), F.lit('"again"'))))
    obj = F.concat(F.lit('{"assessment": "'), F.coalesce("assessment", F.lit("unsure")), F.lit('", "proposals": ['), F.array_join(said, ", "), F.lit("]}"))
    fence = F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nDone {so}."))
    reply = F.when(F.length("item_id") % 2 == 0, fence).otherwise(F.concat(F.lit("Sure. "), obj, F.lit(" Bye.")))
    return p.join(a, "item_id").select("item_id", reply.alias("reply"), F.transform("c", lambda c: c["rid"]).alias("pool"))


_POOL = "SELECT item_id, list(rid ORDER BY rank, rid, match_score NULLS FIRST) pool, list(rank ORDER BY rank, rid, match_score NULLS FIRST) ranks FROM cand WHERE rank <= 3 GROUP BY item_id"


@query(
    f"WITH p AS ({_POOL}), a AS (SELECT item_id, min(llm_assessment) assessment FROM proposal WHERE item_id IS NOT NULL GROUP BY 1), r AS (SELECT item_id, unnest(pool) rid, unnest(ranks) rank, generate_subscripts(pool, 1) k, pool[1] head FROM p), "
    "x AS (SELECT DISTINCT item_id, rid, last_value(conf) OVER w confidence, last_value(why) OVER w reason FROM (SELECT item_id, rid, k, CASE rank WHEN 2 THEN NULL WHEN 3 THEN 1.0 ELSE 0.25 END conf, CASE rank WHEN 2 THEN NULL ELSE 'named' END why FROM r UNION ALL SELECT DISTINCT item_id, head, 99, 0.0, 'again' FROM r) WINDOW w AS (PARTITION BY item_id, rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) "
    "SELECT x.item_id, coalesce(a.assessment, 'unsure') assessment, x.rid, x.confidence::DOUBLE confidence, x.reason FROM x JOIN a USING (item_id)"
)
def reply_parse(s: SparkSession, d: str) -> DataFrame:
    """Proposals of replies, applied to their pools.

    The object is cut out of fence or prose, ids outside the pool drop, of an id proposed twice the
    last counts, confidences are clamped and such in words are none, blank reasons are none.
    """
    r = _replies(s, d).select("item_id", "pool", F.from_json(json_span(F.col("reply")), "assessment string, proposals array<struct<ror_id:string,confidence:string,justification:string>>").alias("o"))
    each = r.select("item_id", "pool", "o.assessment", F.posexplode("o.proposals").alias("pos", "p")).where(F.array_contains("pool", F.col("p.ror_id")))
    number = F.expr("try_cast(p.confidence AS double)")
    conf = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
    last = each.groupBy("item_id", "assessment", F.col("p.ror_id").alias("rid")).agg(F.max(F.struct("pos", conf.alias("confidence"), F.when(F.trim("p.justification") != "", F.col("p.justification")).alias("reason"))).alias("v"))
    return last.select("item_id", "assessment", "rid", "v.confidence", "v.reason")


@query("SELECT DISTINCT response_id, regexp_extract(payload, '(?s)(\\{.*\\})', 1) <> '' found, md5(nullif(regexp_extract(payload, '(?s)(\\{.*\\})', 1), '')) AS md5 FROM raw_response WHERE payload IS NOT NULL AND NOT contains(payload, '```')")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    """The object that a received text holds between its outermost braces, whatever stands around it."""
    r = table(s, d, "raw_response").where(F.col("payload").isNotNull() & ~F.col("payload").contains("```")).select("response_id", json_span(F.col("payload")).alias("span"))
    return r.select("response_id", F.col("span").isNotNull().alias("found"), F.md5("span").alias("md5")).distinct()


@query(
    "WITH i AS (SELECT label_id, unnest(ids) rid FROM live), k AS (SELECT label_id, count(*) FILTER (WHERE status IS NULL) absent, count(*) FILTER (WHERE status <> 'active') dead FROM i LEFT JOIN org USING (rid) GROUP BY 1), x AS (SELECT decision, ids, coalesce(absent, 0) absent, coalesce(dead, 0) dead FROM live LEFT JOIN k USING (label_id)) "
    "SELECT decision, CASE WHEN decision NOT IN ('accepted', 'corrected', 'ambiguous', 'no_ror') THEN 'decision' WHEN decision IN ('accepted', 'corrected') AND len(ids) = 0 THEN 'no_ids' WHEN decision IN ('ambiguous', 'no_ror') AND len(ids) > 0 THEN 'ids_given' WHEN absent > 0 THEN 'outside' WHEN dead > 0 THEN 'inactive' ELSE 'ok' END gate, count(*) n FROM x GROUP BY ALL"
)
def label_gates(s: SparkSession, d: str) -> DataFrame:
    """The first gate, in order, that each live label fails: its decision, its ids, the release, their status."""
    live = V.live_labels(s, d).select("label_id", "decision", "ids")
    org = V.org(s, d).select("rid", "status")
    known = live.select("label_id", F.explode("ids").alias("rid")).join(org, "rid", "left").groupBy("label_id").agg(F.bool_or(F.col("status").isNull()).alias("absent"), F.bool_or(F.col("status") != "active").alias("dead"))
    j = live.join(known, "label_id", "left")
    resolved = F.col("decision").isin("accepted", "corrected")
    gate = (
        F.when(~resolved & ~F.col("decision").isin("ambiguous", "no_ror"), "decision").when(resolved & (F.size("ids") == 0), "no_ids").when(~resolved & (F.size("ids") > 0), "ids_given")
        .when(F.col("absent"), "outside").when(F.col("dead"), "inactive").otherwise("ok")
    )
    return j.groupBy("decision", gate.alias("gate")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements(_SQL)
