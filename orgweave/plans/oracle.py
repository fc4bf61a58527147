"""Oracle SQL: what each query must return, written for DuckDB over the stored tables.

The statements share common table expressions; ``statements()`` puts in front of each query
only those that it needs, in order.
"""

from __future__ import annotations

import re


def bare(x: str) -> str:
    b = f"regexp_replace(lower(trim({x})), '^(https://ror\\.org/|http://ror\\.org/|ror\\.org/)', '')"
    return f"(CASE WHEN regexp_matches({b}, '^0[a-hj-km-np-tv-z0-9]{{6}}[0-9]{{2}}$') THEN {b} END)"


def bare_list(x: str) -> str:
    return f"coalesce(list_sort(list_distinct(list_filter(list_transform({x}, lambda z: {bare('z')}), lambda z: z IS NOT NULL))), []::VARCHAR[])"


def cat(x: str) -> str:
    return f"regexp_replace(lower(trim({x})), '[\\s_\\-]+', '_', 'g')"


_SETS = " UNION ALL ".join(f"SELECT ror_id a, '{t}' t, unnest({t}) b FROM relationship_sets" for t in ("parent", "child", "related", "predecessor", "successor"))

#: Shared expressions by name; a statement pulls in those whose name it mentions.
CTES: dict[str, str] = {
    "rec": f"SELECT * EXCLUDE (rn) FROM (SELECT *, {bare('id')} rid, row_number() OVER (PARTITION BY {bare('id')} ORDER BY admin.last_modified.date DESC NULLS LAST, status, established NULLS FIRST) rn FROM ror_record WHERE {bare('id')} IS NOT NULL) WHERE rn = 1",
    "org": "SELECT rid, status, established, list_filter(names, lambda n: list_contains(n.types, 'ror_display'))[-1].value AS name, locations[1].geonames_details.name AS city, coalesce(locations[1].geonames_details.country_name, locations[1].geonames_details.country_code) AS country FROM rec",
    "stated": f"SELECT org_id a, rel_type t, ror_id b FROM org_relationship UNION ALL {_SETS} UNION ALL SELECT id, r.type, r.id FROM (SELECT id, unnest(relationships) r FROM ror_record)",
    "edges": f"SELECT DISTINCT {bare('a')} src, lower(trim(t)) rel, {bare('b')} dst FROM stated WHERE {bare('a')} IS NOT NULL AND {bare('b')} IS NOT NULL AND lower(trim(t)) IN ('parent', 'child', 'related', 'predecessor', 'successor')",
    "oneway": "SELECT CASE WHEN rel IN ('child', 'predecessor') THEN dst ELSE src END a, CASE WHEN rel IN ('parent', 'child') THEN 'parent' WHEN rel IN ('successor', 'predecessor') THEN 'successor' ELSE 'related' END rel, CASE WHEN rel IN ('child', 'predecessor') THEN src ELSE dst END b FROM edges",
    "sym": "SELECT a, rel, b FROM oneway UNION SELECT b, rel, a FROM oneway WHERE rel = 'related'",
    "walk": "SELECT a AS old, b AS nw, 1 AS steps FROM sym WHERE rel = 'successor' AND a <> b UNION SELECT w.old, s.b, w.steps + 1 FROM walk w JOIN sym s ON s.rel = 'successor' AND s.a = w.nw WHERE w.steps < 48 AND s.b <> w.old",
    "chain": "SELECT old, nw, min(steps) steps FROM walk GROUP BY ALL",
    "climb": "SELECT a AS low, b AS high, 1 AS depth FROM sym WHERE rel = 'parent' UNION SELECT c.low, s.b, c.depth + 1 FROM climb c JOIN sym s ON s.rel = 'parent' AND s.a = c.high WHERE c.depth < 5",
    "anc": "SELECT low, high, min(depth) depth FROM climb GROUP BY ALL",
    "newest": "SELECT item_id, annotator, max(label_id) label_id FROM label_event WHERE item_id IS NOT NULL AND annotator IS NOT NULL GROUP BY ALL",
    "live": f"SELECT DISTINCT l.item_id, l.annotator, l.label_id, l.decision, {bare_list('l.ror_ids')} ids, l.elapsed_ms FROM label_event l JOIN newest USING (item_id, annotator, label_id) WHERE NOT l.superseded AND l.decision <> 'skipped'",
    "gold": "SELECT item_id, decision, CASE WHEN decision IN ('accepted', 'corrected') THEN ids ELSE []::VARCHAR[] END ids FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY label_id DESC) rn FROM live) WHERE rn = 1 AND (decision NOT IN ('accepted', 'corrected') OR len(ids) > 0)",
    "prop": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC NULLS LAST, run_id NULLS FIRST, len(candidates) DESC NULLS LAST) rn FROM proposal WHERE item_id IS NOT NULL) WHERE rn = 1",
    "cand": f"SELECT item_id, rank, {bare('c.ror_id')} rid, c.name AS name, c.aliases AS aliases, c.acronyms AS acronyms, c.city AS city, c.country AS country, c.org_types AS org_types, c.match_score AS match_score, c.llm_confidence AS llm_confidence, c.llm_justification AS llm_justification, c.llm_proposed AS llm_proposed FROM (SELECT item_id, unnest(candidates) c, generate_subscripts(candidates, 1) rank FROM prop) WHERE {bare('c.ror_id')} IS NOT NULL",
    "assign": "SELECT item_id, 'matcher' source, rid FROM cand WHERE match_score >= 0.9 UNION SELECT item_id, 'proposer', rid FROM cand WHERE llm_proposed UNION SELECT item_id, 'ranker', rid FROM cand WHERE rank = 1",
    "integrity": "SELECT g.item_id, g.rid, coalesce(o.status, 'absent') status, coalesce((SELECT string_agg(b, '|' ORDER BY b) FROM (SELECT DISTINCT b FROM sym WHERE rel = 'successor' AND a = g.rid)), '') successors FROM (SELECT item_id, unnest(ids) rid FROM gold) g LEFT JOIN org o USING (rid) WHERE o.status IS NULL OR o.status <> 'active'",
    "frame": "SELECT g.item_id, s.source, g.decision, g.ids gold_ids FROM gold g CROSS JOIN (VALUES ('matcher'), ('proposer'), ('ranker')) s(source) WHERE g.item_id IN (SELECT item_id FROM proposal) AND g.item_id NOT IN (SELECT item_id FROM integrity)",
    "pairs": "SELECT f.item_id, f.source, a.rid assigned, f.gold, f.gi FROM (SELECT item_id, source, unnest(gold_ids) gold, generate_subscripts(gold_ids, 1) - 1 gi FROM frame WHERE decision IN ('accepted', 'corrected')) f JOIN assign a USING (item_id, source)",
    "rels": "SELECT p.*, CASE WHEN assigned = gold THEN 'exact' WHEN EXISTS (SELECT 1 FROM sym WHERE rel = 'parent' AND a = gold AND b = assigned) THEN 'parent_of_gold' WHEN EXISTS (SELECT 1 FROM sym WHERE rel = 'parent' AND a = assigned AND b = gold) THEN 'child_of_gold' WHEN EXISTS (SELECT 1 FROM chain WHERE old = assigned AND nw = gold) THEN 'predecessor_of_gold' WHEN EXISTS (SELECT 1 FROM chain WHERE old = gold AND nw = assigned) THEN 'successor_of_gold' WHEN EXISTS (SELECT 1 FROM sym WHERE rel = 'related' AND a = assigned AND b = gold) THEN 'related' WHEN assigned NOT IN (SELECT rid FROM org) THEN 'not_in_dump' ELSE 'none' END relation, assigned IN (SELECT rid FROM org WHERE status = 'active') active, EXISTS (SELECT 1 FROM chain WHERE old = assigned AND nw = gold) chained FROM pairs p",
    "rules": "SELECT * FROM (VALUES ('exact', 'exact'), ('parent_child', 'exact'), ('parent_child', 'parent_of_gold'), ('parent_child', 'child_of_gold'), ('any_relationship', 'exact'), ('any_relationship', 'parent_of_gold'), ('any_relationship', 'child_of_gold'), ('any_relationship', 'related')) t(rule, accepts)",
    "sides": "SELECT item_id, source, assigned, row_number() OVER (PARTITION BY item_id, source ORDER BY assigned) - 1 ai, bool_or(NOT active AND chained) stale FROM rels GROUP BY item_id, source, assigned",
    "masks": "SELECT s.item_id, s.source, k.rule, s.ai, s.stale, coalesce(bit_or(CASE WHEN r.active AND u.accepts IS NOT NULL THEN (1::BIGINT << r.gi) ELSE 0 END), 0) nm FROM sides s CROSS JOIN (SELECT DISTINCT rule FROM rules) k JOIN rels r ON r.item_id = s.item_id AND r.source = s.source AND r.assigned = s.assigned LEFT JOIN rules u ON u.rule = k.rule AND u.accepts = r.relation GROUP BY ALL",
    "subsets": "SELECT m.item_id, m.source, m.rule, b.s, bit_count(coalesce(bit_or(CASE WHEN (b.s >> m.ai) & 1 = 1 THEN m.nm ELSE 0 END), 0)) - bit_count(b.s) def FROM masks m JOIN (SELECT item_id, source, rule, unnest(range(0, (1 << count(*)::INT)::BIGINT)) s FROM masks GROUP BY item_id, source, rule) b USING (item_id, source, rule) GROUP BY m.item_id, m.source, m.rule, b.s",
    "sized": "SELECT x.item_id, x.source, x.rule, x.n + d.low m, x.ungrounded, x.all_stale FROM (SELECT item_id, source, rule, count(*) n, sum((nm = 0)::INT) ungrounded, bool_and(stale) all_stale FROM masks GROUP BY ALL) x JOIN (SELECT item_id, source, rule, min(def) low FROM subsets GROUP BY ALL) d USING (item_id, source, rule)",
    "scored": "SELECT f.item_id, f.source, k.rule, f.decision, len(f.gold_ids) g, coalesce(c.a, 0) a, z.m, z.ungrounded, z.all_stale FROM frame f CROSS JOIN (SELECT DISTINCT rule FROM rules) k LEFT JOIN (SELECT item_id, source, count(*) a FROM assign GROUP BY ALL) c USING (item_id, source) LEFT JOIN sized z ON z.item_id = f.item_id AND z.source = f.source AND z.rule = k.rule",
    "scores": "SELECT item_id, source, rule, CASE WHEN decision = 'ambiguous' THEN 'gold_ambiguous' WHEN decision = 'no_ror' THEN 'gold_no_ror' WHEN a = 0 THEN 'no_assignment' WHEN ungrounded = 0 AND m < g THEN 'collapsed' WHEN ungrounded = 0 AND a > g THEN 'over_assigned' WHEN ungrounded = 0 THEN 'correct' WHEN m = 0 AND all_stale THEN 'stale' WHEN m > 0 THEN 'partial' ELSE 'wrong' END outcome, CASE WHEN decision NOT IN ('ambiguous', 'no_ror') AND a > 0 THEN m WHEN decision = 'no_ror' AND a > 0 THEN 0 END::BIGINT tp, CASE WHEN decision NOT IN ('ambiguous', 'no_ror') AND a > 0 THEN a - m WHEN decision = 'no_ror' AND a > 0 THEN a END::BIGINT fp, CASE WHEN decision NOT IN ('ambiguous', 'no_ror') AND a > 0 THEN g - m WHEN decision = 'no_ror' AND a > 0 THEN 0 END::BIGINT fn, a::BIGINT assigned, g::BIGINT gold FROM scored",
    "strata": f"SELECT item_id, coalesce(min({cat('stratum')}), 'unknown') stratum FROM item WHERE item_id IS NOT NULL GROUP BY item_id",
    "rawtext": "SELECT DISTINCT raw_affiliation raw FROM item WHERE raw_affiliation IS NOT NULL",
    "micro": "SELECT source, rule, sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn, count(*) items FROM scores WHERE tp IS NOT NULL GROUP BY ALL",
    "prf": "SELECT source, rule, coalesce(stratum, 'all') stratum, sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn, count(*) items FROM scores JOIN strata USING (item_id) WHERE tp IS NOT NULL GROUP BY GROUPING SETS ((source, rule, stratum), (source, rule))",
    "prff": "SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 FROM prf",
    "okey": "SELECT item_id, annotator, CASE WHEN decision IN ('ambiguous', 'no_ror') THEN decision ELSE 'ror:' || array_to_string(ids, '|') END o FROM live",
    "pairann": "SELECT p.item_id, p.annotator a, q.annotator b, p.o x, q.o y FROM okey p JOIN okey q ON p.item_id = q.item_id AND p.annotator < q.annotator",
    "kap": "SELECT a, b, stratum, x, y FROM pairann JOIN strata USING (item_id)",
    "clu": "SELECT g.ids[1] gold, f.found FROM gold g JOIN (SELECT item_id, min(rid) found FROM assign WHERE source = 'ranker' GROUP BY item_id) f USING (item_id) WHERE len(g.ids) = 1",
    "cont": "SELECT gold, found, count(*) n, sum(count(*)) OVER (PARTITION BY gold) gn, sum(count(*)) OVER (PARTITION BY found) fn FROM clu GROUP BY gold, found",
    "units": "SELECT 'k_' || event_id AS key, round(CASE WHEN event_id % 3 = 0 THEN value / 100 ELSE value END, 4) AS value, ['Per-Cent', 'per_cent', 'pp', 'proportion', 'Fraction of items', 'count', 'percentage point', 'kappa', '%', 'ratio'][(event_id % 10 + 1)::INT] unit, CASE WHEN event_id % 50 = 0 THEN 'small by design' END exempt FROM events",
    "fam": "SELECT *, trim(regexp_replace(lower(unit), '([^[:word:]%]|_)+', ' ', 'g')) normal FROM units",
    "famy": "SELECT *, CASE WHEN normal = 'pp' OR contains(normal, 'percent') OR contains(normal, 'per cent') OR contains(normal, 'pct') OR contains(normal, '%') THEN 'percent' WHEN contains(normal, 'proportion') OR contains(normal, 'fraction') THEN 'proportion' END family FROM fam",
    "ext": "SELECT rid, e.type scheme, e FROM (SELECT rid, unnest(external_ids) e FROM rec) WHERE e IS NOT NULL AND e.type IS NOT NULL",
    "extid": "SELECT DISTINCT scheme, v, rid FROM (SELECT rid, scheme, unnest(list_append(coalesce(e.all, []::VARCHAR[]), e.preferred)) v FROM ext) WHERE v IS NOT NULL",
    "xwalk": "SELECT scheme, v AS value, string_agg(rid, '|' ORDER BY rid) rids, count(*) n FROM extid GROUP BY ALL",
    "redact": "SELECT item_id, texts FROM (SELECT DISTINCT item_id, list_prepend(raw_affiliation, coalesce(context.coauthor_affiliations, []::VARCHAR[])) texts FROM item WHERE item_id IS NOT NULL)",
}
RECURSIVE = {"walk", "climb"}
_MAIL = "[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})"
_B, _E = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
_HOSPITAL = f"(?i){_B}(hospital|hospitals|clinic|clinique|klinik|klinikum|infirmary|medical cent(?:er|re)|health system|nhs trust|hôpital|hopital|ospedale|sjukhus|ziekenhuis){_E}|병원|病院|医院"
_GOVERNMENT = f"(?i){_B}(national (?:institute|laborator|research)|ministry|research council|cnrs|csic|max.planck|helmholtz|fraunhofer|academy of sciences|national academy|government|federal (?:institute|agency)){_E}|中国科学院"
_COMPANY = f"(?i){_B}(inc\\.?|ltd\\.?|llc|gmbh|s\\.?a\\.?s\\.?|b\\.?v\\.?|pty|corp\\.?|corporation|pharmaceuticals?|biotech|technologies|co\\.,? ltd){_E}"
_INSTITUTION = f"(?i){_B}(university|université|universität|universidad|universidade|college|institute|instituto|institut|hospital|academy){_E}"


def _count(x: str, rx: str) -> str:
    return f"len(regexp_extract_all({x}, '{rx}'))"


def _multi(x: str) -> str:
    spaced = f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    return f"((regexp_matches({x}, '^\\s*1[.)]') AND regexp_matches({x}, '[;\\n]\\s*2[.)]')) OR ({_count(spaced, _INSTITUTION)} >= 2 AND contains({x}, ';')))"


_SCRIPT = {"chinese": "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]", "japanese": "[\\x{3041}-\\x{3096}\\x{309D}-\\x{309F}\\x{30A1}-\\x{30FA}\\x{30FC}-\\x{30FF}]", "korean": "[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}]", "russian_cyrillic": "[\\x{0400}-\\x{0481}\\x{048A}-\\x{04FF}]", "arabic": "[\\x{0620}-\\x{064A}\\x{066E}\\x{066F}\\x{0671}-\\x{06D3}\\x{06D5}\\x{06E5}\\x{06E6}\\x{06EE}\\x{06EF}\\x{06FA}-\\x{06FC}\\x{06FF}\\x{0750}-\\x{077F}]", "thai": "[\\x{0E01}-\\x{0E30}\\x{0E32}\\x{0E33}\\x{0E40}-\\x{0E46}]"}
_LATINRX = "[A-Za-z\\x{00AA}\\x{00B5}\\x{00BA}\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}]"
_N = {k: _count("raw", rx) for k, rx in _SCRIPT.items()}
_FIRST = {k: f"CASE WHEN {_N[k]} > 0 THEN strpos(raw, regexp_extract(raw, '{rx}')) ELSE 0 END" for k, rx in _SCRIPT.items()}
_KANA = f"({_N['japanese']} > 0 AND {_N['chinese']} > 0)"
_SCRIPTROWS = " UNION ALL ".join(
    f"SELECT raw, '{k}' k, " + (f"CASE WHEN {_KANA} THEN {_N['japanese']} + {_N['chinese']} ELSE {_N[k]} END" if k == "japanese" else f"CASE WHEN {_KANA} THEN 0 ELSE {_N[k]} END" if k == "chinese" else _N[k]) + f" n, {_FIRST[k]} p FROM rawtext"
    for k in _SCRIPT
)
_TOTAL = " + ".join(_N.values())
_SCRIPTSQL = f"SELECT raw, k AS script FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY n DESC, p) rn FROM ({_SCRIPTROWS}) WHERE n > 0) JOIN (SELECT raw, {_TOTAL} AS total, {_count('raw', _LATINRX)} AS latin FROM rawtext) USING (raw) WHERE rn = 1 AND total > latin"

QUERIES: dict[str, str] = {
    "id_normalise": f"SELECT DISTINCT raw, 'https://ror.org/' || {bare('raw')} ror_id FROM (SELECT org_id raw FROM org_relationship UNION SELECT ror_id FROM org_relationship)",
    "id_normalise_set": "SELECT DISTINCT 'https://ror.org/' || " + bare("ror_id") + " ror_id, array_to_string(list_transform(" + bare_list("related") + ", lambda z: 'https://ror.org/' || z), '|') related FROM relationship_sets WHERE len(" + bare_list("related") + ") > 0",
    "org_load": "SELECT rid, status, established::BIGINT established, name, city, country FROM org",
    "org_lookup": f"SELECT rid, name, status FROM org WHERE rid IN (SELECT {bare('i.organization.id')} FROM (SELECT unnest(items) i FROM matcher_response))",
    "org_summary": "SELECT 'status:' || status what, count(*) n FROM org GROUP BY ALL UNION ALL SELECT 'edge:' || lower(trim(r.type)), count(*) FROM (SELECT unnest(relationships) r FROM rec) GROUP BY ALL",
    "duplicate_records": f"SELECT {bare('id')} rid, count(*) n FROM ror_record GROUP BY 1 HAVING count(*) > 1",
    "candidate_parse": "WITH u AS (SELECT *, list_filter(names, lambda n: n.value IS NOT NULL) nn FROM rec), v AS (SELECT *, list_filter(nn, lambda n: list_contains(n.types, 'ror_display')) sh, list_transform(list_filter(nn, lambda n: list_contains(n.types, 'acronym') AND NOT list_contains(n.types, 'ror_display')), lambda n: n.value) ac, list_transform(list_filter(nn, lambda n: NOT list_contains(n.types, 'acronym') AND NOT list_contains(n.types, 'ror_display')), lambda n: n.value) al FROM u) SELECT rid, coalesce(sh[-1].value, list_concat(al, ac)[1]) AS name, array_to_string(al, '|') aliases, array_to_string(ac, '|') acronyms, locations[1].geonames_details.name AS city, coalesce(locations[1].geonames_details.country_name, locations[1].geonames_details.country_code) AS country, coalesce(len(list_filter(relationships, lambda x: x.type IS NOT NULL AND x.label IS NOT NULL AND x.id IS NOT NULL)), 0)::BIGINT relationships FROM v",
    "latest_by": "SELECT item_id, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') last_seen, count(*) \"rows\" FROM item WHERE item_id IS NOT NULL GROUP BY item_id",
    "instance_explode": "SELECT DISTINCT item_id, doi, (generate_subscripts(o, 1) - 1)::BIGINT pos, unnest(o) AS other FROM (SELECT DISTINCT item_id, context.doi doi, list_filter(context.coauthor_affiliations, lambda x: trim(x) <> trim(raw_affiliation) AND trim(x) <> '')[1:4] o FROM item WHERE context IS NOT NULL AND item_id IS NOT NULL)",
    "item_key": "SELECT raw_affiliation, doi, substr(sha256(doi || '|' || raw_affiliation), 1, 16) AS key FROM (SELECT DISTINCT raw_affiliation, coalesce(context.doi, 'None') doi FROM item WHERE raw_affiliation IS NOT NULL)",
    "json_scan": "SELECT event_id, k, json_extract_string(props, '$.\"' || k || '\"') v FROM (SELECT event_id, props, unnest(json_keys(props)) k FROM events)",
    "script_detect": _SCRIPTSQL,
    "token_signals": f"SELECT raw, regexp_matches(raw, '{_HOSPITAL}') hospital, regexp_matches(raw, '{_GOVERNMENT}') government, regexp_matches(raw, '{_COMPANY}') company, {_multi('raw')} multi FROM rawtext",
    "multi_affil": f"SELECT raw FROM rawtext WHERE {_multi('raw')}",
    "redact_emails": f"SELECT md5(raw) raw_md5, regexp_replace(raw, '{_MAIL}', 'redacted@\\1', 'g') AS text, {_count('raw', _MAIL)}::BIGINT n FROM rawtext WHERE {_count('raw', _MAIL)} > 0",
    "redact_many": f"SELECT DISTINCT item_id, array_to_string(list_transform(texts, lambda x: regexp_replace(x, '{_MAIL}', 'redacted@\\1', 'g')), chr(10)) AS text, list_sum(list_transform(texts, lambda x: {_count('x', _MAIL)}))::BIGINT n FROM redact WHERE list_sum(list_transform(texts, lambda x: {_count('x', _MAIL)})) > 0",
    "stratum_route": f"SELECT stratum, count(*) n FROM (SELECT CASE WHEN s.script IS NOT NULL THEN 'non_latin_script' WHEN {_multi('r.raw')} THEN 'multi_affiliation' WHEN regexp_matches(r.raw, '{_HOSPITAL}') THEN 'hospital_medical' WHEN regexp_matches(r.raw, '{_GOVERNMENT}') THEN 'government_lab' WHEN regexp_matches(r.raw, '{_COMPANY}') THEN 'company' WHEN contains(lower(r.raw), 'university') OR contains(lower(r.raw), 'college') THEN 'anglophone_university' WHEN length(r.raw) > 10 THEN 'colliding_department' ELSE 'unrouted' END stratum FROM rawtext r LEFT JOIN ({_SCRIPTSQL}) s USING (raw)) GROUP BY ALL",
    "html_size_budget": "SELECT doc_id, strlen(text)::BIGINT bytes, strlen(text) <= 4000 AS within FROM documents WHERE text IS NOT NULL",
    "html_refs": "SELECT DISTINCT response_id, len(regexp_extract_all(p, 'https?://'))::BIGINT urls, len(regexp_extract_all(p, '[=\"''`(]//'))::BIGINT AS relative, len(regexp_extract_all(p, '@import'))::BIGINT imports, len(regexp_extract_all(p, '\\bfetch\\s*\\('))::BIGINT fetches FROM (SELECT response_id, regexp_replace(lower(payload), '\\\\(?:/|u002f|x2f)', '/', 'g') p FROM raw_response WHERE payload IS NOT NULL)",
    "unit_family": "SELECT key, unit, normal, family FROM famy",
    "scale_guard": "SELECT key, violation FROM (SELECT key, CASE WHEN exempt IS NOT NULL OR value IS NULL THEN NULL WHEN family = 'percent' AND abs(value) > 0 AND abs(value) <= 1 THEN 'proportion_as_percent' WHEN family = 'proportion' AND abs(value) > 1 THEN 'percent_as_proportion' END violation FROM famy) WHERE violation IS NOT NULL",
    "finding_validate": "SELECT codes, count(*) n FROM (SELECT concat_ws('|', CASE WHEN NOT regexp_full_match(k, '[a-z0-9_]+') THEN 'key' END, CASE WHEN n IS NULL OR n < 0 THEN 'n' END, CASE WHEN NOT coalesce(regexp_matches(submitted_at, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}'), false) THEN 'date' END, CASE WHEN trim(note) = '' THEN 'note' END) codes FROM (SELECT DISTINCT label_id, lower(annotator) k, note, elapsed_ms n, submitted_at FROM label_event)) GROUP BY codes",
    "placeholders": "SELECT n_nationkey::BIGINT n_nationkey, array_to_string(regexp_extract_all(t, '\\{\\{f\\.([a-z0-9_]+)\\}\\}', 1), '|') AS keys, replace(t, '{{f.region}}', r_name) AS filled, len(regexp_extract_all(t, '\\{\\{[^{}]*\\}\\}'))::BIGINT attempts FROM (SELECT n_nationkey, r_name, '{{f.' || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) || '}} in {{f.region}} and {{f.Bad}}' t FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "unreferenced_findings": "SELECT p_partkey::BIGINT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "snapshot_hash": "SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) digest, count(*) files FROM (SELECT DISTINCT coalesce(source, '') AS source, doc_id || ':' || sha256(text) line FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "color_scale": "SELECT step, '#' || printf('%02x%02x%02x', floor(255 - 255 * p + 0.5)::INT, floor(255 + (114 - 255) * p + 0.5)::INT, floor(255 + (178 - 255) * p + 0.5)::INT) colour FROM (SELECT range AS step, range / 8 AS p FROM range(0, 9))",
    "keyed_upsert": "SELECT o_custkey AS key, count(*) n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1 UNION ALL SELECT c_custkey, 0 FROM customer",
    "edge_sym": "SELECT a, rel, b FROM sym",
    "edge_counts": "SELECT rel, count(*) n, count(DISTINCT src) stating FROM edges GROUP BY rel",
    "succession_steps": "SELECT old, nw AS \"new\", steps::BIGINT steps FROM chain",
    "ancestry_distance": "SELECT low, high, depth::BIGINT depth FROM anc",
    "ancestry_hist": "SELECT depth::BIGINT depth, count(*) pairs FROM anc GROUP BY depth",
    "active_successors": "WITH RECURSIVE st AS (SELECT rid, status FROM org), hop AS (SELECT o.rid AS start, s.b AS node, 1 AS k FROM st o JOIN sym s ON s.rel = 'successor' AND s.a = o.rid WHERE o.status <> 'active' AND s.b <> o.rid UNION SELECT h.start, s.b, h.k + 1 FROM hop h JOIN st o ON o.rid = h.node AND o.status <> 'active' JOIN sym s ON s.rel = 'successor' AND s.a = h.node WHERE s.b <> h.start AND h.k < 48), reached AS (SELECT DISTINCT start, node FROM hop) SELECT r.start rid, coalesce(string_agg(node, '|' ORDER BY node) FILTER (WHERE o.status = 'active'), '') active, coalesce(string_agg(node, '|' ORDER BY node) FILTER (WHERE o.status <> 'active'), '') passed, coalesce(string_agg(node, '|' ORDER BY node) FILTER (WHERE o.status IS NULL), '') outside FROM reached r LEFT JOIN st o ON o.rid = r.node GROUP BY r.start",
    "superseded": "SELECT rid, status FROM org WHERE status <> 'active' AND rid IN (SELECT src FROM edges WHERE rel = 'successor')",
    "crosswalk": "SELECT scheme, value, rids, n FROM xwalk",
    "crosswalk_ambiguous": "SELECT scheme, count(*) ids, count(*) FILTER (WHERE n > 1) ambiguous FROM xwalk GROUP BY scheme",
    "labels_live": "SELECT item_id, annotator, label_id, decision, array_to_string(ids, '|') ids FROM live",
    "labels_undo": "SELECT annotator, count(*) n, max(label_id) newest FROM (SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY label_id DESC) k FROM live) WHERE k > 3 GROUP BY annotator",
    "outcome_key": "SELECT CASE WHEN decision IN ('ambiguous', 'no_ror') THEN decision ELSE 'ror:' || array_to_string(ids, '|') END outcome, count(*) n FROM live GROUP BY 1",
    "progress": "SELECT stratum, decision, n, round(ms / n, 4) mean_ms, (sum(n) OVER (PARTITION BY stratum))::BIGINT stratum_n, round(sum(ms) OVER (PARTITION BY stratum) / sum(n) OVER (PARTITION BY stratum), 4) stratum_mean_ms FROM (SELECT stratum, decision, count(*) n, sum(elapsed_ms)::DOUBLE ms FROM live JOIN strata USING (item_id) GROUP BY ALL)",
    "items_unlabelled": "SELECT item_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256(item_id)) place FROM strata WHERE item_id NOT IN (SELECT item_id FROM live)",
    "iaa_pairs": "SELECT item_id, a, b, x, y FROM pairann",
    "kappa": "WITH n AS (SELECT a, b, stratum, count(*) n, count(*) FILTER (WHERE x = y) same FROM kap GROUP BY ALL), mx AS (SELECT a, b, stratum, x AS cat, count(*) nx FROM kap GROUP BY ALL), my AS (SELECT a, b, stratum, y AS cat, count(*) ny FROM kap GROUP BY ALL), e AS (SELECT a, b, stratum, sum(nx * ny) exy FROM mx JOIN my USING (a, b, stratum, cat) GROUP BY ALL), k AS (SELECT n.*, n.same / n.n po, coalesce(e.exy, 0) / (n.n * n.n) pe FROM n LEFT JOIN e USING (a, b, stratum)) SELECT a, b, stratum, n, same, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 6) kappa FROM k",
    "decision_derive": "SELECT decision, CASE WHEN l.ids = coalesce(p.p, []::VARCHAR[]) THEN 'accepted' ELSE 'corrected' END derived, count(*) n FROM live l LEFT JOIN (SELECT item_id, list_sort(list_distinct(list(rid))) p FROM cand WHERE llm_proposed GROUP BY item_id) p USING (item_id) WHERE decision IN ('accepted', 'corrected') GROUP BY ALL",
    "ids_outside": "SELECT label_id, rid FROM (SELECT label_id, unnest(ids) rid FROM live) WHERE rid NOT IN (SELECT rid FROM org)",
    "within_release": "SELECT item_id, count(*) n FROM cand WHERE rid IN (SELECT rid FROM org) GROUP BY item_id",
    "gold_integrity": "SELECT item_id, rid, status, successors FROM integrity",
    "candidate_rank": "SELECT item_id, place, rid, match_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(match_score, 0) DESC, rank) place FROM cand) WHERE place <= 8",
    "prompt_build": "SELECT c.item_id, md5('Affiliation string: ' || r.raw || chr(10) || 'Candidate pool:' || chr(10) || c.pool) AS md5 FROM (SELECT item_id, string_agg('  ' || rank || '. ' || rid || ' ' || coalesce(name, '') || CASE WHEN len(aliases) > 0 THEN ' (aliases: ' || array_to_string(aliases[1:4], ', ') || ')' ELSE '' END || ' [' || coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(country, '')), ''), 'location unknown') || '; ' || CASE WHEN len(org_types) > 0 THEN array_to_string(org_types, ', ') ELSE 'type unknown' END || ']', chr(10) ORDER BY rank) pool FROM cand GROUP BY item_id) c JOIN (SELECT item_id, min(raw_affiliation) raw FROM item WHERE item_id IS NOT NULL GROUP BY item_id) r USING (item_id)",
    "proposal_apply": "SELECT item_id, rank::BIGINT rank, rid, CASE WHEN llm_confidence IS NOT NULL THEN least(greatest(llm_confidence, 0.0), 1.0) END confidence, CASE WHEN trim(llm_justification) <> '' THEN llm_justification END reason FROM cand WHERE llm_proposed",
    "pair_relations": "SELECT item_id, source, assigned, gold, relation, active, chained FROM rels",
    "rule_pairs": "SELECT item_id, source, assigned, gold, rule FROM rels JOIN rules ON relation = accepts WHERE active",
    "active_assigned": "SELECT source, coalesce(status, 'absent') status, count(*) n FROM assign LEFT JOIN org USING (rid) GROUP BY ALL",
    "stale_assigned": "SELECT DISTINCT item_id, source, assigned FROM rels WHERE NOT active AND chained",
    "ancestry_min": "SELECT item_id, source, min(CASE WHEN assigned = gold THEN 0 ELSE least(x.depth, y.depth) END)::BIGINT distance FROM rels LEFT JOIN anc x ON x.low = assigned AND x.high = gold LEFT JOIN anc y ON y.low = gold AND y.high = assigned GROUP BY item_id, source",
    "score_items": "SELECT * FROM scores",
    "bipartite_match": "SELECT item_id, source, rule, tp AS matched FROM scores WHERE tp IS NOT NULL AND gold > 0",
    "score_invariants": "SELECT item_id, source, rule, outcome FROM scores WHERE (tp IS NOT NULL AND (tp + fp <> assigned OR tp + fn <> gold OR tp < 0 OR fp < 0 OR fn < 0)) OR (outcome = 'correct' AND (fp <> 0 OR fn <> 0)) OR (outcome IN ('stale', 'wrong') AND tp <> 0) OR (outcome IN ('no_assignment', 'gold_ambiguous') AND tp IS NOT NULL)",
    "micro_counts": "SELECT * FROM micro",
    "prf_by_stratum": "SELECT * FROM prff",
    "coverage": "SELECT source, count(*) scorable, count(*) FILTER (WHERE assigned > 0) covered, round(count(*) FILTER (WHERE assigned > 0) / count(*), 6) coverage FROM scores WHERE rule = 'exact' AND outcome NOT IN ('gold_ambiguous', 'gold_no_ror') GROUP BY source",
    "outcome_rates": "SELECT source, rule, outcome, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY source, rule), 6) rate FROM scores GROUP BY source, rule, outcome",
    "stale_sensitivity": "SELECT source, rule, items, hits, stale, round(hits / items, 6) hit_rate, round((hits + stale) / items, 6) credited_rate FROM (SELECT source, rule, count(*) items, count(*) FILTER (WHERE outcome = 'correct') hits, count(*) FILTER (WHERE outcome = 'stale') stale FROM scores WHERE outcome NOT IN ('gold_ambiguous', 'gold_no_ror', 'no_assignment') GROUP BY ALL)",
    "relation_taxonomy": "SELECT source, relation, count(*) n FROM rels GROUP BY ALL",
    "rule_ranking": "SELECT rule, source, f1, rank() OVER (PARTITION BY rule ORDER BY f1 DESC NULLS LAST) place FROM (SELECT rule, source, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 FROM micro)",
    "losses_table": "SELECT stratum, rule, f1, best FROM (SELECT stratum, rule, source, f1, max(f1) OVER (PARTITION BY stratum, rule) best FROM prff) WHERE source = 'matcher' AND coalesce(f1, -1) < best",
    "blind_report": "SELECT letter, outcome, n, round(n / sum(n) OVER (PARTITION BY letter), 6) rate FROM (SELECT CASE source WHEN 'matcher' THEN 'A' WHEN 'proposer' THEN 'B' ELSE 'C' END letter, outcome, count(*) n FROM scores WHERE rule = 'exact' GROUP BY ALL)",
    "intersection_frame": "SELECT item_id FROM assign GROUP BY item_id HAVING count(DISTINCT source) = 3",
    "bcubed": "SELECT items, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) f1 FROM (SELECT sum(n)::BIGINT items, sum(n * n / fn) / sum(n) p, sum(n * n / gn) / sum(n) r FROM cont)",
    "pairwise_prf": "SELECT b::BIGINT AS \"both\", f::BIGINT AS found, g::BIGINT AS gold, round(b / nullif(f, 0), 6) AS precision, round(b / nullif(g, 0), 6) AS recall FROM (SELECT coalesce((SELECT sum(n * (n - 1) / 2) FROM cont), 0) b, coalesce((SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) k FROM clu GROUP BY found)), 0) f, coalesce((SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) k FROM clu GROUP BY gold)), 0) g)",
    "cluster_purity": "SELECT sum(n)::BIGINT items, sum(m)::BIGINT majority, round(sum(m) / sum(n), 6) purity FROM (SELECT found, max(n) m, sum(n) n FROM cont GROUP BY found)",
    "split_merge": "SELECT kind, parts, count(*) clusters FROM (SELECT 'split' kind, count(*) parts FROM cont GROUP BY gold UNION ALL SELECT 'merged', count(*) FROM cont GROUP BY found) GROUP BY ALL",
    "quota_cells": "WITH a AS (SELECT context.author_name author, count(DISTINCT item_id) n, count(DISTINCT context.venue) venues FROM item WHERE context.author_name IS NOT NULL GROUP BY 1), f AS (SELECT n, floor(coalesce(sum(count(*)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5 / sum(count(*)) OVER ())::BIGINT commonality FROM a GROUP BY n) SELECT commonality, CASE WHEN venues <= 1 THEN '1' WHEN venues <= 3 THEN '2-3' ELSE '4+' END mobility, count(*) authors FROM a JOIN f USING (n) GROUP BY ALL",
    "quota_sample": f"WITH r AS (SELECT item_id, min({cat('stratum')}) stratum, min(coalesce({cat('sub_stratum')}, '')) sub FROM item WHERE item_id IS NOT NULL AND stratum IS NOT NULL GROUP BY item_id), k AS (SELECT *, sha256(item_id) h, row_number() OVER (PARTITION BY stratum, sub ORDER BY sha256(item_id)) k FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, h) place FROM k) SELECT item_id, stratum, sub, place FROM p WHERE place <= 50",
    "stratum_shortfall": "SELECT t.stratum, t.target, coalesce(n.n, 0) n, greatest(t.target - coalesce(n.n, 0), 0) shortfall FROM (SELECT lower(stratum) stratum, sum(target_rows)::BIGINT target FROM strata_target GROUP BY 1) t LEFT JOIN (SELECT stratum, count(*) n FROM strata GROUP BY 1) n USING (stratum)",
}


def statements(queries: dict[str, str] | None = None) -> dict[str, str]:
    """Each query behind the shared expressions it mentions, directly or through others."""
    out = {}
    for name, body in (QUERIES if queries is None else queries).items():
        need: set[str] = set()
        todo = [body]
        while todo:
            text = todo.pop()
            for c in CTES:
                if c not in need and re.search(rf"\b(?:FROM|JOIN)\s+{c}\b", text):
                    need.add(c)
                    todo.append(CTES[c])
        if not need:
            out[name] = body
            continue
        head = ", ".join(f"{c} AS ({CTES[c]})" for c in CTES if c in need)
        rec = "RECURSIVE " if need & RECURSIVE or "WITH RECURSIVE" in body else ""
        inner = re.match(r"WITH (?:RECURSIVE )?", body)
        out[name] = f"WITH {rec}{head}, {body[inner.end():]}" if inner else f"WITH {rec}{head} {body}"
    return out
