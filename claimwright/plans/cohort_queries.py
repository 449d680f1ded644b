"""Queries over cohorts, lines of parents, aliases, networks and stores, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimwright.functions import network
from claimwright.operators import evidence, graph, matrix, pairing, profile, reports, separation, shares
from claimwright.plans.matching_queries import _PAIRS, _SUBJECTS, case_pairs
from claimwright.plans.queries import _ROLES, AS_OF, HOLDINGS, _roles, query
from claimwright.plans.research_queries import of, of_sql
from claimwright.sources import arrays, store
from claimwright.sources import datasets as D

# ---- separation and gaps over a cohort --------------------------------------------------------------
#: A normal quantile by a rational approximation of its tail, good to nine digits.
_TAIL = "(((((-0.007784894002430293 * t - 0.3223964580411365) * t - 2.400758277161838) * t - 2.549732539343734) * t + 4.374664141464968) * t + 2.938163982698783) / ((((0.007784695709041462 * t + 0.3224671290700398) * t + 2.445134137142996) * t + 3.754408661907416) * t + 1.0)"


@query("a15_separation", f"""WITH RECURSIVE {_SUBJECTS}, r AS ({_PAIRS}), q AS (SELECT subject AS "pair", subject, true AS is_case, as_of FROM r WHERE control IS NOT NULL UNION ALL SELECT subject, control, false, as_of FROM r WHERE control IS NOT NULL),
  k AS (SELECT DISTINCT "pair", is_case, unnest(['priority=' || o_orderpriority, 'asked=' || o_orderpriority, 'status=' || o_orderstatus, 'day=' || dayofweek(o_orderdate)]) AS feature FROM q JOIN orders ON o_custkey = q.subject AND CAST(o_orderdate AS DATE) <= as_of),
  f1 AS (SELECT feature, count(*) FILTER (WHERE is_case) AS cases, count(*) FILTER (WHERE NOT is_case) AS controls, md5(string_agg("pair" || '|' || is_case, ',' ORDER BY "pair", is_case)) AS members FROM k GROUP BY 1),
  g AS (SELECT min(feature) AS feature, count(*) - 1 AS identical, cases, controls FROM f1 GROUP BY members, cases, controls HAVING cases + controls >= 20),
  z AS (SELECT CAST((SELECT count(*) FROM r WHERE control IS NOT NULL) AS DOUBLE) AS n, sqrt(-2 * ln(0.025::DOUBLE / count(*))) AS t FROM g), y AS (SELECT n, -({_TAIL}) AS z FROM z),
  v AS (SELECT *, ln((cases / n) / (controls / n)) AS l, sqrt(1.0::DOUBLE / cases - 1 / n + 1.0::DOUBLE / controls - 1 / n) AS e FROM g, y WHERE cases > 0 AND controls > 0)
  SELECT g.feature, g.identical, g.cases, g.controls, round((CASE WHEN g.cases = 0 THEN 0.5::DOUBLE ELSE g.cases END) / (CASE WHEN g.controls = 0 THEN 0.5::DOUBLE ELSE g.controls END), 4) AS ratio, round(exp(l - z * e), 4) AS low, round(exp(l + z * e), 4) AS high FROM g LEFT JOIN v USING (feature)""")
def a15_separation(spark, sf):
    pairs = graph._cut(case_pairs(spark, sf).filter("control IS NOT NULL"))
    arms = pairs.select(F.col("subject").alias("pair"), "as_of", F.explode(F.array(F.struct(F.lit(True).alias("is_case"), F.col("subject").alias("who")), F.struct(F.lit(False).alias("is_case"), F.col("control").alias("who")))).alias("a")).select("pair", "as_of", "a.*")
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", "o_orderstatus", (F.dayofweek("o_orderdate") - 1).cast("string").alias("dow"))
    named = F.array(F.concat(F.lit("priority="), "o_orderpriority"), F.concat(F.lit("asked="), "o_orderpriority"), F.concat(F.lit("status="), "o_orderstatus"), F.concat(F.lit("day="), "dow"))
    features = arms.join(o, "who").filter("day <= as_of").select("pair", "is_case", F.explode(named).alias("feature"))
    rows = separation.separation(features, pairs)
    return rows.select("feature", "identical", "cases", "controls", *(F.round(c, 4).alias(c) for c in ("ratio", "low", "high")))


@query("a26_gap_rates", """WITH f AS (SELECT DISTINCT l_orderkey AS subject, 'f' || (l_suppkey % 6) AS fact FROM lineitem), x(expectation, trigger, chk, source) AS (VALUES ('officer', 'f0', 'f1', 'register'), ('parent', 'f2', 'f3', 'lei'), ('archive', 'f4', 'f5', 'archive')),
  q AS (SELECT DISTINCT l_orderkey AS subject FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT o_orderkey AS subject FROM orders),
  g AS (SELECT f.subject, x.expectation, NOT (x.source = 'lei' AND q.subject IS NOT NULL) AS closable FROM f JOIN x ON x.trigger = f.fact LEFT JOIN f m ON m.subject = f.subject AND m.fact = x.chk LEFT JOIN q ON q.subject = f.subject WHERE m.subject IS NULL AND f.subject IN (SELECT subject FROM c))
  SELECT expectation, count(*) FILTER (WHERE NOT closable) AS n_gaps, count(*) FILTER (WHERE closable) AS n_agenda, round(count(*) FILTER (WHERE NOT closable) / (SELECT count(*) FROM c), 9) AS base_rate, round(count(*) FILTER (WHERE closable) / (SELECT count(*) FROM c), 9) AS agenda_rate FROM g GROUP BY 1""")
def a26_gap_rates(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    facts = lines.select(F.col("l_orderkey").alias("subject"), F.concat(F.lit("f"), (F.col("l_suppkey") % 6).cast("string")).alias("fact"))
    rules = spark.createDataFrame([("officer", "f0", "f1", "register"), ("parent", "f2", "f3", "lei"), ("archive", "f4", "f5", "archive")], "expectation string, trigger string, check string, source string")
    asked = lines.filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("subject"), F.lit("lei").alias("source"))
    cohort = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject"))
    rates = spark.createDataFrame([], "expectation string, base_rate double")
    found = separation.gap_rates(cohort, reports.gaps(cohort, facts, rules, asked, rates))
    return found.select("expectation", "n_gaps", "n_agenda", F.round("base_rate", 9).alias("base_rate"), F.round("agenda_rate", 9).alias("agenda_rate"))


@query("a10_full_rates", f"""WITH {HOLDINGS}, {_ROLES},
  vl AS (SELECT company, holder, vbp AS v FROM hold WHERE valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to >= DATE '{AS_OF}')),
  b AS (SELECT company, holder, bp AS e, v FROM live FULL JOIN vl USING (company, holder)), k AS (SELECT r.company, max(directorships) AS most FROM r JOIN ix USING (person) GROUP BY 1),
  g AS (SELECT company, count(e) AS owners, coalesce(bool_or(v - coalesce(e, 0) >= 1), false) AS voting, coalesce(bool_or(holder % 5 = 0 AND e > 5000), false) AS unresolvable, coalesce(bool_or(e NOT IN (10000, 5000, 3333, 1000, 2500, 500, 2000, 6667, 1500, 9000, 0)), false) AS unusual,
    count(*) FILTER (WHERE e < 5000) >= 2 AND coalesce(sum(e) FILTER (WHERE e < 5000), 0) > 5000 AS sub, sum(e) < 9999 AS residual FROM b GROUP BY 1 HAVING count(e) > 0)
  SELECT least(owners, 6) AS stratum, count(*) AS n, round(avg(coalesce(most >= 100, false)::INT), 9) AS nominee_density, round(avg(voting::INT), 9) AS voting_exceeds_equity, round(avg(unresolvable::INT), 9) AS majority_owner_unresolvable,
    round(avg(unusual::INT), 9) AS unusual_ownership_percentage, round(avg(sub::INT), 9) AS subthreshold_aggregate_over_50, round(avg(residual::INT), 9) AS ownership_residual_unaccounted FROM g LEFT JOIN k USING (company) GROUP BY 1""")
def a10_full(spark, sf):
    roles = _roles(spark, sf)
    people = roles.join(roles.groupBy("person").agg(F.count_distinct("company").alias("directorships")), "person").select("company", "directorships")
    rates = profile.stratified_rates(profile.company_profile(D.owns(spark, sf), D.votes(spark, sf), people, AS_OF, F.pmod("holder", F.lit(5)) == 0))
    return rates.select("stratum", "n", *(F.round(p, 9).alias(p) for p in profile.PROFILE))


@query("a27_bunching_ratios", f"""WITH {HOLDINGS}, t(threshold) AS (VALUES (500), (1000), (2500), (3333), (5000), (6667), (9000)),
  c AS (SELECT threshold, count(*) FILTER (WHERE bp >= threshold - 200 AND bp < threshold) AS below2, count(*) FILTER (WHERE bp >= threshold - 100 AND bp < threshold) AS below1, count(*) FILTER (WHERE bp = threshold) AS "at", count(*) FILTER (WHERE bp > threshold AND bp <= threshold + 100) AS above1 FROM live, t GROUP BY 1)
  SELECT threshold, below2, below1, "at", above1, CASE WHEN above1 > 0 THEN round(below1::DOUBLE / above1, 9) END AS ratio FROM c""")
def a27_ratios(spark, sf):
    rows = profile.bunching_ratios(shares.per_holder(D.owns(spark, sf), AS_OF))
    return rows.select(F.round(F.col("threshold") * 10_000).cast("int").alias("threshold"), "below2", "below1", "at", "above1", F.round("ratio", 9).alias("ratio"))


@query("a27_common_shares", f"WITH {HOLDINGS} SELECT CAST(bp AS INTEGER) AS share_bp, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS rate FROM live GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12")
def a27_common(spark, sf):
    rows = profile.common_values(shares.per_holder(D.owns(spark, sf), AS_OF))
    return rows.select(F.round(F.col("share") * 10_000).cast("int").alias("share_bp"), "n", F.round("rate", 9).alias("rate"))


@query("a27_roles_per_person", f"WITH {_ROLES}, c AS (SELECT person, count(*) AS n_roles FROM r GROUP BY 1), d AS (SELECT n_roles, count(*) AS people FROM c GROUP BY 1) SELECT n_roles, people, round(sum(people) OVER (ORDER BY n_roles) / sum(people) OVER (), 9) AS cumulative FROM d")
def a27_roles(spark, sf):
    rows = profile.roles_per_person(_roles(spark, sf).distinct())
    return rows.select("n_roles", "people", F.round("cumulative", 9).alias("cumulative"))


# ---- lines of parents, aliases ----------------------------------------------------------------------
@query("g13_lineage_ranks", """WITH RECURSIVE h AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey - 1 WHEN o_orderkey % 400 = 0 AND o_orderkey > 0 THEN o_orderkey + 20 END AS parent FROM orders),
  w(id, here, n) AS (SELECT id, id, CAST(0 AS BIGINT) FROM h UNION ALL SELECT w.id, p.id, n + 1 FROM w JOIN h ON h.id = w.here JOIN h p ON p.id = h.parent WHERE n < 60),
  e AS (SELECT w.id, w.here AS top, n FROM w JOIN h ON h.id = w.here WHERE h.parent IS NULL OR h.parent NOT IN (SELECT id FROM h))
  SELECT h.id, p.id AS parent, top, n AS rank FROM h LEFT JOIN h p ON p.id = h.parent LEFT JOIN e ON e.id = h.id""")
def g13_ranks(spark, sf):
    k = F.col("o_orderkey")
    parent = F.when(k % 50 != 0, k - 1).when((k % 400 == 0) & (k > 0), k + 20)
    return graph.lineage_ranks(D.table(spark, sf, "orders").select(k.alias("id"), parent.alias("parent")))


@query("g10_report_ranks", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rank FROM conversations")
def g10_ranks(spark, sf):
    return evidence.report_ranks(D.table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("j22_alias_chains", """WITH RECURSIVE a AS (SELECT 'p' || p_partkey AS alias, 'p' || (p_partkey - 1) AS canonical FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0), b AS (SELECT alias AS x, canonical AS y FROM a UNION ALL SELECT canonical, alias FROM a),
  r(id, here) AS (SELECT 'p' || p_partkey, 'p' || p_partkey FROM part UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.here) SELECT id AS key, min(here) AS canonical FROM r GROUP BY 1""")
def j22(spark, sf):
    k = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("p"), n.cast("string"))
    p = D.table(spark, sf, "part")
    aliases = p.filter(k % 7 != 0).select(name(k).alias("alias"), name(k - 1).alias("canonical"), (k % 5 != 0).alias("accepted"))
    return pairing.resolved(p.select(name(k).alias("key")), aliases)


# ---- evidence and explanations ----------------------------------------------------------------------
_READINGS = ("consistent", "inconsistent", "consistent", "narrows", "neutral", "not_applicable", "consistent")


@query("m4_matrix", f"""WITH x AS (SELECT i // 4 AS question, i AS explanation, CASE WHEN i % 4 = 3 THEN i - 1 WHEN i % 4 = 2 AND i > 4 THEN i - 1 END AS parent FROM range(16) r(i)),
  up AS (SELECT explanation, explanation AS above FROM x UNION SELECT explanation, parent FROM x WHERE parent IS NOT NULL UNION SELECT a.explanation, b.parent FROM x a JOIN x b ON b.explanation = a.parent WHERE b.parent IS NOT NULL),
  kin AS (SELECT explanation AS a, above AS b FROM up UNION SELECT above, explanation FROM up), p AS (SELECT i // 2 AS explanation, i AS prediction, i % 3 > 0 AND i < 24 AS observable, CASE WHEN i % 5 > 0 THEN 1985 + i END AS made FROM range(28) r(i)),
  own AS (SELECT DISTINCT up.explanation, prediction, observable, made FROM p JOIN up ON up.above = p.explanation), r AS (SELECT p_partkey AS row, CASE WHEN p_partkey % 9 > 0 THEN 1985 + p_partkey % 40 END AS year, p_partkey % 7 = 0 AS contested FROM part),
  c AS (SELECT l_partkey AS row, l_suppkey % 15 AS explanation, min(l_orderkey) AS k FROM lineitem WHERE l_partkey IN (SELECT row FROM r) GROUP BY 1, 2),
  d AS (SELECT c.row, c.explanation, x.question, year, contested, {of_sql('k', *_READINGS)} AS reading, CASE WHEN k % 4 > 0 THEN (CASE WHEN k % 8 = 1 AND parent IS NOT NULL THEN parent ELSE c.explanation END) * 2 + k % 2 END AS tests FROM c JOIN x USING (explanation) JOIN r USING (row)),
  t AS (SELECT question, row FROM d WHERE reading <> 'not_applicable' GROUP BY 1, 2 HAVING bool_or(reading = 'inconsistent') AND NOT bool_and(reading = 'inconsistent')),
  f AS (SELECT d.*, own.observable, own.made, t.row IS NOT NULL AS tells, d.reading = 'consistent' AND d.tests IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d o WHERE o.question = d.question AND o.row = d.row AND o.reading = 'consistent' AND NOT EXISTS (SELECT 1 FROM kin WHERE kin.a = d.explanation AND kin.b = o.explanation)) AS alone
        FROM d LEFT JOIN own ON own.explanation = d.explanation AND own.prediction = d.tests LEFT JOIN t ON t.question = d.question AND t.row = d.row),
  g AS (SELECT question, explanation, count(*) FILTER (WHERE reading = 'inconsistent' AND NOT contested) AS inconsistent, count(*) FILTER (WHERE reading = 'inconsistent' AND contested) AS inconsistent_disputed,
    count(*) FILTER (WHERE reading = 'inconsistent' AND tests IS NOT NULL AND NOT contested) AS contradicted, count(*) FILTER (WHERE reading = 'inconsistent' AND tests IS NOT NULL AND contested) AS contradicted_disputed,
    count(*) FILTER (WHERE alone AND NOT coalesce(year <= made, false) AND NOT contested) AS confirmed, count(*) FILTER (WHERE alone AND NOT coalesce(year <= made, false) AND contested) AS confirmed_disputed, count(*) FILTER (WHERE alone AND coalesce(year <= made, false)) AS accommodated,
    count(*) FILTER (WHERE reading = 'consistent') AS consistent, count(*) FILTER (WHERE reading = 'consistent' AND tells) AS consistent_discriminating, count(*) FILTER (WHERE reading = 'narrows') AS narrowed, count(*) FILTER (WHERE reading = 'neutral') AS neutral,
    count(*) FILTER (WHERE reading = 'not_applicable') AS not_applicable, count(*) AS assessed, count(*) FILTER (WHERE observable) AS tested FROM f GROUP BY 1, 2),
  s AS (SELECT explanation, count(*) AS n, count(*) FILTER (WHERE observable) AS seen FROM own GROUP BY 1),
  h AS (SELECT x.question, x.explanation, COLUMNS(lambda c: c IN ('inconsistent', 'inconsistent_disputed', 'contradicted', 'contradicted_disputed', 'confirmed', 'confirmed_disputed', 'accommodated', 'consistent', 'consistent_discriminating', 'narrowed', 'neutral', 'not_applicable')), assessed, tested, n, seen FROM x LEFT JOIN g ON g.explanation = x.explanation LEFT JOIN s ON s.explanation = x.explanation)
  SELECT question, explanation, coalesce(inconsistent, 0) AS inconsistent, coalesce(inconsistent_disputed, 0) AS inconsistent_disputed, coalesce(contradicted, 0) AS contradicted, coalesce(contradicted_disputed, 0) AS contradicted_disputed, coalesce(confirmed, 0) AS confirmed, coalesce(confirmed_disputed, 0) AS confirmed_disputed,
    coalesce(accommodated, 0) AS accommodated, coalesce(consistent, 0) AS consistent, coalesce(consistent_discriminating, 0) AS consistent_discriminating, coalesce(narrowed, 0) AS narrowed, coalesce(neutral, 0) AS neutral, coalesce(not_applicable, 0) AS not_applicable,
    (SELECT count(*) FROM r) - coalesce(assessed, 0) AS unassessed, CASE WHEN n IS NULL THEN '{matrix.NO_PREDICTION}' WHEN seen = 0 THEN '{matrix.NOT_OBSERVABLE}' WHEN coalesce(tested, 0) = 0 THEN '{matrix.NOT_TESTED}' END AS immune,
    CAST(row_number() OVER (PARTITION BY question ORDER BY coalesce(inconsistent, 0), coalesce(inconsistent_disputed, 0), coalesce(confirmed, 0) DESC, coalesce(confirmed, 0) + coalesce(confirmed_disputed, 0) DESC, explanation) AS INTEGER) AS place FROM h""")
def m4_matrix(spark, sf):
    i = F.col("id")
    x = spark.range(16).select(F.floor(i / 4).alias("question"), i.alias("explanation"), F.when((i % 4 == 3) | ((i % 4 == 2) & (i > 4)), i - 1).alias("parent"))
    p = spark.range(28).select(F.floor(i / 2).alias("explanation"), i.alias("prediction"), ((i % 3 > 0) & (i < 24)).alias("observable"), F.when(i % 5 > 0, i + 1985).alias("made"))
    k = F.col("p_partkey")
    r = D.table(spark, sf, "part").select(k.alias("row"), F.when(k % 9 > 0, k % 40 + 1985).alias("year"), (k % 7 == 0).alias("contested"))
    least = F.col("k")
    c = D.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("row"), (F.col("l_suppkey") % 15).alias("explanation")).agg(F.min("l_orderkey").alias("k"))
    c = c.join(x.select("explanation", "parent"), "explanation")
    tests = F.when(least % 4 > 0, F.when((least % 8 == 1) & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("explanation")) * 2 + least % 2)
    return matrix.matrix(x, p, r, c.select("row", "explanation", of("k", *_READINGS).alias("reading"), tests.alias("tests")))


# ---- networks ------------------------------------------------------------------------------------------
_ASNS = ("13335", "24940", "64512", "16509", "15169")


@query("e9_network_flags", f"""WITH a AS (SELECT o_orderkey AS id, '10.' || (o_custkey % 7) || '.' || (o_orderkey % 300) || '.' || (o_orderkey % 256) AS ip, o_custkey % 7 AS b, o_orderkey % 300 AS c, o_orderkey % 256 AS d FROM orders),
  m AS (SELECT id, CASE WHEN c > 255 OR b = 6 THEN NULL WHEN b = 1 AND c = 7 THEN '10.1.7.0/24' WHEN b = 2 AND c >= 128 THEN '10.2.128.0/17' WHEN b = 3 AND c = 9 AND d = 9 THEN '10.3.9.9/32' WHEN b < 6 THEN '10.' || b || '.0.0/16' END AS prefix FROM a),
  n(prefix, asn) AS (SELECT '10.' || i || '.0.0/16', {of_sql('i', *_ASNS)} FROM range(6) r(i) UNION ALL VALUES ('10.1.7.0/24', '24940'), ('10.2.128.0/17', '13335'), ('10.3.9.9/32', '54113'))
  SELECT id, m.prefix, asn, coalesce(asn IN ('13335', '16509', '54113'), false) AS masked, coalesce({of_sql("CASE asn WHEN '13335' THEN 0 WHEN '16509' THEN 1 WHEN '54113' THEN 2 WHEN '24940' THEN 3 WHEN '15169' THEN 4 ELSE 5 END", 'cloudflare', 'aws-cloudfront', 'fastly', 'hetzner', 'google', '')}, '') AS provider FROM m LEFT JOIN n ON n.prefix = m.prefix""")
def e9(spark, sf):
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", F.lit("10"), (F.col("o_custkey") % 7).cast("string"), (k % 300).cast("string"), (k % 256).cast("string"))
    wide = D.table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("i")).distinct().filter("i < 6").select(F.concat(F.lit("10."), F.col("i").cast("string"), F.lit(".0.0/16")).alias("prefix"), of("i", *_ASNS).alias("asn"))
    narrow = spark.createDataFrame([("10.1.7.0/24", "24940"), ("10.2.128.0/17", "13335"), ("10.3.9.9/32", "54113"), ("10.3.0.0/33", "1"), ("broken", "2")], "prefix string, asn string")
    found = network.in_networks(D.table(spark, sf, "orders").select(k.alias("id"), ip.alias("ip")), wide.unionByName(narrow))
    return found.select("id", "prefix", "asn", network.masks_origin(F.col("asn")).alias("masked"), network.network_provider(F.col("asn")).alias("provider"))


@query("a22_host_clusters", r"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages), d AS (SELECT page_id, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain FROM h),
  o AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'aspmx.google.com' WHEN page_id % 4 = 1 THEN 'a.' || domain || ',b.' || domain WHEN page_id % 4 = 2 THEN 'mail' || (page_id % 11) || '.' || domain END AS mx, CASE WHEN page_id % 5 > 0 THEN 'ns1.' || domain || ',ns' || (page_id % 3) || '.host.example' END AS ns FROM d),
  k AS (SELECT page_id, 'mx' AS kind, mx AS hosts FROM o WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, 'ns', array_to_string(list_sort(string_split(ns, ',')), ',') FROM o)
  SELECT kind, hosts, count(*) AS members FROM k WHERE hosts IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def a22_hosts(spark, sf):
    k = F.col("page_id")
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    p = D.table(spark, sf, "pages").select(k.alias("subject"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))
    n = F.col("subject")
    at = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts), F.col("domain"))
    mx = F.when(n % 4 == 0, F.array(F.lit("aspmx.google.com"))).when(n % 4 == 1, F.array(at("b."), at("a."))).when(n % 4 == 2, F.array(at("mail", (n % 11).cast("string"), ".")))
    ns = F.when(n % 5 > 0, F.array(F.concat(F.lit("ns"), (n % 3).cast("string"), F.lit(".host.example")), at("ns1.")))
    return network.shared_infrastructure(p.select("subject", mx.alias("mx"), ns.alias("ns"))).select("kind", "hosts", "members")


# ---- arrays and stores in the shared folder -----------------------------------------------------------------
@query("i7_array_rows", "SELECT c_custkey, c_name || ' {\"}' AS name, c_mktsegment FROM customer")
def i7(spark, sf):
    """Customers written as the objects of an array, and read back by ranges."""
    where = f"{graph.shared_folder(spark)}/array-{uuid.uuid4().hex}"
    c = D.table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(' {"}')).alias("name"), "c_mktsegment")
    c.select(F.to_json(F.struct(*c.columns)).alias("value")).write.option("lineSep", ",\n").text(where)
    return arrays.array_rows(spark, where, "c_custkey bigint, name string, c_mktsegment string")


@query("i2_stored_chunks", "SELECT sha256(props) AS content_hash, count(*) AS fetches, CAST(any_value(strlen(props)) AS BIGINT) AS byte_len FROM events GROUP BY 1")
def i2(spark, sf):
    """Payloads cut into chunks, stored by their hash, and the log that leads to them."""
    where = f"{graph.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    e = D.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("payload"), F.col("event_type").alias("source"), F.lit("event").alias("resource_type"), F.col("user_id").cast("string").alias("resource_id"), F.lit(200).alias("http_status"), F.col("ts").alias("fetched_at"), "props")
    each = e.groupBy(F.sha2(F.col("props").cast("binary"), 256).alias("h")).agg(F.min("payload").alias("payload"), F.first("props").alias("props"))
    half = F.floor(F.length("props") / 2).cast("int")
    chunks = each.select("payload", F.explode(F.array(F.struct(F.lit(1).alias("chunk"), F.expr("substring(props, cast(floor(length(props) / 2) as int) + 1)").alias("data")), F.struct(F.lit(0).alias("chunk"), F.left("props", half).alias("data")))).alias("c")).select("payload", "c.chunk", F.col("c.data").cast("binary").alias("data"))
    store.put_stream(chunks, e.join(each.select("payload"), "payload", "left_semi").drop("props"), f"{where}/blobs", f"{where}/log")
    log = spark.read.parquet(f"{where}/log").select("content_hash", "byte_len")
    seen = e.groupBy(F.sha2(F.col("props").cast("binary"), 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("fetches"))
    return log.join(seen, "content_hash").select("content_hash", "fetches", "byte_len")
