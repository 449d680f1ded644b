"""Queries over names, screening, statements and research records, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimwright.functions import names as N
from claimwright.functions.scalars import HEDGE, NEGATION, REPORTING, day_of, normal_text
from claimwright.operators import atoms, graph, reports, screening, stats, statements
from claimwright.operators.atoms import FRAME, HEDGE_START
from claimwright.plans.queries import AS_OF, EVENTS_AS_OF, HISTORY, query
from claimwright.sources import datasets as D


def of(key: str, *values: str | None):
    """One of the values by the key's remainder: rows that reach every branch."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.pmod(key, F.lit(len(values))) == i, F.lit(v)).otherwise(out)
    return out


def of_sql(key: str, *values: str | None) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


NAMES = ("Søren Ærø A/S", "ÉCLAIR  Holding (Luxembourg) S.à.r.l.", "Boet efter Åse Ny", "Nordby Kommune", "Vind & Sol I/S", "Müller-Lüdenscheidt GmbH", "Acme, Inc.", "plain name")
PROGRAMMES = ("EU-ESMA", "EU-ESMA;US-OFAC", "RU-1;CN-2", "XX-1", "UA-9", "IR-3;EU-MARE", "")
PLAIN = r"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("e2_normal_name", f"SELECT c_custkey, {PLAIN.format(x='n')} AS norm FROM (SELECT c_custkey, {of_sql('c_custkey', *NAMES)} || ', ' || c_name AS n FROM customer)")
def e2(spark, sf):
    c = D.table(spark, sf, "customer")
    return c.select("c_custkey", N.normal_name(F.concat(of("c_custkey", *NAMES), F.lit(", "), "c_name")).alias("norm"))


@query("f11_designation", f"""WITH p AS (SELECT c_custkey, string_split({of_sql('c_custkey', *PROGRAMMES)}, ';') AS p FROM customer),
  g AS (SELECT c_custkey, list_filter(p, lambda x: x <> 'EU-ESMA' AND split_part(x, '-', 1) IN ('EU','UN','US','GB','CA','AU','NZ','JP','CH','SECO','UA')) AS d,
        len(list_filter(p, lambda x: split_part(x, '-', 1) NOT IN ('RU','CN','IR'))) = 0 AS adversary_only FROM p)
  SELECT c_custkey, array_to_string(d, ';') AS designating, len(d) > 0 AS designated, adversary_only FROM g""")
def f11(spark, sf):
    p = D.table(spark, sf, "customer").select("c_custkey", F.split(of("c_custkey", *PROGRAMMES), ";").alias("p"))
    return p.select("c_custkey", F.array_join(N.designating(F.col("p")), ";").alias("designating"), N.is_designation(F.col("p")).alias("designated"), N.adversary_only(F.col("p")).alias("adversary_only"))


@query("e5_party_kind", f"""SELECT c_custkey, CASE WHEN regexp_matches(n, '(?i)^\\s*(boet\\s+efter|dødsboet\\s+efter|estate\\s+of)\\b') THEN 'estate'
  WHEN regexp_matches(n, '(?i)\\b(kommune|kommunen|region|regionen|staten|ministeriet|styrelsen|universitet|municipality)\\b') THEN 'public_body'
  WHEN regexp_matches(n, '(?i)\\b(I/S|K/S|P/S|kommanditselskab|interessentskab)\\b') THEN 'partnership' ELSE 'other' END AS kind,
  {of_sql('c_custkey', 'Søren Ærø A/S|Søren Ærø', 'ÉCLAIR  Holding (Luxembourg) S.à.r.l.|ÉCLAIR  Holding (Luxembourg)|ÉCLAIR Holding', 'Boet efter Åse Ny', 'Nordby Kommune', 'Vind & Sol I/S', 'Müller-Lüdenscheidt GmbH|Müller-Lüdenscheidt', 'Acme, Inc.|Acme', 'plain name')} AS variants
  FROM (SELECT c_custkey, {of_sql('c_custkey', *NAMES)} AS n FROM customer)""")
def e5(spark, sf):
    n = of("c_custkey", *NAMES)
    return D.table(spark, sf, "customer").select("c_custkey", N.party_kind(n).alias("kind"), F.array_join(N.name_variants(n), "|").alias("variants"))


@query("e6_group_evidence", f"""WITH n AS (SELECT c_custkey, {of_sql('c_custkey', *NAMES)} AS n FROM customer)
  SELECT c_custkey, CASE n WHEN 'Boet efter Åse Ny' THEN 'benign_form' WHEN 'Nordby Kommune' THEN 'benign_form' WHEN 'Søren Ærø A/S' THEN 'documented_group'
    WHEN 'Acme, Inc.' THEN 'lei_lapsed' WHEN 'Müller-Lüdenscheidt GmbH' THEN 'lei_only' ELSE 'no_lei' END AS evidence,
    CASE n WHEN 'Søren Ærø A/S' THEN 'L2' WHEN 'Acme, Inc.' THEN 'L3' WHEN 'Müller-Lüdenscheidt GmbH' THEN 'L4' END AS lei FROM n""")
def e6(spark, sf):
    c = D.table(spark, sf, "customer").select("c_custkey", of("c_custkey", *NAMES).alias("name"))
    records = spark.createDataFrame([("Søren Ærø", "L1", "LAPSED"), ("Søren Ærø", "L2", "active"), ("Acme", "L3", "LAPSED"), ("Müller-Lüdenscheidt GmbH", "L4", "ACTIVE"), ("Müller-Lüdenscheidt", "L0", "ACTIVE"), ("Nordby Kommune", "L5", "ACTIVE")], "legal_name string, lei string, status string")
    parents = spark.createDataFrame([("L2",), ("L5",)], "lei string")
    found = screening.group_evidence(c.select("name").distinct(), records, parents)
    return c.join(found, "name").select("c_custkey", "evidence", "lei")


SITES = ("https://www.example-shop.dk/x?y=1", "name@example-mail.dk", "wwwexample-shop.dk", "HTTP://Sub.Example.DK:8080/", "nothing", "", None, "www.a.b ")


@query("e7_domain", f"""WITH v AS (SELECT s_suppkey, lower(trim(coalesce({of_sql('s_suppkey', *SITES)}, ''))) AS v FROM supplier),
  a AS (SELECT s_suppkey, trim(regexp_extract(regexp_replace(v, '^https?://', ''), '^[^/?:]*'), ' .') AS v FROM v),
  b AS (SELECT s_suppkey, regexp_replace(regexp_replace(v, '^.*@', ''), '^www[.-]*', '') AS v FROM a)
  SELECT s_suppkey, CASE WHEN contains(v, '.') THEN v ELSE '' END AS domain FROM b""")
def e7(spark, sf):
    return D.table(spark, sf, "supplier").select("s_suppkey", N.domain_of(of("s_suppkey", *SITES)).alias("domain"))


REGISTRARS = ("MarkMonitor Inc.", "one.com", "CSC Corporate Domains", None, "ascioX")


@query("e10_corporate_registrar", f"SELECT s_suppkey, coalesce(regexp_matches(r, '(?i)\\b(safenames|markmonitor|cscglobal|csc corporate|com laude|nom-iq|ascio|gandi corporate|brandshelter|ebrand)\\b'), false) AS corporate, s_suppkey % 3 <> 0 AND (r IS NOT NULL OR s_suppkey % 2 = 0) AS is_evidence FROM (SELECT s_suppkey, {of_sql('s_suppkey', *REGISTRARS)} AS r FROM supplier)")
def e10(spark, sf):
    s, r = D.table(spark, sf, "supplier"), of("s_suppkey", *REGISTRARS)
    servers = F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "ns1")
    return s.select("s_suppkey", N.corporate_registrar(r).alias("corporate"), N.says_something(F.pmod("s_suppkey", F.lit(3)) == 0, r, servers).alias("is_evidence"))


@query("e12_country", f"SELECT s_suppkey, coalesce(substr(upper(nullif({of_sql('s_suppkey', 'dk', '', None, 'swe')}, '')), 1, 2), substr(upper({of_sql('s_suppkey', None, 'no', None, None, None)}), 1, 2), {of_sql('s_suppkey', 'DK', 'EE', None)}, '') AS country FROM supplier")
def e12(spark, sf):
    s = D.table(spark, sf, "supplier")
    return s.select("s_suppkey", N.stated_country(of("s_suppkey", "cvr", "ee_ariregister", "openalex"), of("s_suppkey", "dk", "", None, "swe"), of("s_suppkey", None, "no", None, None, None)).alias("country"))


@query("e14_partial_date", """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 300 ELSE year(o_orderdate) END AS y, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 14 END AS m, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 33 END AS d FROM orders)
  SELECT k, CASE WHEN m IS NULL THEN CASE WHEN y >= 1000 THEN CAST(y AS VARCHAR) END
    WHEN d IS NULL THEN CASE WHEN m BETWEEN 1 AND 12 THEN lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') END
    ELSE CAST(try_cast(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) END AS day FROM d""")
def e14(spark, sf):
    k = F.col("o_orderkey")
    d = D.table(spark, sf, "orders").select(k.alias("k"), F.when(k % 7 == 0, 300).otherwise(F.year("o_orderdate")).alias("y"), F.when(k % 3 > 0, k % 14).alias("m"), F.when(k % 3 == 2, k % 33).alias("d"))
    return d.select("k", N.partial_date(F.col("y"), F.col("m"), F.col("d")).alias("day"))


@query("e15_stated_numbers", """WITH t AS (SELECT o_orderkey AS k, 'rose ' || (o_orderkey % 90) || ',5 Percent, or ' || o_orderkey || ' kr and v' || o_orderkey || ' of ' || (o_orderkey % 7) || ' seats' AS t, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
  n AS (SELECT k, d, regexp_extract_all(t, '(?i)[^\\w.](\\d+(?:[.,]\\d+)?)\\s*(%|percent|seats|kr)', 1) AS v, regexp_extract_all(t, '(?i)[^\\w.](\\d+(?:[.,]\\d+)?)\\s*(%|percent|seats|kr)', 2) AS u FROM t)
  SELECT k, CAST(len(v) AS INTEGER) AS n, list_sum(list_transform(v, lambda x: CAST(replace(x, ',', '.') AS DOUBLE))) AS total, lower(array_to_string(u, ',')) AS units,
    CAST(abs(date_diff('day', CAST(d AS DATE), CAST(substr(d, 1, 7) || '-01' AS DATE))) AS INTEGER) AS gap FROM n""")
def e15(spark, sf):
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("rose "), (F.col("o_orderkey") % 90).cast("string"), F.lit(",5 Percent, or "), k, F.lit(" kr and v"), k, F.lit(" of "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" seats"))
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), N.stated_numbers(text).alias("x"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["value"])
    return o.select("k", F.size("x").alias("n"), total.alias("total"), F.array_join("x.unit", ",").alias("units"), N.gap_days(F.col("d"), F.substring("d", 1, 7)).alias("gap"))


@query("e23_softmax", f"WITH x AS (SELECT o_orderkey AS k, [o_orderkey % 5 + 0.0, o_orderkey % 3 + 0.5, o_orderkey % 2 + 0.0] AS l FROM orders), e AS (SELECT k, list_transform(l, lambda v: exp(CAST(v AS DOUBLE))) AS e FROM x) SELECT k, round(e[1] / list_sum(e), 6) AS entails, round(e[3] / list_sum(e), 6) AS contradicts, round(1.959963985, 6) AS z FROM e")
def e23(spark, sf):
    k = F.col("o_orderkey")
    p = D.table(spark, sf, "orders").select(k.alias("k"), N.softmax(F.array((k % 5).cast("double"), (k % 3) + F.lit(0.5), (k % 2).cast("double"))).alias("p"))
    return p.select("k", F.round(p.p[0], 6).alias("entails"), F.round(p.p[2], 6).alias("contradicts"), F.lit(round(N.normal_quantile(0.05), 6)).alias("z"))


# ---- screening -----------------------------------------------------------------------------------
@query("f9_mandate", """WITH m AS (SELECT o_orderkey AS k, o_orderdate AS g, o_orderdate + INTERVAL 365 DAY AS e, o_orderkey % 5 = 0 AS gone, o_orderkey % 2 = 0 AS dns_too FROM orders)
  SELECT k, NOT gone AND CAST(g AS DATE) <= DATE '1996-06-30' AND CAST(e AS DATE) >= DATE '1996-06-30' AS active, NOT gone AND CAST(g AS DATE) <= DATE '1996-06-30' AND CAST(e AS DATE) >= DATE '1996-06-30' AND dns_too AS permits FROM m""")
def f9(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    terms = (day, F.date_add(day, 365), F.when(k % 5 == 0, day))
    on = F.lit(AS_OF).cast("date")
    sources, kinds = F.when(k % 2 == 0, F.array(F.lit("cvr"), F.lit("dns"))).otherwise(F.array(F.lit("cvr"))), F.array(F.lit("company"))
    return D.table(spark, sf, "orders").select(k.alias("k"), screening.mandate_active(on, *terms).alias("active"), screening.mandate_permits(on, F.lit("dns"), F.lit("company"), *terms, sources, kinds).alias("permits"))


def _subjects(spark, sf):
    users = D.table(spark, sf, "events").groupBy(F.col("user_id").alias("subject")).agg(F.min(F.col("ts").cast("date")).alias("founded"))
    return users.withColumn("as_of", F.lit(EVENTS_AS_OF).cast("date"))


ELIGIBLE = f"WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, status DESC) AS rn FROM cov), el AS (SELECT user_id AS subject FROM r WHERE rn = 1 AND status = 'view')"


@query("f12_eligible", f"{ELIGIBLE} SELECT subject FROM el")
def f12(spark, sf):
    s = D.statuses(spark, sf).withColumnRenamed("user_id", "subject")
    return screening.eligible(_subjects(spark, sf), s, normal="view").select("subject")


@query("f13_clean_controls", f"{ELIGIBLE}, ev AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT count(*) FILTER (WHERE ev.user_id IS NULL) AS kept, count(ev.user_id) AS dropped FROM el LEFT JOIN ev ON ev.user_id = el.subject")
def f13(spark, sf):
    events = D.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("subject"))
    return screening.clean_controls(f12(spark, sf), events)[1]


@query("f16_substring", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') OR contains(CAST(c_custkey AS VARCHAR), '77')")
def f16(spark, sf):
    c = D.table(spark, sf, "customer")
    return c.filter(F.contains(F.lower("c_name"), F.lit("00012")) | F.contains(F.col("c_custkey").cast("string"), F.lit("77"))).select("c_custkey")


ANSWERS = ("TRUE", "2018-11-01", "yes", "7 people", "a value that is too long", "31.12.2020", "false")


@query("f17_rateable", f"SELECT o_orderkey, {of_sql('o_orderkey', 'TRUE', '2018-11-01', 'yes', '7 people', 'a value that is too long', '31.12.2020', 'false')} IN ('TRUE', 'yes', 'false') AS rateable FROM orders")
def f17(spark, sf):
    v = of("o_orderkey", *ANSWERS)
    return D.table(spark, sf, "orders").select("o_orderkey", N.rateable(v, day_of(v).isNotNull()).alias("rateable"))


@query("f6_undated", "SELECT 'owns' AS predicate, count(*) AS n FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 4 = 1 HAVING count(*) > 0")
def f6(spark, sf):
    k = F.col("o_orderkey")
    day = F.when(k % 4 != 1, F.col("o_orderdate").cast("date"))
    return reports.undated(D.table(spark, sf, "orders").select(of("o_orderkey", "founded_on", "employs", "owns").alias("predicate"), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")))


def _targets(spark, sf):
    c = D.table(spark, sf, "customer")
    return c.select(F.concat(F.lit("t"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"), F.col("c_name").alias("name"), F.array(F.replace(F.upper("c_name"), F.lit("CUSTOMER#"), F.lit("Künde, "))).alias("aliases"), F.split(of("c_custkey", *PROGRAMMES), ";").alias("programmes"))


LISTED = "tg AS (SELECT c_custkey, 't' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id FROM customer WHERE c_custkey % 7 IN (1, 4, 5))"


@query("p5_designated_holder", f"""WITH {LISTED},
  hl AS (SELECT DISTINCT l_orderkey AS company, l_suppkey AS holder FROM lineitem WHERE l_orderkey % 11 <> 0),
  hit AS (SELECT company, holder, id FROM hl JOIN tg ON tg.c_custkey = hl.holder WHERE holder % 4 IN (1, 2) AND company % 13 <> 0),
  b AS (SELECT company, min(holder) AS hit FROM hit GROUP BY company),
  n AS (SELECT company, count(*) FILTER (WHERE company % 13 <> 0 AND holder % 4 <> 0) AS named FROM hl GROUP BY company)
  SELECT o.o_orderkey AS company, CASE WHEN n.company IS NULL OR n.named = 0 THEN 'UNKNOWABLE' WHEN b.hit IS NOT NULL THEN 'TRUE' ELSE 'FALSE' END AS value,
    CASE WHEN n.company IS NULL THEN 'no holders filed' WHEN n.named = 0 THEN 'no holder carries a name' END AS reason, b.hit, 't' || lpad(CAST(b.hit AS VARCHAR), 9, '0') AS target
  FROM orders o LEFT JOIN n ON n.company = o.o_orderkey LEFT JOIN b ON b.company = o.o_orderkey""")
def p5(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    lines = D.dealt(lines.filter("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("company"), F.col("l_suppkey").alias("holder")), lines, "company").distinct()
    number = F.lpad(F.col("holder").cast("string"), 9, "0")
    kind = F.pmod("holder", F.lit(4))
    label = F.when(F.col("company") % 13 == 0, "").when(kind == 1, F.concat(F.lit("kunde "), number)).when(kind == 2, F.concat(F.lit("CUSTOMER: "), number)).when(kind == 3, F.lit("Nobody"))
    return screening.designated_holders(D.companies(spark, sf), lines.withColumn("label", label), screening.name_index(_targets(spark, sf)))


@query("j9_institution_status", f"WITH {LISTED} SELECT c.c_name AS institution, tg.id AS target, CASE WHEN c.c_custkey % 5 = 0 THEN 'high risk' END AS assessment FROM customer c LEFT JOIN tg ON tg.c_custkey = c.c_custkey")
def j9(spark, sf):
    c = D.table(spark, sf, "customer")
    rated = c.filter("c_custkey % 5 = 0").select(F.upper("c_name").alias("name"), F.lit("high risk").alias("assessment"))
    return screening.institution_status(c.select(F.col("c_name").alias("institution")), screening.name_index(_targets(spark, sf)), rated)


# ---- statements ----------------------------------------------------------------------------------
FLAT = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query("t2_located_words", f"""WITH t AS (SELECT doc_id, {FLAT} AS t FROM documents), q AS (SELECT doc_id, t, trim(substr(t, length(t) // 2 + 1, 30)) AS q FROM t)
  SELECT doc_id, CASE WHEN q <> '' THEN CAST(instr(lower(t), lower(q)) - 1 AS INTEGER) END AS first_char, CASE WHEN q <> '' THEN CAST(instr(lower(t), lower(q)) - 1 + length(q) AS INTEGER) END AS last_char FROM q""")
def t2(spark, sf):
    t = D.table(spark, sf, "documents").select("doc_id", F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+", " "), F.lit(" ")).alias("t"))
    q = t.select("doc_id", "t", F.btrim(F.substr("t", F.floor(F.length("t") / 2).cast("int") + 1, F.lit(30)), F.lit(" ")).alias("q"))
    at = q.select("doc_id", statements.located_words("t", F.upper("q")).alias("x"))
    return at.select("doc_id", F.col("x.start").alias("first_char"), F.col("x.end").alias("last_char"))


IDS = ("cvr:{k}", "cvr:{k}", "local:s1#acme.x", "local:s2#acme.x", "web:s1", "doi:10.1234/{k}", "local:s1#none")
SAID = ("as 00{k}1 said", "no {k}, said", "the Acme x", "the Acme x", "none", "see 10.1234/{k}.", "other")


def _with_key(values):
    k = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    return F.replace(of("o_orderkey", *values), F.lit("{k}"), k)


@query("t14_id_defects", f"SELECT o_orderkey, {of_sql('o_orderkey', 'id_not_in_passage', None, None, 'local_id_wrong_source', 'not_rigid', None, 'local_id_not_in_passage')} AS defect FROM orders")
def t14(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", _with_key(IDS).alias("i"), _with_key(SAID).alias("p"))
    return o.select("o_orderkey", statements.id_defect(F.col("i"), F.lit("s1"), F.col("p")).alias("defect"))


NORMAL = r"lower(trim(regexp_replace(replace(coalesce(text, ''), '-' || chr(10), ''), '[ \t\n\r\f\v]+', ' ', 'g')))"
BEGINS = '[a-zæøåäöü0-9"“(]'


@query("t16_sentence_context", f"""WITH t AS (SELECT doc_id, {NORMAL} AS t FROM documents), q AS (SELECT doc_id, t, trim(substr(t, length(t) // 3 + 1, 25)) AS q FROM t),
  a AS (SELECT doc_id, t, q, instr(t, q) - 1 AS pos FROM q), h AS (SELECT *, substr(t, 1, pos + 1) AS h, substr(t, pos + length(q), length(t)) AS r FROM a),
  l AS (SELECT *, substr(h, length(regexp_extract(h, '(?s)^(.*[.!?]\\s+){BEGINS}', 1)) + 1) AS l, regexp_extract(r, '(?s)^(.*?[.!?]\\s+){BEGINS}', 1) AS s FROM h)
  SELECT doc_id, md5(CASE WHEN q = '' THEN '' ELSE substr(l, 1, length(l) - 1) END) AS before_md5, md5(CASE WHEN q = '' THEN '' WHEN s <> '' THEN substr(s, 2) ELSE substr(r, 2) END) AS after_md5 FROM l""")
def t16(spark, sf):
    from claimwright.functions.scalars import normal_text

    t = D.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", normal_text(F.col("text")))
    q = F.btrim(F.substr("t", F.floor(F.length("t") / 3).cast("int") + 1, F.lit(25)), F.lit(" "))
    before, after = statements.sentence_context(F.col("text"), q)
    return t.select("doc_id", F.md5(before.cast("binary")).alias("before_md5"), F.md5(after.cast("binary")).alias("after_md5"))


LABELS = ("The Ministry of Finance", "their Office", "Bank Denmark National", "the and", "Finance Ministry")
PASSAGE = "Yesterday the ministry of public finance told Denmark's National Bank, it said."


@query("t18_labels", f"SELECT o_orderkey, {of_sql('o_orderkey', 'true', 'false', 'true', 'false', 'true')} = 'true' AS named, {of_sql('o_orderkey', 'true', 'false', 'false', 'false', 'false')} = 'true' AS phrase FROM orders")
def t18(spark, sf):
    label, text = of("o_orderkey", *LABELS), F.lit(PASSAGE)
    return D.table(spark, sf, "orders").select("o_orderkey", statements.named_in(label, text).alias("named"), statements.phrase_in(label, text).alias("phrase"))


YEARS = ("called +45 2031 4455 in 2019", "Q3 2024 and H1 2023", "last year it fell", "in the 1990s", "no year", "20191 is none, 2018 is")


@query("t17_allowed_years", f"SELECT o_orderkey, {of_sql('o_orderkey', '2019,2020', '2020,2023,2024', '2019,2020', '1990,1991,1992,1993,1994,1995,1996,1997,1998,1999,2020', '2020', '2018,2020')} AS years FROM orders")
def t17(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", F.array_join(statements.allowed_years(of("o_orderkey", *YEARS), F.lit("2020-05")), ",").alias("years"))


@query("t21_world_time", """WITH s AS (SELECT l_orderkey AS statement, CASE WHEN l_orderkey % 4 = 0 THEN DATE '1995-01-01' END AS a, CASE WHEN l_orderkey % 8 = 0 THEN DATE '1996-01-01' END AS b, CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_shipdate AS DATE) END AS p FROM lineitem),
  g AS (SELECT statement, any_value(a) AS a, any_value(b) AS b, max(p) AS p FROM s GROUP BY 1)
  SELECT statement, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'stated' WHEN p IS NOT NULL THEN 'asserted' ELSE 'open' END AS basis, a AS "start", CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN b ELSE p END AS "end" FROM g""")
def t21(spark, sf):
    k = F.col("l_orderkey")
    lines = D.table(spark, sf, "lineitem").select(k.alias("statement"), F.when(k % 4 == 0, F.lit("1995-01-01").cast("date")).alias("start"), F.when(k % 8 == 0, F.lit("1996-01-01").cast("date")).alias("end"), F.concat_ws("/", k, "l_linenumber").alias("passage"), F.concat_ws("/", "l_suppkey", "l_shipdate").alias("source"), "l_suppkey", F.col("l_shipdate").cast("date").alias("published"))
    sources = lines.select("source", F.when(F.col("l_suppkey") % 3 > 0, F.col("published")).alias("published")).distinct()
    return statements.world_time(lines.select("statement", "start", "end", "passage"), lines.select("passage", "source"), sources)


@query("t22_review_status", """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 4 AS n FROM orders), a AS (SELECT l_orderkey AS k, max(CASE WHEN l_linenumber % 7 = 5 THEN 1 ELSE 0 END) AS gone, max(CASE WHEN l_linenumber % 7 = 2 THEN 1 ELSE 0 END) AS held FROM lineitem GROUP BY 1)
  SELECT s.k AS statement, CASE WHEN a.gone = 1 THEN 'withdrawn' WHEN n = 0 THEN 'clean' WHEN a.held = 1 THEN 'reviewed' ELSE 'unreviewed' END AS status FROM s LEFT JOIN a USING (k)""")
def t22(spark, sf):
    s = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("statement"), F.lit("The council may  say so\nin May").alias("quote"), (F.col("o_orderkey") % 4).alias("n_items"))
    n = F.col("l_linenumber") % 7
    answers = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("statement"), F.when(n == 5, "withdrawn").otherwise("stated").alias("decision"), F.when(n == 2, "say so IN may").when(n == 3, "may say").when(n == 4, "not in the quote").alias("words"))
    return statements.review_status(s, answers)


@query("m8_counting", "WITH c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT o_orderkey AS id FROM orders LEFT JOIN c ON c.k = o_orderkey WHERE o_orderkey % 2 = 0 OR c.k IS NOT NULL")
def m8(spark, sf):
    records = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 != 0).alias("inherited"))
    reviews = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.when(F.col("l_returnflag") == "R", "confirmed").otherwise("refused").alias("decision"))
    return statements.counting(records, reviews).select("id")


@query("m6_effective_act", """WITH d AS (SELECT l_orderkey AS k, arg_max(CASE l_linenumber % 3 WHEN 0 THEN 'verifies' WHEN 1 THEN 'questions' ELSE 'repeats' END, l_linenumber) AS act FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
  r AS (SELECT o_orderkey AS k, 1 + o_orderkey % 2 AS n, o_orderkey % 5 = 0 AS inferred FROM orders)
  SELECT r.k AS statement, coalesce(d.act, CASE WHEN inferred THEN 'inferred' WHEN n = 1 THEN 'endorses' ELSE 'attributes' END) AS act FROM r LEFT JOIN d USING (k)""")
def m6(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("statement"), F.explode(F.sequence(F.lit(1), (F.lit(1) + F.col("o_orderkey") % 2).cast("int"))).alias("depth"))
    chain = o.withColumn("verb", F.when((F.col("depth") == 1) & (F.col("statement") % 5 == 0), "infers").otherwise("says"))
    declared = D.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("statement"), of("l_linenumber", "verifies", "questions", "repeats").alias("act"), F.col("l_linenumber").alias("seq"))
    return statements.effective_act(chain, declared)


@query("u4_evidence", """WITH d AS (SELECT l_orderkey AS k, 'e' || (l_suppkey % 3) AS e, min(l_linenumber) AS s FROM lineitem GROUP BY 1, 2),
  v AS (SELECT DISTINCT l_orderkey AS k, 'check:' || (l_orderkey % 10) AS e, 99 AS s FROM lineitem WHERE l_returnflag = 'R'),
  a AS (SELECT * FROM d UNION ALL SELECT * FROM v) SELECT k AS statement, CAST(row_number() OVER (PARTITION BY k ORDER BY s, e) AS INTEGER) AS place, e AS evidence FROM a""")
def u4(spark, sf):
    lines = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("statement"), F.concat(F.lit(" e"), (F.col("l_suppkey") % 3).cast("string")).alias("evidence"), F.col("l_linenumber").cast("long").alias("seq"), F.when(F.col("l_returnflag") == "R", "verifies").otherwise("repeats").alias("act"))
    sources = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("statement"), (F.col("o_orderkey") % 10).cast("string").alias("source"))
    return statements.evidence_of(lines.select("statement", "evidence", "seq"), lines.select("statement", "act"), sources)


@query("u5_repeated_ids", "SELECT l_partkey * 10 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def u5(spark, sf):
    return statements.repeated_ids(D.table(spark, sf, "lineitem").select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id")))


@query("g12_origin_warnings", """WITH s AS (SELECT DISTINCT c_nationkey AS outlet, 'g' || (c_custkey % 4) AS g FROM customer WHERE c_custkey % 4 > 1 OR c_custkey % 3 = 0 AND c_custkey % 4 = 1)
  SELECT outlet, count(*) AS n_groups, string_agg(g, ',' ORDER BY g) AS groups FROM s GROUP BY 1 HAVING count(*) > 1""")
def g12(spark, sf):
    k = F.col("c_custkey")
    s = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("outlet"), F.concat(F.lit("g"), (k % 4).cast("string"), F.lit(" ")).alias("origin"), F.when((k % 4 > 1) | ((k % 3 == 0) & (k % 4 == 1)), "same wire").otherwise(" ").alias("basis"))
    return statements.origin_warnings(s)


# ---- reports -------------------------------------------------------------------------------------
@query("o5_most_common", "WITH c AS (SELECT props AS value, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1), r AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank, value, n FROM c) SELECT * FROM r WHERE rank <= 20")
def o5(spark, sf):
    return reports.most_common(D.table(spark, sf, "events"), "props", "event_id", 20)


@query("o8_company_index", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS name FROM customer")
def o8(spark, sf):
    c = D.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    return reports.index_order(c, "name", "c_custkey")


@query("w9_last_time", "WITH t AS (SELECT DISTINCT user_id AS tool FROM events), l AS (SELECT user_id AS tool, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1) SELECT tool, coalesce(last, TIMESTAMP '1970-01-01') AS last FROM t LEFT JOIN l USING (tool)")
def w9(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("tool"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "event_type")
    return reports.last_time(e.filter("event_type = 'error'"), e.select("tool").distinct(), "1970-01-01 00:00:00")


@query("w6_packet_reviews", "SELECT user_id AS packet, event_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events WHERE event_type = 'view'")
def w6(spark, sf):
    e = D.table(spark, sf, "events").filter("event_type = 'view'").select(F.col("user_id").alias("packet"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return reports.packet_reviews(e).select("packet", "seq", "place")


def _graph(spark, sf):
    """Nodes and edges: an order's claim with a customer as subject and a nation as object, reported by a clerk."""
    o = D.table(spark, sf, "orders").join(D.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    clerk = F.concat(F.lit("Clerk "), (F.col("o_custkey") % 10).cast("string"))
    kinds = (("subject", key("c", "o_orderkey"), key("e", "o_custkey"), F.lit(True)), ("object", key("c", "o_orderkey"), key("n", "c_nationkey"), F.col("o_orderkey") % 3 > 0), ("by", key("r", "o_orderkey"), clerk, F.lit(True)), ("rel:in", key("e", "o_custkey"), key("n", "c_nationkey"), F.col("o_orderkey") % 2 == 0))
    edges = None
    for kind, src, dst, when in kinds:
        part = o.filter(when).select(src.alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"))
        edges = part if edges is None else edges.unionByName(part)
    nodes = o.select(key("c", "o_orderkey").alias("id"), F.lit("claim").alias("kind"), F.col("o_orderpriority").alias("label"))
    nodes = nodes.unionByName(o.select(key("r", "o_orderkey").alias("id"), F.lit("report").alias("kind"), F.col("o_orderstatus").alias("label"))).unionByName(o.select(clerk.alias("id"), F.lit("entity").alias("kind"), F.lower(clerk).alias("label")).distinct())
    return nodes, edges


GRAPH = "g AS (SELECT o_orderkey AS k, o_custkey AS e, c_nationkey AS n, 'clerk ' || (o_custkey % 10) AS clerk, o_orderpriority AS label, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("j11_claim_ends", f"WITH {GRAPH} SELECT 'c' || k AS id, label, 'e' || e AS subject, CASE WHEN k % 3 > 0 THEN 'n' || n END AS object FROM g")
def j11(spark, sf):
    return reports.claims_with_ends(*_graph(spark, sf))


@query("j12_speaker_labels", f"WITH {GRAPH} SELECT 'r' || k AS report, clerk || ' (' || st || ')' AS speaker FROM g")
def j12(spark, sf):
    return reports.speaker_labels(*_graph(spark, sf))


@query("g11_neighbours", f"WITH {GRAPH} SELECT 'n' || n AS entity, 'e' || e AS src, 'rel:in' AS kind, 'n' || n AS dst FROM g WHERE k % 2 = 0 AND n < 5")
def g11(spark, sf):
    _, edges = _graph(spark, sf)
    entities = D.table(spark, sf, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity"))
    return reports.neighbours(edges, entities)


STATED = "s AS (SELECT l_partkey AS subject, l_linestatus AS relation, l_suppkey AS source, CASE WHEN l_suppkey % 3 > 0 THEN 'o' || (l_suppkey % 5) END AS origin, l_linenumber AS evidence, CAST(l_quantity AS BIGINT) AS value, CASE l_orderkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'unreviewed' ELSE 'withdrawn' END AS status FROM lineitem)"


def _stated(spark, sf):
    return D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_linestatus").alias("relation"), F.col("l_suppkey").alias("source"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("o"), (F.col("l_suppkey") % 5).cast("string"))).alias("origin"), F.col("l_linenumber").alias("evidence"), F.col("l_quantity").cast("long").alias("value"), of("l_orderkey", "clean", "reviewed", "unreviewed", "withdrawn").alias("status"))


@query("a18_compared", f"WITH {STATED} SELECT subject, relation, count(DISTINCT source) AS sources, count(DISTINCT coalesce(origin, 'source:' || source)) AS origins, count(DISTINCT evidence) AS rests_on, count(DISTINCT value) AS values, count(*) AS rows FROM s WHERE status IN ('clean', 'reviewed') GROUP BY 1, 2 HAVING count(DISTINCT source) > 1")
def a18(spark, sf):
    return reports.compared(_stated(spark, sf))


@query("m10_workspace_status", f"WITH {STATED} SELECT status, count(*) AS n, count(DISTINCT source) AS sources FROM s GROUP BY 1")
def m10(spark, sf):
    return reports.workspace_status(_stated(spark, sf))


@query("a29_scored", """WITH r AS (SELECT l_linestatus AS set_name, CASE l_linenumber % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'accept' END AS v, l_suppkey % 3 > 0 AS ok FROM lineitem)
  SELECT set_name, count(*) FILTER (WHERE v IS NOT NULL AND (v = 'accept') = ok) AS passed, count(*) FILTER (WHERE v IS NOT NULL AND (v = 'accept') <> ok) AS failed, count(*) FILTER (WHERE v IS NULL) AS unassessed,
    count(*) FILTER (WHERE v = 'accept' AND NOT ok) * 1.0::DOUBLE / nullif(count(*) FILTER (WHERE v IS NOT NULL AND NOT ok), 0) AS false_accept_rate, count(*) FILTER (WHERE v = 'reject' AND ok) * 1.0::DOUBLE / nullif(count(*) FILTER (WHERE v IS NOT NULL AND ok), 0) AS false_reject_rate FROM r GROUP BY 1""")
def a29(spark, sf):
    r = D.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("set_name"), of("l_linenumber", "accept", "reject", "accept", None).alias("verdict"), (F.col("l_suppkey") % 3 > 0).alias("supported"))
    return reports.scored(r, "set_name")


@query("a24_contradiction_rates", "SELECT l_linestatus AS kind, count(DISTINCT l_orderkey) AS companies, count(*) AS total, (SELECT count(*) FROM orders) AS of FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def a24(spark, sf):
    pairs = D.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("company"), F.col("l_linestatus").alias("kind"))
    return reports.contradiction_rates(pairs, D.companies(spark, sf))


@query("a31_ages_compared", """WITH f AS (SELECT l_orderkey AS k, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), r AS (SELECT CASE WHEN f.d IS NULL THEN 'unknown' WHEN f.d < CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) THEN 'before' WHEN f.d > CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) THEN 'after' ELSE 'same' END AS age FROM orders LEFT JOIN f ON f.k = o_orderkey)
  SELECT age, count(*) AS n FROM r GROUP BY 1""")
def a31(spark, sf):
    first = D.table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.col("l_shipdate").cast("date")).alias("d"))
    own = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int"))
    return D.table(spark, sf, "orders").join(first, "o_orderkey", "left").groupBy(reports.ages_compared(F.col("d"), own).alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query("a30_dual_countries", "WITH w AS (SELECT DISTINCT l_orderkey AS work, CASE WHEN l_suppkey % 4 > 0 THEN 'C' || (l_suppkey % 4) END AS c FROM lineitem) SELECT work, count(c) AS n_countries, string_agg(c, ',' ORDER BY c) AS countries FROM w GROUP BY 1 HAVING count(c) > 1")
def a30(spark, sf):
    k = F.col("l_suppkey") % 4
    return reports.dual_countries(D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("work"), F.when(k > 0, F.concat(F.lit("C"), k.cast("string"))).alias("country")))


@query("a34_author_candidates", f"SELECT {PLAIN.format(x='n')} AS norm, author, count(DISTINCT work) AS works, count(DISTINCT aff) AS affiliations FROM (SELECT {of_sql('l_suppkey', *NAMES)} AS n, l_suppkey AS author, l_orderkey AS work, l_returnflag AS aff FROM lineitem) GROUP BY 1, 2")
def a34(spark, sf):
    w = D.table(spark, sf, "lineitem").select(N.normal_name(of("l_suppkey", *NAMES)).alias("norm"), F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("work"), F.col("l_returnflag").alias("affiliation"))
    return reports.author_candidates(w)


@query("a23_jurisdictions", """WITH r AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'case' ELSE 'control' END AS arm, l_orderkey AS d, CASE WHEN l_suppkey % 6 > 0 THEN 'C' || (l_suppkey % 6) END AS c FROM lineitem),
  e AS (SELECT arm, d, count(DISTINCT c) AS n, max(CASE WHEN c IN ('C4', 'C5') THEN 1 ELSE 0 END) AS hit FROM r WHERE c IS NOT NULL GROUP BY 1, 2)
  SELECT arm, count(*) AS domains, count(*) FILTER (WHERE n > 1) AS several, count(*) FILTER (WHERE hit = 1) AS watched, count(*) FILTER (WHERE hit = 1) / CAST(count(*) AS DOUBLE) AS rate FROM e GROUP BY 1""")
def a23(spark, sf):
    k = F.col("l_suppkey") % 6
    r = D.table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 2 == 0, "case").otherwise("control").alias("arm"), F.col("l_orderkey").alias("domain"), F.when(k > 0, F.concat(F.lit("C"), k.cast("string"))).alias("country"))
    return reports.jurisdictions(r, ("C4", "C5"))


@query("i20_cohort", """WITH p AS (SELECT l_orderkey AS page, l_linenumber AS pos, l_suppkey AS company, CASE WHEN l_orderkey % 3 = 0 THEN 'case' ELSE 'control' END AS arm FROM lineitem WHERE l_orderkey % 5 > 0)
  SELECT company, arg_min(arm, page * 100 + pos) AS arm, arg_min(page, page * 100 + pos) AS page FROM p GROUP BY 1""")
def i20(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    pages = lines.groupBy(F.col("l_orderkey").alias("page")).agg(items.alias("companies")).withColumn("tag", (F.col("page") % 15).cast("string"))
    labels = spark.range(15).filter("id % 5 > 0").select(F.col("id").cast("string").alias("tag"), F.when(F.col("id") % 3 == 0, "case").otherwise("control").alias("arm"))
    return reports.cohort(pages, labels)


@query("i29_first_pages", "WITH r AS (SELECT user_id AS resource_id, event_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'click') SELECT resource_id, page FROM r WHERE rn = 1")
def i29(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("resource_id"), F.col("event_id").alias("page"), F.col("event_id").alias("seq"), F.col("event_type").alias("tag"))
    return reports.first_pages(e, "click").select("resource_id", "page")


@query("i3_blob_read", "SELECT event_id AS seq, CASE WHEN length(props) % 2 = 0 THEN props END AS body FROM events")
def i3(spark, sf):
    log = D.fetches(spark, sf).select("seq", "content_hash")
    e = D.table(spark, sf, "events").select("props").distinct().filter(F.length("props") % 2 == 0)
    blobs = e.select(F.md5(F.col("props").cast("binary")).alias("content_hash"), F.col("props").alias("body"))
    return reports.blob_text(log, blobs).select("seq", "body")


@query("i24_licensed", "SELECT event_id AS seq, event_type IN ('view', 'click') AS quotable FROM events")
def i24(spark, sf):
    registry = spark.createDataFrame([("view", "open"), ("click", "ATTRIBUTION"), ("purchase", "closed")], "source string, licence string")
    return reports.licensed(D.fetches(spark, sf).select("seq", "source"), registry).select("seq", "quotable")


@query("a14_smoothed_ratio", """WITH c AS (SELECT o_orderpriority AS p, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS a, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderkey % 3 = 0) AS c, count(*) FILTER (WHERE o_orderstatus <> 'F') AS m FROM orders GROUP BY 1)
  SELECT p, round(((a + 0.5::DOUBLE) / (n + 1)) / ((c + 0.5::DOUBLE) / (m + 1)), 9) AS ratio FROM c""")
def a14(spark, sf):
    case, hit = F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3 == 0
    c = D.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count_if(case & hit).alias("a"), F.count_if(case).alias("n"), F.count_if(~case & hit).alias("c"), F.count_if(~case).alias("m"))
    return c.select("p", F.round(stats.smoothed_ratio(*map(F.col, "ancm")), 9).alias("ratio"))


# ---- register documents ----------------------------------------------------------------------------
def _documents(spark, sf):
    """One stored document for each order, in one of three shapes: holders are its lines, attributes its priority."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    period = lambda a, b=none: F.struct(day(a).alias("gyldigFra"), b.alias("gyldigTil"))
    value = lambda v, p: F.array(F.struct(v.cast("string").alias("vaerdi"), p.alias("periode")))
    kind = of("l_suppkey", "PERSON", "VIRKSOMHED", "ANDEN_DELTAGER")
    name = F.when(F.col("l_suppkey") % 2 == 0, "Handel GmbH").otherwise("Someone")
    is_board = F.col("l_linenumber") % 3 == 0
    share = F.struct(F.lit("EJERANDEL_PROCENT").alias("type"), value(F.col("l_quantity").cast("int") / 100, period("l_shipdate")).alias("vaerdier"))
    seat = F.struct(F.lit("FUNKTION").alias("type"), value(F.lit("chair"), period("l_shipdate")).alias("vaerdier"))
    member = F.array(F.struct(period("l_shipdate").alias("periode"), F.array(F.when(is_board, seat).otherwise(share)).alias("attributter")))
    organ = F.array(F.struct(F.when(is_board, "LEDELSESORGAN").otherwise("REGISTER").alias("hovedtype"), F.array(F.struct(F.lit("x").alias("navn"))).alias("organisationsNavn"), member.alias("medlemsData")))
    party = F.struct(F.col("l_suppkey").alias("enhedsNummer"), kind.alias("enhedstype"), (F.col("l_suppkey") * 11).alias("forretningsnoegle"), F.array(F.struct(name.alias("navn"))).alias("navne"))
    lines = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(party.alias("deltager"), organ.alias("organisationer"))).alias("rel"))
    o = D.table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    secret = F.array(F.struct(F.lit("w.example").alias("kontaktoplysning"), (k % 2 == 0).alias("hemmelig"), period("o_orderdate").alias("periode")))
    company = F.struct(
        k.alias("cvrNummer"),
        F.array(F.struct(F.col("o_orderpriority").alias("navn"), period("o_orderdate").alias("periode"))).alias("navne"),
        F.array(F.struct(F.col("o_orderstatus").alias("status"), period("o_orderdate").alias("periode"))).alias("virksomhedsstatus"),
        secret.alias("hjemmeside"),
        F.array(F.struct(F.when(k % 3 == 0, "KAPITAL").otherwise("NOT_MAPPED").alias("type"), value(k, period("o_orderdate")).alias("vaerdier"))).alias("attributter"),
        F.struct(F.when(k % 5 == 0, "UNDERKONKURS").alias("sammensatStatus"), F.when(k % 4 == 0, day("o_orderdate")).alias("stiftelsesDato")).alias("virksomhedMetadata"),
        F.col("rel").alias("deltagerRelation"),
    )
    bare = F.to_json(F.struct(company.alias("Vrvirksomhed")))
    wrapped = F.when(k % 3 == 0, bare).when(k % 3 == 1, F.concat(F.lit('{"hits":{"hits":[{"_source":'), bare, F.lit("}]}}"))).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    return o.select(wrapped.alias("json"))


NUMBERED = "n AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS me, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders)"


@query("s2_company_claims", f"""WITH {NUMBERED} SELECT me AS subject_key, 'has_name' AS predicate, p AS object_repr, d AS valid_from FROM n UNION ALL SELECT me, 'has_status', s, d FROM n UNION ALL SELECT me, 'has_website', 'w.example', d FROM n WHERE k % 2 <> 0
  UNION ALL SELECT me, 'capital_changed', CAST(k AS VARCHAR), d FROM n WHERE k % 3 = 0 UNION ALL SELECT me, 'has_status', 'UNDERKONKURS', d FROM n WHERE k % 5 = 0 UNION ALL SELECT me, 'founded_on', CAST(d AS VARCHAR), NULL FROM n WHERE k % 4 = 0""")
def s2(spark, sf):
    from claimwright.sources import register

    return register.company_claims(register.unwrapped(_documents(spark, sf))).select("subject_key", "predicate", "object_repr", "valid_from")


PARTY = "CASE l_suppkey % 3 WHEN 0 THEN 'p:' || l_suppkey WHEN 1 THEN CASE WHEN list_sum([CAST(substr(num, i, 1) AS INTEGER) * ([2,7,6,5,4,3,2,1])[i] FOR i IN range(1, 9)]) % 11 = 0 THEN num ELSE 'enh:' || l_suppkey END ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'fp:' WHEN l_suppkey % 2 = 0 THEN 'fc:' ELSE 'anden:' END || l_suppkey END"


@query("s5_relation_claims", f"""WITH l AS (SELECT *, lpad(CAST(l_suppkey * 11 AS VARCHAR), 8, '0') AS num FROM lineitem)
  SELECT {PARTY} AS subject_key, CASE WHEN l_linenumber % 3 = 0 THEN 'has_role' ELSE 'owns' END AS predicate, lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS object_repr, CAST(l_shipdate AS DATE) AS valid_from,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS BIGINT) * 100 END AS share_bp, CASE WHEN l_linenumber % 3 = 0 THEN 'chair' END AS role FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def s5(spark, sf):
    from claimwright.sources import register

    rel = register.relation_claims(register.unwrapped(_documents(spark, sf)))
    return rel.select("subject_key", "predicate", "object_repr", "valid_from", F.round(F.col("share") * 10000).cast("long").alias("share_bp"), "role")


def _second(spark, sf):
    c = F.col("c_custkey")
    person = F.struct(of("c_custkey", "J", "F", "F").alias("isiku_tyyp"), F.lit("Ann").alias("eesnimi"), F.col("c_name").alias("nimi_arinimi"), F.when(c % 2 == 0, c.cast("string")).otherwise("").alias("isikukood_registrikood"), F.concat((c % 90).cast("string"), F.lit(",5")).alias("osaluse_protsent"), F.lit("01.02.2019").alias("algus_kpv"))
    return D.table(spark, sf, "customer").select(c.cast("string").alias("code"), F.col("c_name").alias("name"), F.lit("R").alias("status"), F.when(c % 4 == 0, "registered").alias("status_text"), F.when(c % 3 == 0, "OÜ").alias("legal_form"), F.when(c % 5 > 0, "07.02.2013").alias("registered"), F.lit("Tee 1").alias("address"), F.to_json(F.array(person)).alias("osanikud"))


@query("s10_second_register", """WITH c AS (SELECT c_custkey AS k, 'ee:' || c_custkey AS me, c_name, CASE WHEN c_custkey % 5 > 0 THEN DATE '2013-02-07' END AS d FROM customer)
  SELECT me AS subject_key, 'has_name' AS predicate, c_name AS object_repr, d AS valid_from FROM c UNION ALL SELECT me, 'has_status', CASE WHEN k % 4 = 0 THEN 'registered' ELSE 'R' END, d FROM c UNION ALL SELECT me, 'has_form', 'OÜ', d FROM c WHERE k % 3 = 0
  UNION ALL SELECT me, 'founded_on', '2013-02-07', NULL FROM c WHERE d IS NOT NULL UNION ALL SELECT me, 'registered_at', 'ee-addr:tee 1', d FROM c""")
def s10(spark, sf):
    from claimwright.sources import second_register

    return second_register.company_claims(_second(spark, sf)).select("subject_key", "predicate", "object_repr", "valid_from")


@query("i9_holders", """SELECT CASE WHEN c_custkey % 2 = 1 THEN 'name:ann ' || lower(c_name) WHEN c_custkey % 3 = 0 THEN 'ee:' || c_custkey ELSE 'ee-person:' || c_custkey END AS subject_key, 'ee:' || c_custkey AS object_repr, DATE '2019-02-01' AS valid_from, CAST(c_custkey % 90 * 100 + 50 AS BIGINT) AS share_bp FROM customer WHERE c_custkey % 7 = 0""")
def i9(spark, sf):
    from claimwright.sources import second_register

    rows = _second(spark, sf)
    wanted = rows.filter("code % 7 = 0").select("code")
    claims = second_register.holder_claims(second_register.holders(rows, wanted))
    return claims.select("subject_key", "object_repr", "valid_from", F.round(F.col("share") * 10000).cast("long").alias("share_bp"))


WALLS = ("Please verify you are human", "short", "a page that is long enough to be read " * 4, "captcha " + "and words that make the page longer than any wall " * 70)


@query("t7_wall_kinds", f"SELECT page_id, {of_sql('page_id', 'wall', 'empty', None, None)} AS reason FROM pages")
def t7_kinds(spark, sf):
    from claimwright.functions.scalars import is_wall

    return D.table(spark, sf, "pages").select("page_id", is_wall(of("page_id", *WALLS)).alias("reason"))


STATEMENTS = ("Founded in 1998. Established back in 2004, with 1.200 employees.", "0 people at first, then a team of 40", "since long ago, nobody counts", "etableret 1875")


@query("s19_page_statements", """SELECT page_id, x.f AS founded, x.e AS employees FROM (SELECT page_id, unnest(CASE page_id % 4 WHEN 0 THEN [{'f': 1998, 'e': NULL}, {'f': 2004, 'e': NULL}, {'f': NULL, 'e': 1200}] WHEN 1 THEN [{'f': NULL, 'e': 40}] WHEN 2 THEN [{'f': NULL, 'e': NULL}] ELSE [{'f': 1875, 'e': NULL}] END) AS x FROM pages)""")
def s19_statements(spark, sf):
    from claimwright.operators import evidence

    return evidence.website_facts(D.table(spark, sf, "pages").select("page_id", of("page_id", *STATEMENTS).alias("text")), "page_id")


@query("s14_import_audit", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS r FROM orders WHERE o_orderkey % 3 = 0)
  SELECT f AS field, CASE f WHEN 'deltagerRelation' THEN r ELSE n END AS documents, o AS outcome, w AS reason FROM n, (VALUES ('cvrNummer', 'ignored', 'the key'), ('navne', 'imported', NULL), ('virksomhedsstatus', 'imported', NULL), ('hjemmeside', 'imported', NULL), ('attributter', 'dropped', NULL), ('virksomhedMetadata', 'dropped', NULL), ('deltagerRelation', 'ignored', 'made by relation claims')) v(f, o, w)""")
def s14(spark, sf):
    from claimwright.sources import register

    docs = _documents(spark, sf).filter(F.col("json").startswith('{"Vr'))
    required = {"navne": "has_name", "virksomhedsstatus": "has_status", "hjemmeside": "has_website", "attributter": "never_made"}
    return register.import_audit(docs, register.company_claims(register.unwrapped(docs)), required, {"cvrNummer": "the key", "deltagerRelation": "made by relation claims"})


# ---- pages ------------------------------------------------------------------------------------------
BLOCKS = (
    "CVR-nr. 12 34 56 78 and VAT DK10000009, cvr: 00000051",
    "We are part of Nordic Steel Group, owned by the Big Blue Holding. Kontakt",
    "Havnegade 12, 2200 København N Tlf 1234, 2010 Year, 8000 Aarhusgade",
    "Anna Berg, founder of the firm",
    "nothing to see",
    "Bo Holm ceo and Ida Lund cfo",
)


def _block(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", of("page_id", *BLOCKS).alias("text"))


@query("s18_identifiers", f"SELECT page_id, {of_sql('page_id', 'DK10000009|DK00000051', '', '', '', '', '')} AS found FROM pages")
def s18(spark, sf):
    from claimwright.functions import website

    return _block(spark, sf).select("page_id", F.array_join(website.stated_identifiers(F.col("text")), "|").alias("found"))


@query("s21_groups", f"SELECT page_id, {of_sql('page_id', '', 'Nordic Steel Group|the Big Blue Holding', '', '', '', '')} AS found FROM pages")
def s21(spark, sf):
    from claimwright.functions import website

    return _block(spark, sf).select("page_id", F.array_join(website.stated_groups(F.col("text")), "|").alias("found"))


@query("s22_towns", f"SELECT page_id, {of_sql('page_id', '', '', '2200 København N', '', '', '')} AS found FROM pages")
def s22(spark, sf):
    from claimwright.functions import website

    return _block(spark, sf).select("page_id", F.array_join(website.stated_towns(F.col("text")), "|").alias("found"))


@query("s23_people", f"SELECT page_id, {of_sql('page_id', '', '', '', 'Anna Berg:founder:11', '', '')} AS found FROM pages")
def s23(spark, sf):
    from claimwright.functions import website

    people = F.transform(website.stated_people("text"), lambda p: F.concat_ws(":", p["name"], p["role"], p["distance"]))
    return _block(spark, sf).select("page_id", F.array_join(people, "|").alias("found"))


# ---- publications and patents -----------------------------------------------------------------------
def _author_json(spark, sf):
    k = F.col("l_orderkey")
    line = F.struct(F.struct(F.concat(F.lit("https://o.example/I"), F.col("l_suppkey").cast("string")).alias("id"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("https://ror.example/r"), F.col("l_suppkey").cast("string"))).alias("ror"), F.when(F.col("l_suppkey") % 5 > 0, "Inst").alias("display_name"), F.lit("DK").alias("country_code")).alias("institution"), F.array(F.year("l_shipdate"), F.year("l_shipdate") + 1).alias("years"))
    a = D.table(spark, sf, "lineitem").groupBy(k).agg(F.collect_list(line).alias("affiliations"))
    author = F.to_json(F.struct(F.concat(F.lit("https://o.example/A"), k.cast("string")).alias("id"), F.when(k % 7 > 0, "Ann").alias("display_name"), "affiliations"))
    return a.select(F.when(k % 2 == 0, author).otherwise(F.concat(F.lit('{"results":['), author, F.lit("]}"))).alias("json"))


@query("s13_affiliations", """WITH y AS (SELECT *, unnest([year(l_shipdate), year(l_shipdate) + 1]) AS y FROM lineitem WHERE l_orderkey % 7 > 0 AND l_suppkey % 5 > 0)
  SELECT 'openalex:A' || l_orderkey AS subject_key, CASE WHEN l_suppkey % 2 = 0 THEN 'ror:r' || l_suppkey ELSE 'openalex:I' || l_suppkey END AS object_key, 'DK' AS country, make_date(y, 1, 1) AS valid_from, make_date(y, 12, 31) AS valid_to FROM y""")
def s13(spark, sf):
    from claimwright.sources import publications

    return publications.author_affiliations(_author_json(spark, sf))


@query("s13_work_claims", """WITH w AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, CASE WHEN l_orderkey % 3 = 0 THEN DATE '2020-01-01' ELSE CAST(l_shipdate AS DATE) END AS d FROM lineitem WHERE l_linenumber < 8)
  SELECT 'openalex:A1' AS subject_key, 'has_affiliation' AS predicate, 'openalex:I' || s AS object_key, 'W' || k || '-' || n AS work, d AS valid_from FROM w
  UNION ALL SELECT 'openalex:A1', 'co_authored_with', 'openalex:A' || (s + 2), 'W' || k || '-' || n, d FROM w""")
def s13_works(spark, sf):
    from claimwright.sources import publications

    k, s = F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")
    person = lambda ident, name: F.struct(F.concat(F.lit("https://o.example/A"), ident).alias("id"), F.lit(name).alias("display_name"))
    inst = F.array(F.struct(F.concat(F.lit("https://o.example/I"), s).alias("id"), F.lit("Inst").alias("display_name")))
    authors = F.array(F.struct(person(F.lit("1"), "Me").alias("author"), inst.alias("institutions")), F.struct(person((F.col("l_suppkey") + 2).cast("string"), "Other").alias("author"), inst.alias("institutions")))
    work = F.struct(F.concat(F.lit("https://o.example/W"), k, F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_orderkey") % 3 > 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("publication_date"), F.lit(2020).alias("publication_year"), authors.alias("authorships"))
    docs = D.table(spark, sf, "lineitem").filter("l_linenumber < 8").select(F.to_json(F.struct(F.array(work).alias("results"))).alias("json"))
    return publications.work_claims(docs, "A1")


@query("s11_patent_claims", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'EP' || c_custkey ELSE 'DK' || c_custkey || 'A1' END AS n, DATE '2015-03-04' AS d FROM customer WHERE c_custkey > 0)
  SELECT 'name:acme ' || k AS subject_key, 'holds_patent_application' AS predicate, 'patent:' || n AS object_key, d AS valid_from, 'DK' AS country FROM c
  UNION ALL SELECT 'name:bo berg', 'named_as_inventor', 'patent:' || n, d, '' FROM c WHERE k % 3 = 0""")
def s11(spark, sf):
    from claimwright.sources import publications

    c = D.table(spark, sf, "customer").filter("c_custkey > 0")
    k = F.col("c_custkey").cast("string")
    scalar = lambda v: F.concat(F.lit('{"$":"'), v, F.lit('"}'))
    ident = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('[{"@document-id-type":"docdb","doc-number":{"$":"9"}},{"@document-id-type":"epodoc","doc-number":'), scalar(F.concat(F.lit("EP"), k)), F.lit(',"date":{"$":"20150304"}}]')))
    ident = ident.otherwise(F.concat(F.lit('{"@document-id-type":"docdb","country":{"$":"DK"},"kind":{"$":"A1"},"date":{"$":"20150304"},"doc-number":'), scalar(k), F.lit("}")))
    applicant = lambda name: F.concat(F.lit('{"applicant-name":{"name":'), scalar(name), F.lit("}}"))
    inventors = F.when(F.col("c_custkey") % 3 == 0, F.lit(',"inventors":{"inventor":{"inventor-name":{"name":{"$":"Bo  Berg"}}}}')).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"exchange-document":{"bibliographic-data":{"publication-reference":{"document-id":'), ident, F.lit('},"parties":{"applicants":{"applicant":['), applicant(F.concat(F.lit("ACME "), k, F.lit(" [DK]"))), F.lit(","), applicant(F.concat(F.lit("Acme "), k)), F.lit("]}"), inventors, F.lit("}}}}"))
    many = F.when(F.col("c_custkey") % 5 == 0, doc).otherwise(F.concat(F.lit("["), doc, F.lit("]")))
    return publications.patent_claims(c.select(F.concat(F.lit('{"ops:world-patent-data":{"ops:biblio-search":{"ops:search-result":{"exchange-documents":'), many, F.lit("}}}}")).alias("json")))


@query("s12_transfers", "SELECT event_id AS publication, 'Transfer Of Rights' AS description, CASE WHEN event_id % 2 = 0 THEN DATE '2014-05-06' END AS valid_from FROM events WHERE event_type = 'purchase'")
def s12(spark, sf):
    from claimwright.sources import publications

    text = F.when(F.col("event_type") == "purchase", "TRANSFER OF RIGHTS").when(F.col("event_type") == "click", "transfer of rights: change of name of the owner").otherwise("FEE PAID")
    slot = lambda d, v: F.struct(F.lit(d).alias("desc"), v.alias("value"))
    slots = F.create_map(F.lit("ops:L001EP"), slot("Code", F.lit("20010101")), F.lit("ops:L007EP"), slot("Gazette date", F.when(F.col("event_id") % 2 == 0, "20140506").otherwise("none")))
    e = D.table(spark, sf, "events").select(F.col("event_id").alias("publication"), text.alias("description"), slots.alias("slots"))
    return publications.transfers(e, ("TRANSFER OF RIGHTS", "ASSIGNMENT"), ("CHANGE OF NAME OF THE OWNER",))


# ---- declarations and graphs ------------------------------------------------------------------------
@query("s25_attestations", "SELECT l_orderkey AS subject, CASE l_linenumber % 3 WHEN 0 THEN 'owns' ELSE 'employs' END AS predicate, CAST(l_suppkey AS VARCHAR) AS value, 'self_declared' AS tier FROM lineitem WHERE l_linenumber % 3 <> 1 AND l_suppkey % 2 = 0")
def s25(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("subject"), of("l_linenumber", "owns", "likes", "employs").alias("predicate"), F.col("l_suppkey").cast("string").alias("value"), F.lit("we  own it\nall").alias("excerpt"), F.when(F.col("l_suppkey") % 2 == 0, "Own it all").otherwise("own none").alias("quote"))
    return statements.attestations(rows, ("owns", "employs"))


@query("s26_observations", "SELECT user_id AS subject, 'analyst_verdict' AS predicate, event_type AS value, 'analyst' AS tier, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM events")
def s26(spark, sf):
    e = D.table(spark, sf, "events")
    return statements.observation_claims(e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("verdict"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))


@query("m5_evidence_status", "SELECT l_suppkey AS evidence, CASE l_linenumber % 3 WHEN 0 THEN 'retracted' ELSE 'disputed' END AS status, l_orderkey AS passage FROM lineitem WHERE l_linenumber % 3 <> 1 AND l_suppkey % 2 = 0 AND l_returnflag <> 'N' AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def m5(spark, sf):
    log = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("evidence"), of("l_linenumber", "retracted", "loved", "disputed").alias("status"), F.col("l_orderkey").alias("passage"), F.when(F.col("l_suppkey") % 2 == 0, "study WAS withdrawn").otherwise("was withdrawn").alias("words"), F.when(F.col("l_returnflag") != "N", "seen").otherwise(" ").alias("note"))
    return statements.evidence_status(log, D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("passage"), F.lit("The study was\nwithdrawn.").alias("text")), ("retracted", "disputed"))


@query("t23_intake", """WITH a AS (SELECT l_partkey AS uid, l_orderkey * 10 + l_linenumber AS seq, l_suppkey % 4 = 0 AS bad, l_suppkey % 3 = 0 AS op, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem)
  SELECT uid, seq, CASE WHEN bad THEN 'refused' WHEN uid % 10 = 0 OR rn > 1 THEN 'duplicate' WHEN op THEN 'open' ELSE 'closed' END AS outcome FROM a""")
def t23(spark, sf):
    k = F.col("l_suppkey")
    atoms = D.placed(spark, sf, "lineitem").select(F.col("l_partkey").alias("uid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (k % 4 == 0).cast("int").alias("defects"), (k % 3 == 0).cast("int").alias("open"), "file", "place")
    held = D.table(spark, sf, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("uid"))
    return statements.intake(atoms, held, ("file", "place"))


@query("t24_cached_verdicts", """WITH w AS (SELECT DISTINCT l_partkey AS span, l_linenumber AS words FROM lineitem), m AS (SELECT span, words FROM w WHERE span % 2 = 1 ORDER BY span, words LIMIT 50)
  SELECT w.span, w.words, CASE WHEN w.span % 2 = 0 THEN 'held' END AS verdict, m.span IS NOT NULL AS ask FROM w LEFT JOIN m ON m.span = w.span AND m.words = w.words""")
def t24(spark, sf):
    w = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("span"), F.col("l_linenumber").alias("words"))
    cache = w.filter("span % 2 = 0").distinct().withColumn("verdict", F.lit("held"))
    return statements.cached_verdicts(w, cache, ["span", "words"], 50)


DATES = ("json-ld datePublished=2025-01-01;meta tag=2025-08-08", "meta tag=2020;pdf:creationdate=2020-03-04", "arxiv=2023-05-02;record pubYear=2024-07-01", "meta tag=2019-01-02;citation meta=2018-05-06", "unknown=2011")


@query("t9_picked_date", f"SELECT o_orderkey, nullif({of_sql('o_orderkey', '2025-08-08', '2020-03-04', '2024-07-01', '2018-05-06', '')}, '') AS date, {of_sql('o_orderkey', 'json-ld datePublished', 'meta tag', 'record pubYear', 'citation meta', 'none')} AS basis, o_orderkey % 5 = 3 AS conflict FROM orders")
def t9(spark, sf):
    c = D.table(spark, sf, "orders").select("o_orderkey", F.posexplode(F.split(of("o_orderkey", *DATES), ";")).alias("pos", "x"))
    return statements.picked_date(c.select("o_orderkey", "pos", F.substring_index("x", "=", 1).alias("basis"), F.substring_index("x", "=", -1).alias("value")), "o_orderkey")


@query("t10_original_date", f"SELECT o_orderkey, nullif({of_sql('o_orderkey', '1998-05', '', '', '', '')}, '') AS original FROM orders")
def t10(spark, sf):
    k = "o_orderkey"
    when, words, note = of(k, "1998-05", "1998-05", "199", "1998", "1999"), of(k, "printed in May 1998", "in 1998", "printed in May 1998", "not there in 1998", "printed in May 1998"), F.lit("a copy")
    return D.table(spark, sf, "orders").select(k, statements.original_date(when, words, note, F.lit("It was printed  in May 1998 by them")).alias("original"))


@query("g6_foreign_expansions", """WITH e AS (SELECT l_suppkey AS person, l_orderkey % 50 AS entity, CASE l_orderkey % 50 % 5 WHEN 0 THEN 'DK' WHEN 1 THEN 'EE' WHEN 2 THEN 'XX' WHEN 3 THEN '' END AS country FROM lineitem)
  SELECT DISTINCT person, entity, country, CASE country WHEN 'EE' THEN 'ariregister' END AS register, CASE country WHEN 'EE' THEN 'EE''s register is ariregister' ELSE 'no connected register covers XX' END AS because FROM e WHERE country IN ('EE', 'XX') AND entity % 7 > 0""")
def g6(spark, sf):
    entity = F.col("l_orderkey") % 50
    e = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("person"), entity.alias("entity"), F.when(entity % 5 == 0, "DK").when(entity % 5 == 1, "EE").when(entity % 5 == 2, "XX").when(entity % 5 == 3, "").alias("country"), F.col("l_orderkey").alias("seq"))
    registers = spark.createDataFrame([("EE", "ariregister"), ("NO", "brreg")], "country string, register string")
    return graph.foreign_expansions(e, registers, spark.range(0, 50, 7).select(F.col("id").alias("entity")), "DK")


@query("g13_lineage", """WITH RECURSIVE h AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 3 WHEN s_suppkey % 10 = 0 THEN NULL ELSE CASE WHEN s_suppkey % 10 = 6 AND s_suppkey % 20 >= 10 THEN s_suppkey + 3 ELSE s_suppkey - 1 END END AS parent FROM supplier),
  c AS (SELECT id, [id] AS chain, parent FROM h UNION ALL SELECT c.id, list_append(c.chain, p.id), p.parent FROM c JOIN h p ON p.id = c.parent WHERE NOT list_contains(c.chain, p.id)),
  l AS (SELECT id, chain, row_number() OVER (PARTITION BY id ORDER BY len(chain) DESC) AS rn FROM c) SELECT id, array_to_string(chain, '>') AS chain FROM l WHERE rn = 1""")
def g13(spark, sf):
    k = F.col("s_suppkey")
    parent = F.when(k % 10 == 9, k - 3).when(k % 10 == 0, None).when((k % 10 == 6) & (k % 20 >= 10), k + 3).otherwise(k - 1)
    found = graph.lineage(D.table(spark, sf, "supplier").select(k.alias("id"), parent.alias("parent")))
    return found.select("id", F.concat_ws(">", F.col("chain").cast("array<string>")).alias("chain"))


def _statement_graph(spark, sf):
    o, k = D.table(spark, sf, "orders"), F.col("o_orderkey")
    o = D.dealt(o.select(k, "o_custkey", "o_orderpriority"), o, "o_orderkey")  # serves statements and reports alike
    s = o.select(k.alias("uid"), F.concat(F.lit("s"), (k % 9).cast("string")).alias("source"), F.col("o_orderpriority").alias("claim"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("subject"), F.when(k % 2 == 0, F.concat(F.lit("e"), (k % 100).cast("string"))).alias("object"), F.when(k % 3 > 0, "owns").alias("predicate"), (k % 11 == 0).cast("int").alias("defects"))
    r = o.select(k.alias("uid"), F.explode(F.sequence(F.lit(0), (k % 2).cast("int"))).alias("depth"))
    return graph.statement_graph(s, r.select("uid", "depth", F.lit("says").alias("verb"), F.concat(F.lit("p"), (F.col("uid") % 5 + F.col("depth")).cast("string")).alias("speaker")))


BUILT = "o AS (SELECT o_orderkey AS k, 'e' || o_custkey AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'e' || (o_orderkey % 100) END AS ob, CASE WHEN o_orderkey % 3 > 0 THEN 'owns' END AS p, o_orderpriority AS c FROM orders WHERE o_orderkey % 11 <> 0), r AS (SELECT k, unnest(range(0, k % 2 + 1)) AS d FROM o)"


@query("g8_statement_edges", f"""WITH {BUILT} SELECT 'report:' || k || ':' || d AS src, 'p' || (k % 5 + d) AS dst, 'by' AS kind FROM r UNION ALL SELECT 'report:' || k || ':0', 'report:' || k || ':1', 'content' FROM r WHERE d = 1
  UNION ALL SELECT 'report:' || k || ':' || (k % 2), 'claim:' || k, 'content' FROM o UNION ALL SELECT 'claim:' || k, s, 'subject' FROM o UNION ALL SELECT 'claim:' || k, ob, 'object' FROM o WHERE ob IS NOT NULL UNION ALL SELECT s, ob, 'rel:owns' FROM o WHERE ob IS NOT NULL AND p IS NOT NULL""")
def g8_edges(spark, sf):
    return _statement_graph(spark, sf)[1]


@query("g8_statement_nodes", f"""WITH {BUILT}, n AS (SELECT 'report:' || k || ':' || d AS id, 'report' AS kind, 'says' AS label FROM r UNION SELECT 'p' || (k % 5 + d), 'entity', 'p' || (k % 5 + d) FROM r UNION SELECT 'claim:' || k, 'claim', c FROM o UNION SELECT s, 'entity', s FROM o UNION SELECT ob, 'entity', ob FROM o WHERE ob IS NOT NULL UNION SELECT 's' || (k % 9), 'source', 's' || (k % 9) FROM o) SELECT * FROM n""")
def g8_nodes(spark, sf):
    return _statement_graph(spark, sf)[0]


@query("j15_close_ids")
def j15(spark, sf):
    """Nearest known ids by block matching, which SQL cannot express; a test holds it against brute force."""
    p = D.table(spark, sf, "part")
    known = p.filter("p_partkey % 2 = 0").select(F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"))
    new = p.filter("p_partkey % 20 = 1").select(F.concat(F.lower("p_brand"), F.lit("_"), F.col("p_partkey").cast("string")).alias("id"))
    return statements.close_ids(new, known)


# ---- cohorts ------------------------------------------------------------------------------------------
RESULTS = "r AS (SELECT l_orderkey AS company, CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS predicate, CASE l_suppkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'UNKNOWN' ELSE 'UNKNOWABLE' END AS value, CASE WHEN l_orderkey % 2 = 0 THEN 'case' ELSE 'control' END AS arm FROM lineitem)"


def _results(spark, sf):
    return D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("company"), of("l_linenumber", "a", "b", "c").alias("predicate"), of("l_suppkey", "TRUE", "FALSE", "UNKNOWN", "UNKNOWABLE").alias("value"), F.when(F.col("l_orderkey") % 2 == 0, "case").otherwise("control").alias("arm"))


@query("a9_predicate_vector", f"WITH {RESULTS} SELECT company, max(value = 'TRUE') FILTER (WHERE predicate = 'a') AS a, max(value = 'TRUE') FILTER (WHERE predicate = 'b') AS b, max(value = 'TRUE') FILTER (WHERE predicate = 'c') AS c FROM r GROUP BY 1")
def a9(spark, sf):
    return reports.predicate_vector(_results(spark, sf), ("a", "b", "c"))


@query("a33_arms_compared", f"WITH {RESULTS} SELECT predicate, arm, count(*) FILTER (WHERE value <> 'UNKNOWABLE') AS evaluable, count(*) FILTER (WHERE value = 'TRUE') AS n_true, count(*) FILTER (WHERE value = 'UNKNOWABLE')::DOUBLE / count(*) AS unknowable_rate FROM r GROUP BY 1, 2")
def a33(spark, sf):
    return reports.arms_compared(_results(spark, sf))


@query("p26_gaps", """WITH f AS (SELECT DISTINCT l_orderkey AS subject, 'f' || (l_suppkey % 6) AS fact FROM lineitem), x(expectation, trigger, chk, source, base_rate) AS (VALUES ('officer', 'f0', 'f1', 'register', 0.027), ('parent', 'f2', 'f3', 'lei', 0.03), ('archive', 'f4', 'f5', 'archive', NULL)),
  q AS (SELECT DISTINCT l_orderkey AS subject, 'lei' AS source FROM lineitem WHERE l_orderkey % 2 = 0)
  SELECT f.subject, x.expectation, q.subject IS NULL AS closable, CAST(x.base_rate AS DOUBLE) AS base_rate FROM f JOIN x ON x.trigger = f.fact LEFT JOIN f g ON g.subject = f.subject AND g.fact = x.chk LEFT JOIN q ON q.subject = f.subject AND q.source = x.source WHERE g.subject IS NULL AND f.subject IN (SELECT o_orderkey FROM orders)""")
def p26(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    facts = lines.select(F.col("l_orderkey").alias("subject"), F.concat(F.lit("f"), (F.col("l_suppkey") % 6).cast("string")).alias("fact"))
    rules = spark.createDataFrame([("officer", "f0", "f1", "register"), ("parent", "f2", "f3", "lei"), ("archive", "f4", "f5", "archive")], "expectation string, trigger string, check string, source string")
    asked = lines.filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("subject"), F.lit("lei").alias("source"))
    rates = spark.createDataFrame([("officer", 0.027), ("parent", 0.03)], "expectation string, base_rate double")
    return reports.gaps(D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject")), facts, rules, asked, rates)


@query("o2_agenda_order", "SELECT event_id % 5 AS cost, event_type AS key, user_id AS subject FROM events")
def o2(spark, sf):
    return reports.agenda_order(D.table(spark, sf, "events").select((F.col("event_id") % 5).alias("cost"), F.col("event_type").alias("key"), F.col("user_id").alias("subject")))


# ---- put together -------------------------------------------------------------------------------------


def _edges(pattern: str) -> str:
    """A pattern whose word boundaries know all letters, as SQL text."""
    return pattern.replace(r"\b(", r"(?:^|[^\pL\pN_])(").replace(r")\b", r")(?:$|[^\pL\pN_])").replace("'", "''")


NO_SQL, MAY_SQL, SAYS_SQL, FRAME_SQL = map(_edges, (NEGATION, HEDGE, REPORTING, FRAME))
PLAIN_NO_SQL = r"(?i)(^|[^\pL\pN_])no($|[^\pL\pN_.])"
_T12_SQL = rf"""
  WITH t AS (SELECT doc_id, source, {NORMAL} AS t FROM documents), w AS (SELECT *, regexp_extract(t, '[a-z]{{5,}}') AS word, trim(substr(t, length(t) // 3 + 1, 60)) AS inside FROM t),
  q AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN inside || ' zq' ELSE inside END AS q FROM w WHERE inside <> '' AND word <> ''),
  a AS (SELECT *, CASE WHEN contains(t, q) THEN instr(t, q) - 1 END AS pos FROM q), h AS (SELECT *, substr(t, 1, pos + 1) AS h, substr(t, pos + length(q), length(t)) AS r FROM a),
  l AS (SELECT *, substr(h, length(regexp_extract(h, '(?s)^(.*[.!?]\s+){BEGINS}', 1)) + 1) AS l, regexp_extract(r, '(?s)^(.*?[.!?]\s+){BEGINS}', 1) AS s FROM h),
  c AS (SELECT *, CASE WHEN pos IS NULL THEN ' ' ELSE substr(l, 1, length(l) - 1) || ' ' || CASE WHEN s <> '' THEN substr(s, 2) ELSE substr(r, 2) END END AS around FROM l),
  f AS (
    SELECT *, doc_id % 3 = 0 AS own, doc_id % 4 = 0 AS negated, regexp_matches(around, '{FRAME_SQL}') AS framed,
           regexp_matches(around, '{NO_SQL}') OR regexp_matches(around, '{PLAIN_NO_SQL}') AS around_no, regexp_matches(q, '{NO_SQL}') OR regexp_matches(q, '{PLAIN_NO_SQL}') AS quote_no,
           regexp_matches(around, '{MAY_SQL}') OR regexp_matches(around, '{HEDGE_START}') AS around_may, regexp_matches(q, '{MAY_SQL}') OR regexp_matches(q, '{HEDGE_START}') AS quote_may,
           regexp_matches(around, '{SAYS_SQL}') AS around_says, regexp_matches(q, '{SAYS_SQL}') AS quote_says,
           contains(' ' || regexp_replace(q, '[^0-9A-Za-z_]+', ' ', 'g') || ' ', ' ' || word || ' ') AS named FROM c),
  i AS (
    SELECT doc_id, list_filter([CASE WHEN pos IS NULL THEN 'quote_not_in_passage' END, CASE WHEN doc_id % 11 = 0 THEN 'outer_speaker_not_source' END, CASE WHEN own AND quote_says THEN 'attribution_dropped' END,
           CASE WHEN doc_id % 7 = 0 THEN 'subject_local_id_not_in_passage' END, CASE WHEN doc_id % 6 = 0 THEN 'predicate_not_in_vocabulary' END, CASE WHEN doc_id % 9 = 0 THEN 'asserted_time_not_source_date' END], lambda x: x IS NOT NULL) AS defects,
           list_filter([CASE WHEN framed OR around_no OR around_may OR (around_says AND own) THEN 'frame_outside_quote' END, CASE WHEN quote_may THEN 'hedge_review' END, CASE WHEN quote_no AND NOT negated THEN 'polarity_review' END,
           CASE WHEN NOT named THEN 'subject_outside_quote' END], lambda x: x IS NOT NULL) AS review FROM f)
  SELECT doc_id AS uid, array_to_string(defects, '|') AS defects, array_to_string(review, '|') AS review, false AS closed, len(defects) = 0 AND len(review) = 0 AS closed_local,
         CASE WHEN list_contains(defects, 'quote_not_in_passage') THEN 'quote' WHEN list_has_any(defects, ['outer_speaker_not_source', 'attribution_dropped']) THEN 'report_chain' WHEN list_contains(defects, 'subject_local_id_not_in_passage') THEN 'subject'
              WHEN list_contains(defects, 'predicate_not_in_vocabulary') THEN 'relation' WHEN list_contains(defects, 'asserted_time_not_source_date') THEN 'time' WHEN len(review) > 0 THEN 'support' END AS first_failure FROM i"""


@query("t12_checked", _T12_SQL)
def t12(spark, sf):
    """Statements made of documents' own words: a stretch of the text as the quote, its first long word as the subject."""
    k = F.col("doc_id")
    d = D.table(spark, sf, "documents").select(k, "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", normal_text(F.col("text")))
    inside = F.btrim(F.substr("t", F.floor(F.length("t") / 3).cast("int") + 1, F.lit(60)), F.lit(" "))
    d = d.withColumn("word", F.regexp_extract("t", "[a-z]{5,}", 0)).withColumn("inside", inside).filter("inside <> '' AND word <> ''")
    entity = lambda i, label: F.struct(i.alias("id"), label.alias("label"))
    ident = F.concat(F.lit("local:"), "source", F.lit("#"), F.when(k % 7 == 0, F.concat("word", F.lit("zq"))).otherwise(F.col("word")))
    speaker = F.struct(F.when(k % 11 == 0, F.lit("elsewhere")).otherwise(F.col("source")).alias("id"), F.lit("the source").alias("label"), F.when(k % 3 == 0, "asserts").otherwise("reports").alias("verb"))
    none = F.lit(None).cast("string")
    a = d.select(
        k.alias("uid"), k.cast("string").alias("passage_id"), F.when(k % 5 == 0, F.concat("inside", F.lit(" zq"))).otherwise(F.col("inside")).alias("quote"), F.array(speaker).alias("reports"), entity(ident, F.col("word")).alias("subject"),
        F.when(k % 6 == 0, "sells").otherwise("uses").alias("predicate"), F.lit(None).cast("struct<id string, label string>").alias("object"), F.lit("x").alias("value"), F.lit("It holds in that year.").alias("statement"), none.alias("start"),
        F.when(k % 9 == 0, "2019").otherwise("2020").alias("end"), F.lit("asserted").alias("basis"), F.when(k % 4 == 0, "negated").otherwise("affirmed").alias("polarity"), none.alias("hedge"), F.lit("actual").alias("modality"), F.array().cast("array<string>").alias("open_reasons"),
    )
    p = d.select(k.cast("string").alias("passage_id"), F.col("source").alias("source_id"), F.lit("2020").alias("source_date"), "text")
    flat = lambda c: F.array_join(c, "|").alias(c)
    return atoms.verdicts(a, p).select("uid", flat("defects"), flat("review"), "closed", "closed_local", "first_failure")


@query("t19_support", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'not_run' WHEN o_orderkey % 3 > 0 THEN 'review' END AS flag, CASE WHEN o_orderkey % 2 = 0 THEN 'the board says that it fell' ELSE 'it fell' END AS hypothesis FROM orders")
def t19(spark, sf):
    from claimwright.operators import assembly

    k = F.col("o_orderkey")
    speakers = F.when(k % 2 == 0, F.array(F.lit("the paper"), F.lit("the board"))).otherwise(F.array(F.lit("the paper")))
    return D.table(spark, sf, "orders").select(k, assembly.support_flag(of("o_orderkey", "entailment", "neutral", "contradiction"), F.when(k % 7 == 0, 600).otherwise(90)).alias("flag"), assembly.hypothesis(F.lit("it fell in 2019-05"), speakers).alias("hypothesis"))


@query("t20_eligible_atoms", "SELECT l_orderkey AS uid, bool_and(coalesce(CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber % 6 > 0 END, false)) AS eligible FROM lineitem GROUP BY 1")
def t20(spark, sf):
    from claimwright.operators import assembly

    return assembly.eligible_atoms(D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linenumber") % 6 > 0).alias("passed")))


@query("t25_expectations", """SELECT l_orderkey AS "case", count(*) FILTER (WHERE CASE l_linenumber % 3 WHEN 0 THEN l_orderkey % 2 = 0 WHEN 1 THEN l_orderkey % 5 = 0 ELSE l_orderkey % 3 > 0 END) AS failed FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def t25(spark, sf):
    from claimwright.operators import assembly

    k = F.col("o_orderkey")
    out = D.table(spark, sf, "orders").select(k.alias("case"), F.array(F.when(k % 2 == 0, "it holds SECRET words").otherwise("nothing")).alias("fields"), F.when(k % 5 > 0, "negated").otherwise("affirmed").alias("polarity"), F.array(F.when(k % 3 == 0, "Ann").otherwise("Bo")).alias("speakers"))
    asked = D.table(spark, sf, "lineitem").join(D.table(spark, sf, "orders"), F.col("l_orderkey") == k, "left_semi").select(F.col("l_orderkey").alias("case"), of("l_linenumber", "forbidden", "polarity", "speaker").alias("kind"), of("l_linenumber", "secret", "negated", "Ann").alias("value"))
    return assembly.expectations_met(out, asked)


@query("j21_imported", """WITH t AS (SELECT o_orderkey AS id, o_custkey % 50 AS r, o_orderkey % 4 AS c, o_orderkey % 3 AS s, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 4, o_orderkey % 3 ORDER BY o_orderkey) AS rn FROM orders)
  SELECT id, CASE WHEN id % 10 = 0 THEN 'held' WHEN r < 10 AND c = 1 THEN 'conflict' WHEN rn > 1 THEN 'repeated' ELSE 'import' END AS outcome FROM t""")
def j21(spark, sf):
    from claimwright.operators import assembly

    k = F.col("o_orderkey")
    theirs = D.table(spark, sf, "orders").select(k.alias("id"), F.lit("cell").alias("kind"), (F.col("o_custkey") % 50).alias("row"), (k % 4).alias("cell"), (k % 3).alias("source"))
    cells = spark.range(10).select((-F.col("id") - 1).alias("id"), F.lit("cell").alias("kind"), F.col("id").alias("row"), F.lit(1).cast("long").alias("cell"))
    held = theirs.filter("id % 10 = 0").select("id", F.lit("other").alias("kind"), "row", "cell")
    return assembly.imported(theirs, cells.unionByName(held))


@query("a32_seeded_sample", "WITH r AS (SELECT o_orderstatus AS stratum, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('22|' || o_orderkey), o_orderkey) AS INTEGER) AS place FROM orders) SELECT * FROM r WHERE place <= 12")
def a32(spark, sf):
    from claimwright.operators import assembly

    rows = D.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("stratum"), F.col("o_orderkey").alias("k"))
    return assembly.seeded_sample(rows, "stratum", "k", 12, "22")


@query("i27_designated_domains", "SELECT 'site' || (c_custkey % 200) || '.example' AS domain, 'e' || min(c_custkey) AS id FROM customer WHERE c_custkey % 3 > 0 GROUP BY c_custkey % 200")
def i27(spark, sf):
    from claimwright.operators import assembly

    k = F.col("c_custkey")
    site = F.array(F.concat(F.lit("https://www.site"), (k % 200).cast("string"), F.lit(".example/x")), F.lit("none"))
    text = F.to_json(F.struct(F.concat(F.lit("e"), k.cast("string")).alias("id"), of("c_custkey", "Vessel", "Company", "Organization").alias("schema"), F.struct(site.alias("website")).alias("properties")))
    return assembly.designated_domains(D.table(spark, sf, "customer").select(k.alias("line"), text.alias("text")), ("Company", "Organization", "LegalEntity"))


@query("i33_index_rows", "SELECT c_custkey AS resource_id, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE '' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'NORMAL' ELSE '' END AS status, CASE c_custkey % 3 WHEN 0 THEN '{\"name' WHEN 1 THEN 'no jso' END AS preview FROM customer")
def i33(spark, sf):
    from claimwright.operators import assembly

    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("NORMAL").alias("status")))).otherwise("no json")
    c = D.table(spark, sf, "customer")
    return assembly.index_rows(c.select(k.alias("resource_id"), k.cast("string").alias("content_hash")), c.filter(k % 3 < 2).select(k.cast("string").alias("content_hash"), body.alias("body")), 6)


@query("s9_address_label", "SELECT s_suppkey, 'Vej ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' 3 tv' ELSE '' END || ' 2200 N' AS label FROM supplier")
def s9(spark, sf):
    from claimwright.operators import assembly

    s = F.col("s_suppkey")
    return D.table(spark, sf, "supplier").select(s, assembly.address_label(F.lit("Vej"), s.cast("string"), F.when(s % 2 == 0, " 3 tv"), F.lit(""), F.lit("2200 N")).alias("label"))


@query("e24_coverage", "SELECT p_partkey AS doc, ((CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)) || ' of 3 institutions assessed' AS statement FROM part")
def e24(spark, sf):
    from claimwright.operators import assembly

    k = F.col("p_partkey")
    text = F.concat(F.when(k % 2 == 0, "At ALPHA, alpha. ").otherwise(""), F.when(k % 3 == 0, "Beta!").otherwise("none"))
    assessed = spark.createDataFrame([("Alpha",), ("beta",), ("Gamma",)], "name string")
    return assembly.coverage_statement(assessed, D.table(spark, sf, "part").select(k.alias("doc"), text.alias("text")))


@query("p27_screen_lines", f"WITH {RESULTS} SELECT company, CASE WHEN value = 'UNKNOWABLE' THEN 'limit' WHEN value = 'TRUE' AND predicate = 'a' THEN 'finding' ELSE 'fact' END AS section, predicate, value = 'UNKNOWABLE' AND predicate = 'b' AS blocks FROM r WHERE value <> 'FALSE'")
def p27(spark, sf):
    from claimwright.operators import assembly

    return assembly.screen_lines(_results(spark, sf), ("b",), ("a",))


@query("p29_factsheet", f"WITH {RESULTS} SELECT company, CAST(o_orderdate AS DATE) - 365 AS as_of, CASE value WHEN 'TRUE' THEN 'fired' WHEN 'FALSE' THEN 'not_fired' WHEN 'UNKNOWN' THEN 'open' ELSE 'not_evaluable' END AS section, predicate, CASE WHEN value = 'TRUE' AND predicate = 'a' THEN 0.25::DOUBLE END AS comparator FROM r JOIN orders ON o_orderkey = company")
def p29(spark, sf):
    from claimwright.operators import assembly

    subjects = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("company"), F.col("o_orderdate").cast("date").alias("event_date"))
    return assembly.factsheet(subjects, _results(spark, sf), spark.createDataFrame([("a", 0.25)], "predicate string, rate double"))


@query("s15_document_paths", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS r FROM orders WHERE o_orderkey % 3 = 0)
  SELECT p AS path, CASE WHEN contains(p, 'deltagerRelation') THEN r ELSE n END AS documents FROM n, (VALUES ('Vrvirksomhed'), ('Vrvirksomhed.cvrNummer'), ('Vrvirksomhed.navne'), ('Vrvirksomhed.virksomhedsstatus'), ('Vrvirksomhed.attributter'), ('Vrvirksomhed.deltagerRelation'),
    ('Vrvirksomhed.navne.navn'), ('Vrvirksomhed.virksomhedsstatus.status'), ('Vrvirksomhed.attributter.type'), ('Vrvirksomhed.attributter.vaerdier'), ('Vrvirksomhed.deltagerRelation.deltager'), ('Vrvirksomhed.deltagerRelation.organisationer')) v(p)""")
def s15(spark, sf):
    from claimwright.sources import bodies

    docs = _documents(spark, sf).filter(F.col("json").startswith('{"Vr'))
    return bodies.document_paths(docs, ("periode", "hjemmeside", "virksomhedMetadata"))


BODIES = ("%PDF-1.7", "<!DOCTYPE html><p>x", " {\"a\": 1}", "<?xml version='1.0'?>", "plain words", "PK\x03\x04")


@query("t6_body_kinds", f"SELECT p_partkey, {of_sql('p_partkey', 'pdf', 'html', 'json', 'xml', 'text', 'zip')} AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'é' ELSE 'Ã' END AS letter FROM part")
def t6(spark, sf):
    from claimwright.sources import bodies

    # 0xE9 alone is no UTF-8, 0xC3 0x83 is
    odd = F.when(F.col("p_partkey") % 2 == 0, F.unhex(F.lit("E9"))).otherwise(F.unhex(F.lit("C383")))
    return D.table(spark, sf, "part").select("p_partkey", bodies.kind_of(bodies.unpacked(of("p_partkey", *BODIES).cast("binary"))).alias("kind"), bodies.decoded(odd).alias("letter"))
