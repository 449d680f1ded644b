"""Queries over pairs: matched cases and controls, names and identifiers that look alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimwright.operators import likeness, matching
from claimwright.plans.queries import query
from claimwright.sources import datasets as D

# ---- cases and controls at the case's date -----------------------------------------------------------
#: Of a customer: the segment, first and last order, and the first order above so much.
EVENT_PRICE = 420_000
LEAD_DAYS, FIRST_DAY, LAST_DAY = 90, "1993-01-01", "1998-06-30"
BANDS = [0, 1, 2, 4]

_SUBJECTS = f"""
  s AS (
    SELECT o_custkey AS subject, CAST(min(o_orderdate) AS DATE) AS born, CAST(max(o_orderdate) AS DATE) AS gone,
           CAST(min(o_orderdate) FILTER (WHERE o_totalprice > {EVENT_PRICE}) AS DATE) AS event, max(o_totalprice) > 300000 AND o_custkey % 3 = 0 AS chosen
    FROM orders GROUP BY 1),
  t AS (SELECT s.*, c_mktsegment AS form, event IS NOT NULL OR chosen AS is_case FROM s JOIN customer ON c_custkey = subject),
  b(age, lo, hi) AS (VALUES (0, 0, 365), (1, 365, 730), (2, 730, 1095), (3, 1095, 1825), (4, 1825, 99999)),
  p AS (SELECT subject, form, age, born + CAST(lo AS INTEGER) AS start, least(born + CAST(hi AS INTEGER), gone) AS until FROM t, b WHERE born + CAST(lo AS INTEGER) < least(born + CAST(hi AS INTEGER), gone)),
  w AS (SELECT subject, event, event - {LEAD_DAYS} AS as_of FROM t WHERE is_case),
  x AS (
    SELECT w.subject, w.as_of, p.form, p.age,
           CASE WHEN event IS NULL THEN 'no dated adverse transition' WHEN NOT as_of BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' THEN 'as-of outside window' WHEN p.subject IS NULL THEN 'case not alive and NORMAL at as-of' END AS why
    FROM w LEFT JOIN p ON p.subject = w.subject AND as_of >= start AND as_of < until),
  n AS (SELECT *, row_number() OVER (ORDER BY subject) AS i FROM x WHERE why IS NULL),
  f AS (SELECT n.i, list(p.subject ORDER BY p.subject) AS free FROM n JOIN p ON p.form = n.form AND p.age = n.age AND n.as_of >= p.start AND n.as_of < p.until JOIN t ON t.subject = p.subject AND NOT is_case GROUP BY n.i),
  m(i, control, used) AS (
    SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[])
    UNION ALL
    SELECT i, control, CASE WHEN control IS NULL THEN used ELSE list_append(used, control) END
    FROM (SELECT n.i, used, list_min([c FOR c IN coalesce(free, []) IF NOT list_contains(used, c)]) AS control FROM m JOIN n ON n.i = m.i + 1 LEFT JOIN f ON f.i = n.i))
"""
_PAIRS = "SELECT x.subject, x.as_of, coalesce(x.why, CASE WHEN control IS NULL THEN 'no matching control' ELSE 'matched' END) AS outcome, control FROM x LEFT JOIN n ON n.subject = x.subject LEFT JOIN m ON m.i = n.i"


def case_pairs(spark, sf):
    event = F.min(F.when(F.col("o_totalprice") > EVENT_PRICE, F.col("o_orderdate"))).cast("date")
    of = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.min("o_orderdate").cast("date").alias("born"), F.max("o_orderdate").cast("date").alias("gone"), event.alias("event"), F.max("o_totalprice").alias("top"))
    form = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("form"))
    # some customers are watched that never had an event
    all_ = of.join(form, "subject").withColumn("is_case", F.col("event").isNotNull() | ((F.col("top") > 300_000) & (F.col("subject") % 3 == 0)))
    periods = matching.age_periods(all_.select("subject", "form", "born", "gone"), BANDS, "form")
    return matching.case_control_pairs(all_.filter("is_case").select("subject", "event"), all_.filter("not is_case").select("subject"), periods, ["form", "age"], lead_days=LEAD_DAYS, window=(FIRST_DAY, LAST_DAY), fixed=("form",))


@query("j16_case_date_pairs", f"WITH RECURSIVE {_SUBJECTS} {_PAIRS}")
def j16_case_date_pairs(spark, sf):
    return case_pairs(spark, sf)


@query("j16_drop_reasons", f"WITH RECURSIVE {_SUBJECTS} SELECT outcome, count(*) AS n FROM ({_PAIRS}) GROUP BY 1")
def j16_drop_reasons(spark, sf):
    return matching.drop_reasons(case_pairs(spark, sf))


# ---- names and identifiers that look alike -------------------------------------------------------------
@query("j13_name_candidates")
def j13_name_candidates(spark, sf):
    """Names of sites under different suffixes by block matching, which SQL cannot express; a test holds it against all pairs."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    sites = D.table(spark, sf, "pages").select(host.alias("host")).filter("host <> ''").distinct()
    name = F.regexp_replace(F.regexp_replace("host", r"\.[^.]+\.[^.]+$", ""), "^m\\.", "")
    return likeness.name_candidates(sites.select(F.col("host").alias("entity"), name.alias("label"), F.substring_index("host", ".", -1).alias("source"), F.col("host").alias("linked")))
