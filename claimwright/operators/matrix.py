"""A matrix of evidence and explanations, read per question.

Only explanations of one question compete, and an explanation is no rival of
those it refines or that refine it.  Evidence weakens an explanation where it is
inconsistent; it confirms one only where a prediction was tested that no rival
predicted too, and only if the evidence is younger than the prediction: what
was there already is a fit.  An explanation that nothing could contradict is
told as such.

Rivals are counted, never paired: what fits a row, less what fits it among an explanation's own kin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimwright.operators.graph import _cut, lineage

NO_PREDICTION = "it names no prediction"
NOT_OBSERVABLE = "none of its predictions is observable"
NOT_TESTED = "none of its observable predictions has been tested yet"


def discriminating_rows(cells: DataFrame) -> DataFrame:
    """question, row: where some explanations are inconsistent with the evidence and others, of those it bears on, are not."""
    bears = cells.filter("reading <> 'not_applicable'")
    bad = F.col("reading") == "inconsistent"
    return bears.groupBy("question", "row").agg(F.bool_or(bad).alias("some"), F.bool_and(bad).alias("all")).filter("some AND NOT all").select("question", "row")


def matrix(explanations: DataFrame, predictions: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each explanation of each question: counts of its readings, what it confirmed, why nothing can contradict it (else null), and its place.

    ``explanations`` (question, explanation, parent); ``predictions``
    (explanation, prediction, observable, made: a year); ``rows`` (row, year,
    contested); ``cells`` (row, explanation, reading, tests: a prediction), one for each (row, explanation).
    """
    up = _cut(lineage(explanations.select(F.col("explanation").alias("id"), "parent")).select(F.col("id").alias("explanation"), F.explode("chain").alias("above")))
    kin = up.union(up.select("above", "explanation")).distinct()
    own = predictions.select(F.col("explanation").alias("above"), "prediction", "observable", "made").join(up, "above").select("explanation", "prediction", "observable", "made").distinct()
    read = _cut(cells.join(explanations.select("question", "explanation"), "explanation").join(rows, "row"))
    fits = read.filter("reading = 'consistent'").select("question", "row", "explanation")
    all_fits = fits.groupBy("question", "row").agg(F.count(F.lit(1)).alias("n_fits"))
    kin_fits = fits.select("question", "row", F.col("explanation").alias("above")).join(kin.select("explanation", "above"), "above").groupBy("question", "row", "explanation").agg(F.count(F.lit(1)).alias("n_kin"))
    made = own.select("explanation", F.col("prediction").alias("tests"), "observable", "made")
    marked = discriminating_rows(read).withColumn("tells", F.lit(True))
    full = read.join(all_fits, ["question", "row"], "left").join(kin_fits, ["question", "row", "explanation"], "left").join(made, ["explanation", "tests"], "left").join(marked, ["question", "row"], "left")
    is_ = lambda reading: F.col("reading") == reading
    tested, contested = F.col("tests").isNotNull(), F.coalesce("contested", F.lit(False))
    alone = is_("consistent") & tested & (F.col("n_fits") == F.col("n_kin"))
    known_before = F.coalesce(F.col("year") <= F.col("made"), F.lit(False))
    count = {
        "inconsistent": is_("inconsistent") & ~contested,
        "inconsistent_disputed": is_("inconsistent") & contested,
        "contradicted": is_("inconsistent") & tested & ~contested,
        "contradicted_disputed": is_("inconsistent") & tested & contested,
        "confirmed": alone & ~known_before & ~contested,
        "confirmed_disputed": alone & ~known_before & contested,
        "accommodated": alone & known_before,
        "consistent": is_("consistent"),
        "consistent_discriminating": is_("consistent") & F.coalesce("tells", F.lit(False)),
        "narrowed": is_("narrows"),
        "neutral": is_("neutral"),
        "not_applicable": is_("not_applicable"),
        "assessed": F.lit(True),
        "tested": F.coalesce("observable", F.lit(False)),
    }
    counted = full.groupBy("question", "explanation").agg(*(F.count_if(c).alias(k) for k, c in count.items()))
    said = own.groupBy("explanation").agg(F.count(F.lit(1)).alias("n"), F.count_if("observable").alias("seen"))
    size = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    every = explanations.select("question", "explanation").join(counted, ["question", "explanation"], "left").join(said, "explanation", "left").crossJoin(F.broadcast(size))  # one row
    zero = F.lit(0).cast("long")
    every = every.select("question", "explanation", "n_rows", F.coalesce("n", zero).alias("n"), F.coalesce("seen", zero).alias("seen"), *(F.coalesce(k, zero).alias(k) for k in count))
    immune = F.when(F.col("n") == 0, NO_PREDICTION).when(F.col("seen") == 0, NOT_OBSERVABLE).when(F.col("tested") == 0, NOT_TESTED)
    order = Window.partitionBy("question").orderBy("inconsistent", "inconsistent_disputed", F.col("confirmed").desc(), (F.col("confirmed") + F.col("confirmed_disputed")).desc(), "explanation")
    shown = [k for k in count if k not in ("assessed", "tested")]
    return every.select("question", "explanation", *shown, (F.col("n_rows") - F.col("assessed")).alias("unassessed"), immune.alias("immune"), F.row_number().over(order).alias("place"))
