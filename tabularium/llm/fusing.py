"""Problem 2: one order from scores on different scales.

Scores of a retriever within a request are standardised by median and median absolute deviation, squashed by the
logistic function into (floor, 1), and combined by a weighted geometric mean over the retrievers of the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabularium.plans.latest import latest_rows
from tabularium.sources.tables import table

#: Makes the median absolute deviation of a normal distribution its standard deviation (fixed value).
MAD_TO_SIGMA = 1.4826


def _middle(x: Column) -> Column:
    """Lower median by a mergeable sketch of bounded size: exact up to 10,000 values, rank error n / 10,000 beyond."""
    return F.percentile_approx(x, F.lit(0.5), F.lit(10_000))


def fuse_scores(scores: DataFrame, group: str, item: str, source: str, score: str, higher: Column, weight: Column | None = None, floor: float = 0.01) -> DataFrame:
    """``(group, item, fused, n_scored)``, ``fused`` in [floor, 1].

    ``scores`` has one row per (group, source, item). Null and NaN scores count as absent; an item without a score of
    a source gets the floor from it, as the geometric mean runs over every source that scored in the group. Where the
    deviation is zero (over half of the scores tie), the mean absolute deviation stands in; if that is zero too, every
    score of the source is 0.5. Infinite scores squash to the ends. Each group is aggregated with partial sketches and
    sums, so a hot group costs no single task more than the sketch.
    """
    weight = F.lit(1.0) if weight is None else weight
    signed = F.when(higher, F.col(score)).otherwise(-F.col(score)).cast("double")
    good = scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(
        F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(source).alias("_s"), F.least(F.greatest(signed, F.lit(-1e300)), F.lit(1e300)).alias("_x"), weight.cast("double").alias("_w")
    )
    centre = good.groupBy("_g", "_s").agg(_middle(F.col("_x")).alias("_med"), F.max("_w").alias("_ws"))
    off = good.join(centre, ["_g", "_s"]).withColumn("_d", F.abs(F.col("_x") - F.col("_med")))
    spread = off.groupBy("_g", "_s").agg(_middle(F.col("_d")).alias("_mad"), F.avg(F.least(F.col("_d"), F.lit(1e290))).alias("_aad"), F.first("_med").alias("_med"), F.first("_ws").alias("_ws"))
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SIGMA).when(F.col("_aad") > 0, F.col("_aad") * 1.2533)
    z = F.when(scale.isNull(), F.lit(0.0)).otherwise((F.col("_x") - F.col("_med")) / scale)
    bounded = F.lit(floor) + (1 - floor) / (1 + F.exp(-F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0))))
    gained = good.join(spread.select("_g", "_s", "_med", "_mad", "_aad"), ["_g", "_s"]).groupBy("_g", "_i").agg(
        F.sum(F.col("_w") * (F.log(bounded) - F.log(F.lit(floor)))).alias("_gain"), F.count(F.lit(1)).alias("n_scored")
    )
    total = spread.groupBy("_g").agg(F.sum("_ws").alias("_total"))
    return gained.join(total, "_g").select(
        F.col("_g").alias(group), F.col("_i").alias(item), F.exp(F.col("_gain") / F.col("_total") + F.log(F.lit(floor))).alias("fused"), "n_scored"
    )


def _fused(spark: SparkSession, root: str) -> DataFrame:
    """Latest answers of each request, retriever and chunk; a retriever without a known direction counts as rising."""
    answers = latest_rows(table(spark, root, "legal_source").select("row_no", "request_no", "retriever", "chunk_id", "score", "retrieved_at"), ["request_no", "retriever", "chunk_id"], [F.col("retrieved_at")], "row_no")
    known = table(spark, root, "retriever").groupBy("retriever").agg(F.max("higher_is_better").alias("rises"))
    return fuse_scores(answers.join(known, "retriever", "left"), "request_no", "chunk_id", "retriever", "score", F.coalesce(F.col("rises"), F.lit(True)))


def p2_ranking(spark: SparkSession, root: str) -> DataFrame:
    """All sources of all requests with their fused score; equal scores tie on chunk_id."""
    return _fused(spark, root).withColumn("fused", F.round("fused", 6)).orderBy("request_no", F.desc("fused"), "chunk_id")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    lead = _fused(spark, root).groupBy("request_no").agg(F.min(F.struct((-F.round("fused", 9)).alias("key"), "chunk_id")).alias("top"))
    return lead.select("request_no", F.col("top.chunk_id").alias("chunk_id"))


_LEAD_SQL = """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_no, retriever, chunk_id ORDER BY retrieved_at DESC NULLS LAST, row_no DESC) rn FROM legal_source) WHERE rn = 1 AND score IS NOT NULL AND NOT isnan(score)),
x AS (SELECT request_no, chunk_id, l.retriever, CASE WHEN coalesce(higher_is_better, true) THEN score ELSE -score END x FROM l LEFT JOIN retriever USING (retriever)),
m AS (SELECT request_no, retriever, quantile_disc(x, 0.5) med FROM x GROUP BY ALL),
d AS (SELECT request_no, retriever, any_value(med) med, quantile_disc(abs(x - med), 0.5) mad, avg(abs(x - med)) aad FROM x JOIN m USING (request_no, retriever) GROUP BY ALL),
z AS (SELECT request_no, chunk_id, ln(0.01 + 0.99 / (1 + exp(-least(greatest(CASE WHEN mad > 0 THEN (x - med) / (mad * 1.4826) WHEN aad > 0 THEN (x - med) / (aad * 1.2533) ELSE 0 END, -700), 700)))) - ln(0.01) g FROM x JOIN d USING (request_no, retriever)),
w AS (SELECT request_no, count(*) w FROM d GROUP BY ALL),
f AS (SELECT request_no, chunk_id, count(*) n_scored, exp(sum(g) / any_value(w) + ln(0.01)) whole, round(exp(sum(g) / any_value(w) + ln(0.01)), 9) fused FROM z JOIN w USING (request_no) GROUP BY ALL)
"""
QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking}
ORACLES = {
    "p2_found": _LEAD_SQL + "SELECT request_no, arg_min(chunk_id, (-fused, chunk_id)) AS chunk_id FROM f GROUP BY request_no",
    "p2_ranking": _LEAD_SQL + "SELECT request_no, chunk_id, round(whole, 6) AS fused, n_scored FROM f",
}
