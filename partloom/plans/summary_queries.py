"""Queries of summaries, prefix joins of models, and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from partloom.operators import summaries as sm
from partloom.operators.evalstats import masked_mean as mean_of
from partloom.plans.adapters import ctes, table, view
from partloom.tables import home

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


RUNS = "r AS (SELECT o_custkey AS file, sum(o_totalprice) AS seconds, count(*) AS n_parts, count(*) FILTER (o_orderstatus = 'F') AS n_fasteners, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS match_rate FROM orders GROUP BY 1)"


def _runs(spark, sf_dir):
    fast = (F.col("o_orderstatus") == "F").cast("long")
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.sum("o_totalprice").alias("seconds"), F.count("*").alias("n_parts"), F.sum(fast).alias("n_fasteners"))
    return r.withColumn("match_rate", F.col("n_fasteners") / F.col("n_parts"))


@query(f"WITH {RUNS} SELECT count(*) AS files, CAST(sum(n_parts) AS BIGINT) AS parts, CAST(sum(n_fasteners) AS BIGINT) AS fasteners, round(median(seconds), 4) AS median_s, round(max(seconds), 4) AS max_s, round(avg(match_rate), 9) AS mean_match_rate FROM r")
def run_summary(spark, sf_dir):
    out = sm.run_summary(_runs(spark, sf_dir))
    return out.withColumns({"median_s": F.round("median_s", 4), "max_s": F.round("max_s", 4), "mean_match_rate": F.round("mean_match_rate", 9)})


@query(f"""WITH {RUNS}, a AS (SELECT 'lowest_match_rate' AS kind, file, match_rate AS value, row_number() OVER (ORDER BY match_rate, file) AS rank FROM r), b AS (SELECT 'slowest' AS kind, file, seconds AS value, row_number() OVER (ORDER BY seconds DESC, file) AS rank FROM r)
SELECT kind, file, round(value, 4) AS value, CAST(rank AS INT) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 3""")
def run_extremes(spark, sf_dir):
    return sm.extremes(_runs(spark, sf_dir)).select("kind", "file", F.round("value", 4).alias("value"), "rank")


@query("""WITH p AS (SELECT p_size % 3 = 0 AS f, p_size * 100 AS o, 64 AS x FROM part) SELECT count(*) AS n_parts, count(*) FILTER (f) AS n_substituted, CAST(sum(o) FILTER (f) AS BIGINT) AS original, CAST(sum(x) FILTER (f) AS BIGINT) AS proxy, 1e0 - CAST(sum(x) FILTER (f) AS DOUBLE) / sum(o) FILTER (f) AS reduction FROM p""")
def lod_totals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_size", (F.col("p_size") * 100).alias("original_faces"), F.lit(64).alias("proxy_faces"))
    return sm.lod_totals(p, F.col("p_size") % 3 == 0)


@query("""WITH l(level, screen_size, polygon_target) AS (VALUES (0, CAST(1 AS DOUBLE), 1000), (1, 25e-2, 64), (2, 5e-2, 12)), p AS (SELECT p_partkey, p_size / 4e1 AS screen FROM part)
SELECT p.p_partkey, l.* FROM p JOIN l ON l.level = CASE WHEN screen >= 1 THEN 0 WHEN screen >= 25e-2 THEN 1 ELSE 2 END""")
def lod_levels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 40.0).alias("screen"))
    return p.select("p_partkey", *[c.alias(k) for k, c in sm.lod_of(F.col("screen")).items()])


@query("SELECT count(*) AS n, count(*) FILTER (p_name <> '') AS named, count(*) FILTER (contains(p_name, 'bolt') OR contains(p_name, 'ring')) AS informative, count(*) FILTER (contains(p_name, 'bolt')) AS labelled, count(DISTINCT p_name) AS distinct_names FROM part")
def name_coverage(spark, sf_dir):
    n = F.col("p_name")
    return sm.name_coverage(table(spark, sf_dir, "part"), "p_name", F.contains(n, F.lit("bolt")) | F.contains(n, F.lit("ring")), F.contains(n, F.lit("bolt")))


@query(f"{ctes('fx_pred')} SELECT p5 AS cls, count(*) AS n, round(avg(CAST(y5 = p5 AS INT)), 4) AS precision, round(avg(pa), 4) AS mean_confidence FROM fx_pred GROUP BY p5")
def classifier_report(spark, sf_dir):
    return sm.classifier_report(view(spark, sf_dir, "fx_pred"), "y5", "p5", "pa")


@query("SELECT l_orderkey AS sample_id, round(sum(l_quantity * CAST(l_linenumber % 2 AS DOUBLE)) / greatest(sum(CAST(l_linenumber % 2 AS DOUBLE)), 1e0), 9) AS mean FROM lineitem GROUP BY 1")
def masked_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_quantity").alias("v"), (F.col("l_linenumber") % 2).cast("double").alias("m"))
    return mean_of(li, "sample_id", "v", "m").withColumn("mean", F.round("mean", 9))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("SELECT event_id, event_type, 1 AS score FROM events")
def event_resume_stream(spark, sf_dir):
    """The event table through the resumable sink, twice: the second run adds nothing."""
    from partloom.streaming.events import run_resumable

    root = f"{home(spark)}/stream-{uuid.uuid4().hex[:12]}"
    schema = table(spark, sf_dir, "events").schema
    for again in range(2):
        rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
        run_resumable(rows, lambda b: b.select("event_id", "event_type", F.lit(1).alias("score")), f"{root}/out", f"{root}/checkpoint-{again}", "event_id").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type", "score")
