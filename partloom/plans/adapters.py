"""Part-assembly views over the driver's tables, from one text for both engines.

Constants are in exponent notation, so both engines read DOUBLE; DIV stands for
integer division, which is the only difference of dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_parts": """
SELECT p_partkey AS part_id, p_name AS name, p_partkey AS ord, CAST(p_partkey % 6 AS INT) AS kind,
       CASE p_size % 10 WHEN 0 THEN 3e0 WHEN 1 THEN 4e0 WHEN 2 THEN 5e0 WHEN 3 THEN 6e0 WHEN 4 THEN 8e0
            WHEN 5 THEN 10e0 WHEN 6 THEN 12e0 WHEN 7 THEN 16e0 WHEN 8 THEN 20e0 ELSE 24e0 END AS m,
       CAST(p_partkey % 7 AS DOUBLE) * 5e-2 AS jit, CAST(p_size % 5 AS DOUBLE) AS s5
FROM {part}""",
    "fx_features": """
SELECT part_id, kind,
       CASE WHEN kind <= 2 THEN m + jit WHEN kind = 3 THEN m WHEN kind = 4 THEN 2e0 * m ELSE 3e2 END AS bcyl_d,
       CASE WHEN kind <= 2 THEN m * (2e0 + s5) WHEN kind = 3 THEN 8e-1 * m WHEN kind = 4 THEN 2e-1 * m ELSE 5e2 END AS bcyl_l,
       CASE WHEN kind <= 2 THEN 16e-1 * m + jit END AS head_d,
       CASE WHEN kind <= 2 THEN 65e-2 * m WHEN kind = 3 THEN 8e-1 * m END AS head_h,
       CASE WHEN kind <= 4 THEN 6e-1 + 1e-1 * s5 ELSE 5e-2 END AS cyl_ratio,
       kind <= 3 AS has_thread, CAST(NULL AS DOUBLE) AS median_d
FROM fx_parts""",
    "fx_dims": """
SELECT f.*, f.bcyl_l / f.bcyl_d AS aspect,
       CASE WHEN f.kind IN (3, 4) THEN f.bcyl_l ELSE f.bcyl_d END AS dx, f.bcyl_d AS dy,
       CASE WHEN f.kind IN (3, 4) THEN f.bcyl_d ELSE f.bcyl_l END AS dz
FROM fx_features f""",
    "fx_shafts": """
SELECT part_id, 25e0 * CAST(part_id % 10 AS DOUBLE) + 15e-2 * s5 AS ox, 25e0 * CAST((part_id DIV 10) % 10 AS DOUBLE) AS oy, -5e0 AS oz,
       CASE part_id % 8 WHEN 5 THEN 28e-2 WHEN 7 THEN 6e-1 ELSE 0e0 END AS dx, CASE part_id % 8 WHEN 6 THEN -28e-2 ELSE 0e0 END AS dy,
       CASE part_id % 8 WHEN 5 THEN 96e-2 WHEN 6 THEN -96e-2 WHEN 7 THEN 8e-1 ELSE 1e0 END AS dz, m / 2e0 AS radius, m * (2e0 + s5) AS length, 9e-1 AS confidence
FROM fx_parts WHERE kind <= 2""",
    "fx_holes": """
SELECT l_orderkey * 10 + l_linenumber AS hole_id, l_partkey AS host_id,
       25e0 * CAST(l_suppkey % 10 AS DOUBLE) + CASE l_linenumber WHEN 7 THEN 3e0 ELSE 0e0 END AS ox, 25e0 * CAST(l_partkey % 10 AS DOUBLE) AS oy,
       CASE l_linenumber WHEN 7 THEN -1e0 ELSE CAST(l_linenumber AS DOUBLE) END AS oz, CASE l_linenumber WHEN 7 THEN 6e-1 ELSE 0e0 END AS dx, 0e0 AS dy,
       CASE l_linenumber WHEN 6 THEN -1e0 WHEN 7 THEN 8e-1 ELSE 1e0 END AS dz, l_quantity / 4e0 AS diameter, 2e0 + l_tax * 1e2 AS length
FROM {lineitem}""",
    "fx_cylinders": """
SELECT l_partkey AS part_id, l_orderkey * 10 + l_linenumber AS face_index,
       CASE l_suppkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 2e1 ELSE 4e1 + 6e-1 * CAST(l_linenumber AS DOUBLE) END + 4e-2 * CAST(l_orderkey DIV 7 % 3 AS DOUBLE) AS ox,
       CASE l_suppkey % 3 WHEN 2 THEN 5e0 ELSE 0e0 END AS oy, CASE l_suppkey % 3 WHEN 2 THEN 8e-1 ELSE 1e0 END * CAST(l_linenumber AS DOUBLE) AS oz,
       CASE l_suppkey % 3 WHEN 2 THEN 6e-1 ELSE 0e0 END AS dx, 0e0 AS dy, CASE l_suppkey % 3 WHEN 2 THEN 8e-1 WHEN 1 THEN CASE l_linenumber % 2 WHEN 0 THEN 1e0 ELSE -1e0 END ELSE 1e0 END AS dz,
       l_quantity / 4e0 AS radius, 1e0 + l_tax * 1e2 AS length, l_orderkey % 3 = 0 AS is_internal,
       CASE l_linenumber % 5 WHEN 0 THEN 'plane' WHEN 1 THEN 'cylinder' WHEN 2 THEN 'cone' WHEN 3 THEN 'torus' ELSE 'sphere' END AS stype
FROM {lineitem}""",
    "fx_radii": """
SELECT part_id, face_index, face_index % 10 = 3 AS inner_,
       CASE WHEN face_index % 10 = 3 THEN CASE part_id % 5 WHEN 3 THEN 25e-1 ELSE 1e0 + radius / 16e0 END
            ELSE CASE part_id % 5 WHEN 0 THEN 3e0 WHEN 1 THEN CASE face_index % 10 WHEN 1 THEN 3e0 ELSE 5e0 END WHEN 2 THEN 4e0 + CAST(face_index % 10 AS DOUBLE) / 1e1 ELSE 2e0 + radius / 8e0 END END AS r
FROM fx_cylinders WHERE face_index % 10 IN (1, 2) OR face_index % 10 = 3 AND part_id % 3 <> 0""",
    "fx_pred": """
SELECT l.doc_id, l.quality AS y, d.source, d.lang,
       CAST((l.doc_id * 7919) % 1000 AS DOUBLE) / 1e3 AS pa, CAST((l.doc_id * 104729) % 1000 AS DOUBLE) / 1e3 AS pb,
       CAST((l.doc_id * 7919) % 5 AS INT) AS y5, CAST((l.doc_id * 31 + l.doc_id DIV 7) % 5 AS INT) AS p5
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "fx_old": """
SELECT o_orderkey AS part_id, o_orderkey AS ord, o_orderpriority || ' ' || CAST(o_orderkey DIV 10 AS STRING) AS name, 'h' || CAST(o_custkey AS STRING) AS topology_hash, o_totalprice AS volume, 1e1 AS area,
       1e1 AS sx, 2e1 AS sy, 3e1 AS sz, 1e1 * CAST(o_orderkey AS DOUBLE) + 2e1 * CAST(o_orderkey % 13 AS DOUBLE) AS tx, 0e0 AS ty, 0e0 AS tz, 0e0 AS qx, 0e0 AS qy, 0e0 AS qz, 1e0 AS qw
FROM {orders}""",
    "fx_new": """
SELECT CASE WHEN part_id % 11 = 3 THEN -part_id ELSE part_id END AS part_id, ord,
       CASE WHEN part_id % 7 = 2 THEN name || ' v2' ELSE name END AS name,
       CASE WHEN part_id % 7 = 4 THEN topology_hash || 'x' ELSE topology_hash END AS topology_hash,
       CASE WHEN part_id % 7 = 5 THEN volume * 11e-1 WHEN part_id % 101 = 7 THEN -1e0 ELSE volume END AS volume, area, sx, sy, sz,
       CASE WHEN part_id % 7 = 1 THEN tx + 5e0 ELSE tx END AS tx, ty, tz, qx, qy, qz, qw
FROM fx_old WHERE part_id % 7 <> 0""",
    "fx_points": """
SELECT label AS sample_id, vec_id AS pid, {e1} AS x, {e2} AS y, {e3} AS z FROM {embeddings}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needed(name: str) -> list[str]:
    """The view and those it reads, in order."""
    out = []
    for other in VIEWS:
        if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
            out += [x for x in _needed(other) if x not in out]
    return [*out, name]


def _text(name: str, spark: bool) -> str:
    text = VIEWS[name].replace("DIV", "div" if spark else "//")
    e = "CAST(embedding[{}] AS DOUBLE)"
    for k in (1, 2, 3):
        text = text.replace(f"{{e{k}}}", e.format(k - 1 if spark else k))
    return text if spark else re.sub(r"\{(\w+)\}", r"\1", text)


def ctes(*names: str) -> str:
    """``WITH`` clause for DuckDB that defines the views."""
    order = list(dict.fromkeys(x for n in names for x in _needed(n)))
    return "WITH " + ",\n".join(f"{n} AS ({_text(n, False)})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    order = _needed(name)
    text = "WITH " + ",\n".join(f"{n} AS ({_text(n, True)})" for n in order) + f"\nSELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
