"""Queries over splits, leakage, names, archives, snapshots and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import text as tx
from partloom.operators import labels as lb
from partloom.operators import plumbing as pl
from partloom.operators import quality as ql
from partloom.operators import reconcile as rc
from partloom.plans.adapters import ctes, table, view
from partloom.tables import merged, written

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


FRACTION = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) / 4294967295e0"
H = FRACTION.format(seed="seed", key="CAST(doc_id AS VARCHAR)")
SPLIT = f"CASE WHEN {H} < 1e-1 THEN 'test' WHEN {H} < 2e-1 THEN 'val' ELSE 'train' END"


def _split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", tx.split_of(F.col("doc_id").cast("string")).alias("split"))


@query(f"SELECT doc_id, {SPLIT} AS split FROM documents")
def hash_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "split")


@query(f"SELECT split, source, count(*) AS n FROM (SELECT source, {SPLIT} AS split FROM documents) GROUP BY 1, 2")
def split_class_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("split", "source").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN split = 'train' AND {FRACTION.format(seed='carve', key='CAST(doc_id AS VARCHAR)')} < 15e-2 THEN 'val' ELSE split END AS split FROM (SELECT doc_id, {SPLIT} AS split FROM documents)")
def val_carve(spark, sf_dir):
    return pl.carve_validation(_split(spark, sf_dir), F.col("doc_id").cast("string"), 0.15, "carve").select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= floor(8e-1 * count(*) OVER (PARTITION BY source)) THEN 'train' ELSE 'test' END AS split FROM documents")
def ratio_split(spark, sf_dir):
    return pl.ratio_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", ["source"]).select("doc_id", "split")


@query("SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS class_idx FROM documents WHERE source IS NOT NULL")
def class_index(spark, sf_dir):
    return pl.class_index(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "class_idx")


FAM = f"f AS (SELECT *, CASE WHEN regexp_matches(pn, '^(\\d+[A-Za-z]+)\\d+$') THEN regexp_extract(pn, '^(\\d+[A-Za-z]+)\\d+$', 1) ELSE pn END AS family FROM (SELECT doc_id, lang, CAST(doc_id % 50 AS VARCHAR) || 'T' || CAST(doc_id AS VARCHAR) AS pn, {SPLIT} AS split FROM documents)), t AS (SELECT family, count(*) AS siblings FROM f WHERE split = 'train' GROUP BY 1)"


def _families(spark, sf_dir):
    d = _split(spark, sf_dir)
    return d, F.concat((F.col("doc_id") % 50).cast("string"), F.lit("T"), F.col("doc_id").cast("string"))


@query(f"WITH {FAM} SELECT f.doc_id, f.family, t.siblings FROM f JOIN t ON t.family = f.family WHERE f.split = 'test'")
def family_leakage(spark, sf_dir):
    return pl.family_leakage(*_families(spark, sf_dir)).select("doc_id", "family", "siblings")


@query(f"""WITH {FAM}, l AS (SELECT lang, count(*) AS leaked, count(DISTINCT f.family) AS families FROM f JOIN t ON t.family = f.family WHERE split = 'test' GROUP BY 1), n AS (SELECT lang, count(*) AS tests FROM f WHERE split = 'test' GROUP BY 1)
SELECT n.lang, tests, coalesce(leaked, 0) AS leaked, coalesce(families, 0) AS families, round(CAST(coalesce(leaked, 0) AS DOUBLE) / tests, 4) AS rate FROM n LEFT JOIN l ON l.lang = n.lang""")
def leakage_by_class(spark, sf_dir):
    return pl.leakage_by_class(*_families(spark, sf_dir), "lang")


@query(f"WITH {FAM} SELECT f.doc_id, f.family, t.siblings FROM f JOIN t ON t.family = f.family WHERE f.split = 'test' ORDER BY t.siblings DESC, f.doc_id LIMIT 10")
def leakage_examples(spark, sf_dir):
    return pl.family_leakage(*_families(spark, sf_dir)).select("doc_id", "family", "siblings").orderBy(F.col("siblings").desc(), "doc_id").limit(10)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf_dir):
    return pl.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def matched_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("""WITH s AS (SELECT c_custkey AS id, c_mktsegment || '__' || CAST(c_nationkey AS VARCHAR) || '__' || CAST(c_custkey AS VARCHAR) AS name FROM customer), i AS (SELECT DISTINCT c_mktsegment AS key FROM customer UNION SELECT DISTINCT c_mktsegment || '__' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey % 2 = 0)
SELECT id, name, key FROM (SELECT s.*, i.key, row_number() OVER (PARTITION BY s.name ORDER BY length(i.key) DESC) AS rn FROM s JOIN i ON s.name = i.key OR starts_with(s.name, i.key || '__')) WHERE rn = 1""")
def longest_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nation = F.concat_ws("__", "c_mktsegment", F.col("c_nationkey").cast("string"))
    names = c.select(F.col("c_custkey").alias("id"), F.concat_ws("__", nation, F.col("c_custkey").cast("string")).alias("name"))
    index = c.select(F.col("c_mktsegment").alias("key")).union(c.where("c_nationkey % 2 = 0").select(nation)).distinct()
    return pl.longest_prefix(names, index, "name", "key")


def _sql_case(rules, name, flags="i"):
    return " ".join(f"WHEN regexp_matches({name}, '{p}', '{flags}') THEN '{c}'" for p, c in rules)


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '{lb.SKIP[0]}', 'i') OR regexp_matches(p_name, '{lb.SKIP[1]}', 'i') THEN '_skip' {_sql_case(lb.PART_RULES, 'p_name')} ELSE '_unknown' END AS cls FROM part")
def name_label_rules(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lb.name_class(F.col("p_name")).alias("cls"))


_HARVEST = [(lb.OVERRIDE, "unknown/fastener_override/"), *[(p, f"fastener/{r}/{s}") for p, s, r in lb.HARVEST_RULES]]
_AFTER = [(lb.ASSEMBLY_HINT, "assembly/assembly_hint/"), *[(p, f"non_fastener/{r}/") for p, r in lb.NEGATIVE_RULES]]


@query(f"""WITH n AS (SELECT p_partkey, regexp_replace(replace(p_name, '#', ' '), '[_\\-+.]+', ' ', 'g') AS n FROM part), c AS (SELECT p_partkey, CASE {_sql_case(_HARVEST, 'n')} WHEN regexp_matches(n, '{lb.METRIC_SIZE}') THEN 'fastener/metric_size/metric_fastener' {_sql_case(_AFTER, 'n')} ELSE 'unknown/no_rule/' END AS c FROM n)
SELECT p_partkey, split_part(c, '/', 1) AS label, split_part(c, '/', 2) AS reason, nullif(split_part(c, '/', 3), '') AS subtype FROM c""")
def harvest_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lb.harvest_label(F.col("p_name")).alias("l")).select("p_partkey", "l.*")


_HAS = lambda words: "(" + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + ")"
KEYWORD = f"CASE WHEN p_name IS NULL OR p_name = '' OR starts_with(lower(p_name), 'compound') OR starts_with(p_name, 'unnamed_solid_') THEN 'unknown' WHEN ({_HAS(lb.KEYWORDS)} OR regexp_matches(lower(p_name), '{lb.METRIC_CODE}')) AND NOT {_HAS(lb.NOT_FASTENERS)} THEN 'fastener' ELSE 'non-fastener' END"


@query(f"SELECT p_partkey, {KEYWORD} AS label FROM part")
def keyword_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lb.keyword_label(F.col("p_name")).alias("label"))


@query(f"""WITH s AS (SELECT {KEYWORD} = 'fastener' AS truth, p_size % 3 <> 0 AS pred FROM part), c AS (SELECT count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn, CAST(0 AS BIGINT) AS unk FROM s),
d AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall FROM c) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM d""")
def label_status_prf(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return lb.status_summary(p.select(lb.status(lb.keyword_label(F.col("p_name")) == "fastener", F.col("p_size") % 3 != 0).alias("status")))


@query("""WITH m AS (SELECT o_custkey AS archive, o_orderkey AS pos, o_totalprice AS size FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT *, sum(CASE WHEN size <= 4e5 THEN size ELSE 0 END) OVER (PARTITION BY archive ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM m)
SELECT archive, pos, CASE WHEN size > 4e5 THEN 'skipped_member_too_large' WHEN running > 1e6 THEN 'skipped_archive_too_large' ELSE 'staged' END AS status FROM r""")
def archive_limit_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("a/b"), F.when(F.col("o_orderstatus") == "P", ".txt").otherwise(".step")).alias("name"), F.col("o_totalprice").alias("size"))
    return pl.archive_scan(m, (".step",), 400000, 1000000).select("archive", "pos", "status")


@query("SELECT archive, pos, CASE WHEN n <= 3 THEN 'staged' ELSE 'truncated' END AS status FROM (SELECT o_custkey AS archive, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 4")
def export_cap(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("pos"))
    return pl.export_cap(m, "archive", "pos", 3)


@query("SELECT host, min(page_id) AS ord FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages) GROUP BY host")
def url_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(ql.host(F.col("url")).alias("url"), F.col("page_id").alias("ord"))
    return pl.url_dedup(p).withColumnRenamed("url", "host")


@query("SELECT page_id, host = 'example.org' OR ends_with(host, '.example.org') OR host = 'example.net' OR ends_with(host, '.example.net') AS restricted FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages)")
def restricted_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ql.restricted(F.col("url"), ("example.org", "example.net")).alias("restricted"))


SLUG = "lower(p_type) || '-steel-' || replace(p_name, ' ', '-') || '-' || CAST(p_size AS VARCHAR)"


@query(f"""WITH i AS (SELECT p_partkey, p_size AS prio, string_split(regexp_replace({SLUG}, '-\\d+$', ''), '-') AS t FROM part), k AS (SELECT p_partkey, prio, array_to_string(list_filter(t, lambda x: x <> '' AND NOT list_contains([{", ".join(f"'{t}'" for t in pl.MATERIAL_TOKENS)}], x)), '-') AS geometry_key FROM i)
SELECT geometry_key, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY geometry_key ORDER BY prio, p_partkey) AS rn FROM k) WHERE rn = 1""")
def geometry_dedup_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    slug = F.concat(F.lit("/products/"), F.lower("p_type"), F.lit("-steel-"), F.translate("p_name", " ", "-"), F.lit("-"), F.col("p_size").cast("string"), F.lit("~~/"))
    items = p.select("p_partkey", slug.alias("url"), F.col("p_size").alias("prio"))
    return pl.dedup_by_geometry(items, "url", "prio", "p_partkey").select("geometry_key", "p_partkey")


@query("SELECT p_partkey, CASE WHEN rn > 0 THEN p_name || '_' || CAST(rn AS VARCHAR) ELSE p_name END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS rn FROM part)")
def unique_names(spark, sf_dir):
    return pl.unique_names(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query(f"SELECT split, source, count(*) AS total, CAST(sum(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate FROM (SELECT doc_id, source, {SPLIT} AS split FROM documents) GROUP BY ROLLUP (split, source)")
def retention_rollup(spark, sf_dir):
    return pl.retention(_split(spark, sf_dir), F.col("doc_id") % 3 != 0, "split", "source")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 3 END AS parent, c_name AS name FROM customer), w AS (SELECT id, name AS path, 1 AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, w.path || '/' || n.name, w.depth + 1 FROM w JOIN n ON n.parent = w.id AND n.id <> w.id)
SELECT id, path, CAST(depth AS INT) AS depth FROM w""")
def assembly_path(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("part_id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 3)).alias("parent_id"), F.col("c_name").alias("name"))
    return pl.assembly_paths(n)


SNAP = ctes("fx_old", "fx_new")
GAP = "abs(n.volume - o.volume) / greatest(n.volume, o.volume, 1e-10)"
CHANGE = f"CASE WHEN n.topology_hash <> o.topology_hash OR {GAP} >= 1e-3 THEN 'reshaped' WHEN abs(n.tx - o.tx) > 1e-2 OR abs(n.ty - o.ty) > 1e-2 THEN 'moved' WHEN n.name <> o.name THEN 'renamed' ELSE 'unchanged' END"
DIFF = f"""{SNAP}, d AS (SELECT n.part_id, o.part_id AS old_id, {CHANGE} AS change_type, 1e0 AS confidence FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id
UNION ALL SELECT part_id, NULL, 'added', NULL FROM fx_new n WHERE NOT EXISTS (SELECT 1 FROM fx_old o WHERE o.part_id = n.part_id) UNION ALL SELECT part_id, part_id, 'deleted', NULL FROM fx_old o WHERE NOT EXISTS (SELECT 1 FROM fx_new n WHERE o.part_id = n.part_id))"""


def _snapshots(spark, sf_dir):
    return view(spark, sf_dir, "fx_new"), view(spark, sf_dir, "fx_old")


@query(DIFF + " SELECT * FROM d")
def uuid_match_diff(spark, sf_dir):
    return rc.diff_by_id(*_snapshots(spark, sf_dir))


@query(DIFF + f", k(change_type) AS (VALUES {', '.join(f'({k!r})' for k in rc.KINDS)}) SELECT k.change_type, count(d.change_type) AS n FROM k LEFT JOIN d ON d.change_type = k.change_type GROUP BY 1")
def change_summary(spark, sf_dir):
    return rc.diff_summary(rc.diff_by_id(*_snapshots(spark, sf_dir)))


REL = "r AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'fastener' WHEN 1 THEN 'mate' ELSE 'weld' END AS kind, o_orderkey AS subject_id, o_orderkey + 1 AS target_id FROM orders)"


@query(f"""{SNAP}, {REL}, j AS (SELECT r.*, s.part_id AS new_subject, t.part_id AS new_target, s.tx AS stx, t.tx AS ttx, s.sx AS ssx, t.sx AS tsx FROM r LEFT JOIN fx_new s ON s.part_id = subject_id LEFT JOIN fx_new t ON t.part_id = target_id)
SELECT kind, subject_id, target_id, new_subject, new_target, CASE WHEN new_subject IS NULL OR new_target IS NULL THEN true WHEN kind = 'fastener' THEN NOT (abs(stx - ttx) < 11e1) WHEN kind = 'mate' THEN stx + 1e1 + 1e0 < ttx - 1e0 OR ttx + 1e1 + 1e0 < stx - 1e0 ELSE false END AS broken FROM j""")
def relationship_revalidation(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    edges = o.select(F.when(k % 3 == 0, "fastener").when(k % 3 == 1, "mate").otherwise("weld").alias("kind"), k.alias("subject_id"), (k + 1).alias("target_id"))
    boxed = new.select("part_id", "tx", "ty", "tz", *[F.lit(0.0).alias(f"lo_{a}") for a in "xyz"], *[F.col(f"s{a}").alias(f"hi_{a}") for a in "xyz"])
    return rc.revalidate(edges, rc.uuid_matches(new, old), boxed)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)")
def pmi_orphans(spark, sf_dir):
    pmi = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target_id"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("part_id"))
    return ql.pmi_orphans(pmi, parts).select("l_orderkey", "l_linenumber")


@query(f"""{SNAP} SELECT part_id, 'negative_volume' AS reason FROM fx_new WHERE volume < 0 UNION ALL SELECT n.part_id, 'volume_change' FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id WHERE o.volume > 0 AND abs(n.volume - o.volume) / o.volume > 1e-3""")
def mass_failures(spark, sf_dir):
    return ql.mass_failures(*_snapshots(spark, sf_dir))


LOSS = f"""l AS (SELECT part_id, 'lost_part' AS loss FROM fx_old o WHERE NOT EXISTS (SELECT 1 FROM fx_new n WHERE n.part_id = o.part_id) UNION ALL SELECT n.part_id, 'name_change' FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id WHERE n.name <> o.name)"""


@query(f"{SNAP}, {LOSS} SELECT * FROM l")
def transfer_losses(spark, sf_dir):
    return ql.losses(*_snapshots(spark, sf_dir))


def _checks(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return ql.report([ql.geometric_diff(new, old), ql.mass_properties(new, old), ql.transfer_losses(new, old), ql.visual_placeholder(spark)])


REPORT = f"""{SNAP}, {LOSS}, g AS (SELECT abs(n.volume - o.volume) / o.volume AS rel FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id WHERE o.volume > 0),
m AS (SELECT (SELECT count(*) FROM fx_new WHERE volume < 0) + (SELECT count(*) FROM g WHERE rel > 1e-3) AS f)
SELECT 'geometric_diff' AS "check", count(*) = 0 AS passed, 1e0 - least(coalesce(max(rel), 0e0), 1e0) AS score, count(*) AS failures FROM g WHERE rel > 5e-2
UNION ALL SELECT 'mass_properties', f = 0, greatest(0e0, 1e0 - CAST(f AS DOUBLE) / (SELECT count(*) FROM fx_new)), f FROM m
UNION ALL SELECT 'transfer_losses', count(*) = 0, greatest(0e0, 1e0 - CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fx_old)), count(*) FROM l UNION ALL SELECT 'visual_diff', true, 1e0, 0"""


@query(REPORT)
def validation_report(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(f"SELECT bool_and(passed) AS all_passed, count(*) FILTER (passed) || '/' || count(*) || ' checks passed' AS summary FROM ({REPORT}) r")
def validation_summary(spark, sf_dir):
    return ql.report_summary(_checks(spark, sf_dir))


def _greedy(name, candidates):
    """Recursive SQL of the sequential choice: in order each new part takes its best old part that isn't in ``used``."""
    return f"""{name}_r AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY new_ord, new_id) AS n FROM ({candidates})),
{name}_g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS new_id, CAST(NULL AS BIGINT) AS old_id, CAST(NULL AS DOUBLE) AS confidence
 UNION ALL SELECT n + 1, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.o) END, b.i, b.o, -b.c FROM (
  SELECT g.n, g.used, min(struct_pack(c := -r.confidence, p := r.old_ord, o := r.old_id, i := r.new_id)) FILTER (r.n IS NOT NULL) AS b
  FROM {name}_g g LEFT JOIN {name}_r r ON r.n = g.n + 1 AND NOT list_contains(g.used, r.old_id) WHERE g.n < (SELECT coalesce(max(n), 0) FROM {name}_r) GROUP BY g.n, g.used)),
{name} AS (SELECT new_id, old_id, confidence FROM {name}_g WHERE old_id IS NOT NULL)"""


BOX = "1e0"  # all boxes of the fixture are equal
LADDER = f"CASE WHEN n.topology_hash = o.topology_hash THEN CASE WHEN {GAP} <= 1e-3 THEN 95e-2 WHEN {GAP} <= 1e-2 THEN 85e-2 ELSE 8e-1 END WHEN {BOX} > 9e-1 AND {GAP} <= 1e-3 THEN 85e-2 WHEN {BOX} > 8e-1 AND {GAP} <= 1e-2 THEN 7e-1 WHEN {GAP} <= 5e-2 THEN 6e-1 ELSE 0e0 END"
RESTS = "fresh AS MATERIALIZED (SELECT * FROM fx_new WHERE part_id NOT IN (SELECT part_id FROM fx_old)), gone AS MATERIALIZED (SELECT * FROM fx_old WHERE part_id NOT IN (SELECT part_id FROM fx_new))"
BY_SHAPE = _greedy("shaped", f"SELECT n.part_id AS new_id, n.ord AS new_ord, o.part_id AS old_id, o.ord AS old_ord, {LADDER} AS confidence FROM fresh n JOIN gone o ON {LADDER} >= 6e-1")
RECURSIVE = SNAP.replace("WITH", "WITH RECURSIVE", 1)


@query(f"{RECURSIVE}, {RESTS}, {BY_SHAPE} SELECT * FROM shaped")
def fingerprint_match(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    rest = lambda a, b: merged(a).join(merged(b.select("part_id")), "part_id", "left_anti")
    return rc.fingerprint_match(rest(new, old), rest(old, new))


TOKENS = r"list_distinct(string_split_regex(trim(replace(replace(lower({0}), '_', ' '), '-', ' ')), '\s+'))"
ALIKE = f"CASE WHEN n.name = o.name THEN 1e0 WHEN lower(trim(n.name)) = lower(trim(o.name)) THEN 95e-2 WHEN contains(lower(trim(o.name)), lower(trim(n.name))) OR contains(lower(trim(n.name)), lower(trim(o.name))) THEN 8e-1 ELSE CAST(len(list_intersect({TOKENS.format('n.name')}, {TOKENS.format('o.name')})) AS DOUBLE) / greatest(len({TOKENS.format('n.name')}), len({TOKENS.format('o.name')})) END"
NEAR = "sqrt((n.tx - o.tx) * (n.tx - o.tx) + (n.ty - o.ty) * (n.ty - o.ty) + (n.tz - o.tz) * (n.tz - o.tz))"
BY_NAME = _greedy("named", f"SELECT * FROM (SELECT n.part_id AS new_id, n.ord AS new_ord, o.part_id AS old_id, o.ord AS old_ord, {ALIKE} * 5e-1 + greatest(0e0, 1e0 - {NEAR} / 1e3) * 5e-1 AS confidence FROM fresh2 n JOIN gone2 o ON {NEAR} < 1e3 OR lower(trim(n.name)) = lower(trim(o.name))) WHERE confidence >= 5e-1")
MATCHED = f"""{RECURSIVE}, {RESTS}, {BY_SHAPE}, accepted AS MATERIALIZED (SELECT * FROM shaped WHERE confidence >= 85e-2),
fresh2 AS MATERIALIZED (SELECT * FROM fresh WHERE part_id NOT IN (SELECT new_id FROM accepted)), gone2 AS MATERIALIZED (SELECT * FROM gone WHERE part_id NOT IN (SELECT old_id FROM accepted)), {BY_NAME},
matched AS (SELECT n.part_id AS new_id, o.part_id AS old_id, 1e0 AS confidence, 'uuid' AS stage FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id UNION ALL SELECT new_id, old_id, confidence, 'fingerprint' FROM accepted UNION ALL SELECT new_id, old_id, least(confidence, 75e-2), 'name_position' FROM named WHERE confidence >= 7e-1)"""


@query(MATCHED + " SELECT new_id, old_id, round(confidence, 9) AS confidence, stage, confidence < 8e-1 AS ambiguous FROM matched")
def snapshot_match(spark, sf_dir):
    return rc.match(*_snapshots(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query(MATCHED + """, c AS (SELECT new_id, old_id FROM matched UNION SELECT new_id, old_id + 1 FROM matched WHERE old_id % 10 = 1)
SELECT 'matches' AS kind, count(*) AS n FROM matched UNION ALL SELECT 'ambiguous', count(*) FROM matched WHERE confidence < 8e-1 UNION ALL SELECT 'splits', count(*) FROM (SELECT old_id FROM c GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'merges', count(*) FROM (SELECT new_id FROM c GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'new_parts', count(*) FROM fx_new WHERE part_id NOT IN (SELECT new_id FROM matched) UNION ALL SELECT 'deleted_parts', count(*) FROM fx_old WHERE part_id NOT IN (SELECT old_id FROM matched)""")
def snapshot_report(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    known = written(rc.match(new, old), "matches")
    extra = known.where("old_id % 10 = 1").select("new_id", (F.col("old_id") + 1).alias("old_id"), "confidence")
    found = rc.match_all(new, old, extra, known)
    counts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, df in found.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
