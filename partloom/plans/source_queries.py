"""Round trips through the sinks and readers, over documents made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from partloom.functions import text as tx
from partloom.operators import plumbing as pl
from partloom.operators import quality as ql
from partloom.operators import summaries as sm
from partloom.plans.adapters import ctes, table, view
from partloom.sources import readers, sinks
from partloom.streaming.events import read_events
from partloom.tables import dealt, home

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _folder(spark, name):
    return f"{home(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _files(df):
    """A (path, content) table as readers take it."""
    return df.select("path", F.col("content").cast("binary").alias("content"))


def _words(*hexes):
    """Little-endian 32-bit words of integer columns, as hex."""
    turned = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c.cast("long")), 8, "0"), at, 2) for at in (7, 5, 3, 1)])
    return F.concat(*map(turned, hexes))


#: Floats as 32-bit words: 0.0, 1.0, 2.0 and 4.0.
FLOATS = {0: 0x00000000, 1: 0x3F800000, 2: 0x40000000, 4: 0x40800000}


def _float(c):
    out = F.lit(FLOATS[0])
    for value, bits in FLOATS.items():
        out = F.when(c == value, F.lit(bits)).otherwise(out)
    return out


ASSEMBLY = "a AS (SELECT 'm' || CAST(p_partkey % 50 AS VARCHAR) AS manifest_id, p_partkey AS ord, 'u' || CAST(p_partkey AS VARCHAR) AS part_id, CASE WHEN p_partkey > 50 THEN 'u' || CAST(p_partkey - 50 AS VARCHAR) END AS parent_id, p_name AS name, p_size AS size, p_type AS kind FROM part)"


def _assembly(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    named = lambda c: F.concat(F.lit("u"), c.cast("string"))
    return p.select(F.concat(F.lit("m"), (k % 50).cast("string")).alias("manifest_id"), k.alias("ord"), named(k).alias("part_id"), F.when(k > 50, named(k - 50)).alias("parent_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))


def _manifests(spark, sf_dir):
    """Manifest documents of the assembly: a row per manifest."""
    a = _assembly(spark, sf_dir)
    meta = a.select("manifest_id").distinct().select("manifest_id", F.lit("1.0").alias("version"), F.lit("mm").alias("units"), F.concat(F.lit("source "), "manifest_id").alias("source"))
    parts = a.select("manifest_id", "ord", F.col("part_id").alias("uuid"), "name", F.col("parent_id").alias("parent_uuid"), F.array(F.lower("kind")).alias("tags"))
    relations = a.where("parent_id is not null").select("manifest_id", "ord", F.lit("fastener").alias("kind"), F.col("part_id").alias("subject_uuid"), F.col("parent_id").alias("target_uuid"))
    return sinks.manifest_json(meta, parts, relations)


def _manifest_rows(tables):
    relations = tables["relationships"].select("manifest_id", F.col("subject_uuid").alias("uuid"), F.col("target_uuid").alias("fastened_to"), F.col("kind").alias("relation"))
    parts = tables["parts"].select("manifest_id", "uuid", "name", "parent_uuid", F.get("tags", 0).alias("tag"))
    return parts.join(relations, ["manifest_id", "uuid"], "left").join(tables["meta"].select("manifest_id", F.col("source").alias("from_source"), "units"), "manifest_id").drop("manifest_id")


MANIFEST_SQL = f"WITH {ASSEMBLY} SELECT part_id AS uuid, name, parent_id AS parent_uuid, lower(kind) AS tag, parent_id AS fastened_to, CASE WHEN parent_id IS NOT NULL THEN 'fastener' END AS relation, 'source ' || manifest_id AS from_source, 'mm' AS units FROM a"


@query(MANIFEST_SQL)
def manifest_round_trip(spark, sf_dir):
    to = _folder(spark, "manifests")
    _manifests(spark, sf_dir).select("value", "manifest_id").write.partitionBy("manifest_id").text(to)
    return _manifest_rows(readers.read_manifests(spark, f"{to}/*"))


@query(MANIFEST_SQL)
def bundle_zip_round_trip(spark, sf_dir):
    members = _manifests(spark, sf_dir).select(F.col("manifest_id").alias("path"), F.lit("manifest.json").alias("member"), F.encode("value", "UTF-8").alias("content"))
    notes = members.select("path", F.lit("README.txt").alias("member"), F.encode(F.lit("notes"), "UTF-8").alias("content"))
    return _manifest_rows(readers.bundle_manifests(readers.zip_members(sinks.zip_bundles(members.union(notes)))))


@query("SELECT CAST(n AS INT) AS version, CAST((SELECT count(*) FROM nation WHERE n_regionkey < n) AS BIGINT) AS parts, '[2026-01-0' || n || 'T00:00:00Z] change ' || n AS line FROM (SELECT unnest(range(1, 4)) AS n)")
def history_versions(spark, sf_dir):
    root, nation = _folder(spark, "bundle"), table(spark, sf_dir, "nation")
    for n in (1, 2, 3):
        sinks.write_history(nation.where(F.col("n_regionkey") < n), root, f"change {n}", F.to_timestamp(F.lit(f"2026-01-0{n} 00:00:00")))
    held = spark.read.parquet(f"{root}/parts").groupBy(F.col("version").cast("int").alias("version")).agg(F.count("*").alias("parts"))
    return held.join(spark.read.parquet(f"{root}/log"), "version")


@query(f"WITH {ASSEMBLY}, n AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY ord) AS i FROM a) SELECT manifest_id, CAST(2 * i AS INT) AS pos, '#' || (2 * i - 1) || ' = PRODUCT(''' || name || ''',''' || name || ''','''',());' || chr(10) || '#' || (2 * i) || ' = PRODUCT_DEFINITION_FORMATION('''','''',#' || (2 * i - 1) || ');' AS line FROM n")
def exchange_lines(spark, sf_dir):
    return sinks.exchange_text(_assembly(spark, sf_dir)).where(f"pos > 0 and pos < {2**31 - 1}").select("manifest_id", "pos", "line")


@query(f"WITH {ASSEMBLY} SELECT manifest_id, arg_min(name, ord) AS name FROM a GROUP BY manifest_id UNION ALL SELECT 'none', 'none'")
def exchange_product_names(spark, sf_dir):
    lines = sinks.exchange_text(_assembly(spark, sf_dir))
    texts = lines.groupBy("manifest_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))
    files = texts.select(F.concat(F.lit("/x/"), "manifest_id", F.lit(".step")).alias("path"), "content").union(spark.range(1).select(F.lit("/x/none.step"), F.lit("no product here")))
    return readers.product_names_of(_files(files)).select(F.regexp_extract("path", "/x/(.*)\\.step", 1).alias("manifest_id"), "name")


@query(f"""WITH {ASSEMBLY}, n AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY ord) - 1 AS node FROM a)
SELECT n.manifest_id, CAST(n.node AS INT) AS node, n.name, n.part_id, CAST(p.node AS INT) AS parent, 'mat ' || n.kind AS material, CAST(n.size AS DOUBLE) / 50 AS red, CAST(n.size % 2 AS DOUBLE) AS metallic, 'opaque' AS alpha_mode, 'exchange' AS source_type
FROM n LEFT JOIN n p ON p.manifest_id = n.manifest_id AND p.part_id = n.parent_id""")
def gltf_round_trip(spark, sf_dir):
    a = _assembly(spark, sf_dir)
    color = F.array(F.col("size") / 50.0, F.lit(0.5), F.lit(0.25), F.lit(1.0))
    own = F.struct(F.concat(F.lit("mat "), "kind").alias("name"), color.alias("base_color"), (F.col("size") % 2).cast("double").alias("metallic"), F.lit(0.5).alias("roughness"))
    # a mesh for every node gives its material back
    doc = sinks.gltf_document(a.withColumn("material", own).withColumn("source_type", F.lit("exchange")))
    sized = a.groupBy("manifest_id").agg(F.count("*").alias("n"))
    meshed = doc.join(sized, "manifest_id").withColumn("meshes", F.to_json(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(F.array(F.struct(i.alias("material"))).alias("primitives")))))
    nodes = F.from_json(F.get_json_object("value", "$.nodes"), "array<struct<name:string,children:array<int>,extras:struct<part_uuid:string,source_type:string>>>")
    with_mesh = F.to_json(F.transform(nodes, lambda x, i: F.struct(x["name"].alias("name"), x["children"].alias("children"), x["extras"].alias("extras"), i.alias("mesh"))))
    value = F.concat(F.lit('{"nodes":'), with_mesh, F.lit(',"meshes":'), "meshes", F.lit(',"materials":'), F.get_json_object("value", "$.materials"), F.lit("}"))
    files = _files(meshed.select(F.col("manifest_id").alias("path"), F.encode(value, "UTF-8").alias("content")))
    found, made = readers.gltf_nodes_of(files).select("path", "node", "name", "part_id", "parent"), readers.gltf_materials_of(files)
    out = found.join(made.drop("name"), ["path", "node"])
    return out.select(F.col("path").alias("manifest_id"), "node", "name", "part_id", "parent", "material", F.get("base_color", 0).alias("red"), "metallic", "alpha_mode", "source_type")


def _glb(spark, sf_dir):
    """A GLB file for each supplier: one mesh of two primitives, a triangle (0,0,0), (s,0,0), (0,s,0) and one a metre up."""
    s = dealt(table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("s")), "s_suppkey")
    zero, one, size = (_float(F.lit(0)), _float(F.lit(1)), _float(F.col("s")))
    low = [zero, zero, zero, size, zero, zero, zero, size, zero]
    high = [zero, zero, one, size, zero, one, zero, size, one]
    blob = _words(*low, *high, *map(F.lit, (0, 1, 2)))
    doc = '{"nodes":[{"name":"n","mesh":0}],"meshes":[{"primitives":[{"attributes":{"POSITION":0},"indices":2},{"attributes":{"POSITION":1}},{"attributes":{"POSITION":1},"mode":1}]}],"accessors":[{"bufferView":0,"componentType":5126,"type":"VEC3","count":3},{"bufferView":0,"byteOffset":36,"componentType":5126,"type":"VEC3","count":3},{"bufferView":1,"componentType":5125,"type":"SCALAR","count":3}],"bufferViews":[{"byteOffset":0},{"byteOffset":72}]}'
    doc += " " * (-len(doc) % 4)
    head = f"676C5446{2:02X}000000"
    total = 12 + 8 + len(doc) + 8 + 84
    content = F.concat(F.lit(head), _words(F.lit(total), F.lit(len(doc)), F.lit(0x4E4F534A)), F.hex(F.encode(F.lit(doc), "UTF-8")), _words(F.lit(84), F.lit(0x004E4942)), blob)
    return s.select("s_suppkey", "s", F.col("s_suppkey").cast("string").alias("path"), F.unhex(content).alias("content"))


SIZED = "s AS (SELECT s_suppkey, [1e0, 2e0, 4e0][s_suppkey % 3 + 1] AS s FROM supplier)"


@query(f"WITH {SIZED} SELECT s_suppkey, k AS a, k + 1 AS b, k + 2 AS c, s AS bx, 0e0 AS by_, s AS cy, CAST(k / 3 AS DOUBLE) AS az, k + 3 AS n_vertices FROM s CROSS JOIN (SELECT unnest([0, 3]) AS k)")
def gltf_triangles(spark, sf_dir):
    t = readers.gltf_triangles_of(_glb(spark, sf_dir))
    return t.select(F.col("path").cast("long").alias("s_suppkey"), "a", "b", "c", "bx", F.col("by").alias("by_"), "cy", "az", "n_vertices")


@query(f"""WITH {SIZED} SELECT s_suppkey, 0e0 AS min_x, 1e3 * s AS max_x, -1e3 AS min_y, 0e0 AS max_y, 1e3 * s AS max_z, 1e6 * s * s AS area, round(1e9 * s * s / 6, 3) AS volume, CAST(6 AS BIGINT) AS n_vertices, CAST(2 AS BIGINT) AS n_faces,
sha256('F2|E0|V6|FA:' || printf('%.4f', 5e5 * s * s) || ',' || printf('%.4f', 5e5 * s * s)) AS topology_hash FROM s""")
def gltf_fingerprints(spark, sf_dir):
    f = readers.mesh_fingerprints(readers.gltf_triangles_of(_glb(spark, sf_dir)))
    return f.select(F.col("path").cast("long").alias("s_suppkey"), *[F.col(c) + 0.0 for c in ()], (F.col("min_x") + 0.0).alias("min_x"), "max_x", "min_y", (F.col("max_y") + 0.0).alias("max_y"), "max_z", "area", F.round("volume", 3).alias("volume"), "n_vertices", "n_faces", "topology_hash")


def _binary_meshes(spark, sf_dir, head):
    s = table(spark, sf_dir, "supplier")
    size = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    zero, x = _float(F.lit(0)), _float(size)
    body = _words(zero, zero, zero, x, zero, zero, zero, x, zero, *map(F.lit, (0, 1, 2)))
    broken = F.col("s_suppkey") % 7 == 0
    content = F.when(broken, F.lit("FFFFFFFF")).otherwise(F.concat(head, body))
    return s.select(F.col("s_suppkey").cast("string").alias("path"), F.unhex(content).alias("content"))


def _mesh_rows(meshes):
    at = lambda i: F.get("xyz", i).cast("double")
    return meshes.select(F.col("path").cast("long").alias("s_suppkey"), "n_vertices", "n_faces", at(3).alias("x1"), at(7).alias("y2"), F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("idx"))


@query(f"WITH {SIZED} SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 3 END AS n_vertices, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS n_faces, CASE WHEN s_suppkey % 7 <> 0 THEN s END AS x1, CASE WHEN s_suppkey % 7 <> 0 THEN s END AS y2, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '0,1,2' END AS idx FROM s")
def udsmesh_decode(spark, sf_dir):
    odd = F.col("s_suppkey") % 2 == 1
    head = F.when(odd, _words(F.lit(3), F.lit(3))).otherwise(_words(F.lit(0), F.lit(1), F.lit(3), F.lit(3)))
    return _mesh_rows(readers.udsmesh_of(_binary_meshes(spark, sf_dir, head)))


@query(f"WITH {SIZED} SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 3 END AS n_vertices, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS n_faces, CASE WHEN s_suppkey % 7 <> 0 THEN 1e1 * s END AS x1, CASE WHEN s_suppkey % 7 <> 0 THEN -1e1 * s END AS y2, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '0,1,2' END AS idx FROM s")
def bundle_mesh_decode(spark, sf_dir):
    return _mesh_rows(readers.bundle_meshes_of(_binary_meshes(spark, sf_dir, F.concat(F.lit("4D455348"), _words(F.lit(1), F.lit(3), F.lit(3))))))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS part_id, s_name AS name, 10 * s_acctbal AS x, -10e0 * s_nationkey AS y, CASE WHEN s_suppkey % 2 = 0 THEN 'paint' ELSE 'mat_' || s_name END AS material, CASE WHEN s_suppkey % 2 = 0 THEN 25e-2 ELSE 7e-1 END AS red, CASE WHEN s_suppkey % 3 = 0 THEN 'original_step' ELSE 'unreal_native' END AS source_type FROM supplier""")
def unreal_bundle_round_trip(spark, sf_dir):
    k = F.col("s_suppkey")
    paint = F.when(k % 2 == 0, F.array(F.struct(F.lit("paint").alias("name"), F.array(*map(F.lit, (0.25, 0.5, 0.5, 1.0))).alias("base_color"))))
    place = F.struct(F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double"), F.lit(0.0)).alias("translation"))
    origin = F.when(k % 3 == 0, F.create_map(F.lit("Datasmith_SourceCADPath"), F.lit("a.step")))
    part = F.struct(k.cast("string").alias("uuid"), F.col("s_name").alias("name"), place.alias("transform"), paint.alias("materials"), origin.alias("source_provenance"))
    to = _folder(spark, "unreal")
    table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(part).alias("parts")).select(F.to_json(F.struct("parts")).alias("value"), "s_nationkey").write.partitionBy("s_nationkey").text(to)
    r = readers.read_unreal_bundle(spark, f"{to}/*")
    return r.select("part_id", "name", F.get("translation", 0).alias("x"), (F.get("translation", 1) + 0.0).alias("y"), F.col("material.name").alias("material"), F.get("material.base_color", 0).alias("red"), "source_type")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS part_id, s_name AS name, 'SM_' || s_name AS mesh, 'M_mat' || (s_nationkey % 4) AS material, CAST(s_nationkey % 4 AS DOUBLE) / 4 AS red, round(CAST(s_nationkey AS DOUBLE), 6) AS x, round(CAST(s_suppkey AS DOUBLE), 6) AS y FROM supplier""")
def datasmith_round_trip(spark, sf_dir):
    kind = F.col("s_nationkey") % 4
    own = F.struct(F.concat(F.lit("mat"), kind.cast("string")).alias("name"), F.array(kind / 4.0, F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("base_color"), F.lit(0.0).alias("metallic"), F.lit(0.5).alias("roughness"))
    place = F.array(F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double"), F.lit(0.0))
    parts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("part_id"), F.col("s_name").alias("name"), place.alias("translation"), own.alias("material"))
    to = _folder(spark, "scene")
    sinks.write_datasmith(parts, to)
    actors, colors = readers.read_datasmith(spark, f"{to}/actors"), readers.read_datasmith_materials(spark, f"{to}/materials")
    j = actors.withColumn("material", F.get("materials", 0)).join(colors.select(F.col("name").alias("material"), F.get("base_color", 0).alias("red")), "material")
    return j.select("part_id", "name", "mesh", "material", "red", F.round(F.get("translation", 0), 6).alias("x"), F.round(F.get("translation", 1), 6).alias("y"))


@query("""WITH l AS (SELECT trim(split_part(unnest(regexp_split_to_array(url || ', a note', '\\r\\n|\\n|\\r')), ',', 1), ' ') AS url FROM pages WHERE url IS NOT NULL)
SELECT DISTINCT url FROM l WHERE url <> '' AND NOT starts_with(url, '#')""")
def url_manifest(spark, sf_dir):
    to = _folder(spark, "urls")
    urls = table(spark, sf_dir, "pages").where("url is not null").select("url")
    lines = urls.select(F.concat("url", F.lit(", a note")).alias("value")).union(spark.range(1).select(F.lit("# marked"))).union(spark.range(1).select(F.lit("  ")))
    lines.write.text(to)
    return readers.read_url_manifest(spark, to).distinct()


@query("SELECT event_type, count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(CASE WHEN payload_k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_k FROM (SELECT event_type, CAST(event_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS payload_k FROM events) GROUP BY event_type")
def event_lines_stream(spark, sf_dir):
    to = _folder(spark, "lines")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("id"), F.lit(None).cast("timestamp").alias("ts"), F.from_json("props", "map<string,string>").alias("payload"))
    sinks.event_lines(e).write.text(f"{to}/in")
    read_events(spark, f"{to}/in").writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{to}/out").where("bad is null")
    return out.groupBy(F.col("event").alias("event_type")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum(F.try_element_at("payload", F.lit("k")).isNull().cast("long")).alias("without_k"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey > 9 THEN s_nationkey END AS s_nationkey FROM supplier")
def csv_round_trip(spark, sf_dir):
    to = _folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") > 9, F.col("s_nationkey")).alias("s_nationkey")), to)
    kinds = {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": table(spark, sf_dir, "supplier").schema["s_nationkey"].dataType.simpleString()}
    return spark.read.csv(to, header=True, schema=", ".join(f"{k} {v}" for k, v in kinds.items()))


@query("""SELECT '{"name":"' || n_name || '"' || CASE WHEN n_regionkey > 1 THEN ',"region":' || n_regionkey ELSE '' END || '}' AS value FROM nation""")
def null_free_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(sinks.null_free_json(F.struct(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("region"))).alias("value"))


FRACTION = "CAST('0x' || substr(md5('seed:' || {key}), 1, 8) AS BIGINT) / 4294967295e0"


@query(f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id FROM documents) SELECT sample_id, CASE WHEN CAST(sample_id AS BIGINT) % 5 = 0 THEN 'test' WHEN {FRACTION.format(key='sample_id')} < 1e-1 THEN 'val' ELSE 'train' END AS split FROM d")
def split_file(spark, sf_dir):
    to, d = _folder(spark, "split"), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("s"), (F.col("doc_id") % 5 == 0).alias("t"))
    lists = d.agg(F.collect_list(F.when(~F.col("t"), F.col("s"))).alias("train"), F.collect_list(F.when(F.col("t"), F.col("s"))).alias("test"))
    lists.select(F.to_json(F.struct("train", "test")).alias("value")).coalesce(1).write.text(to)
    return readers.split_file(spark, to)


@query("""WITH l AS (SELECT 'train' AS split, source AS cls, CAST(doc_id AS VARCHAR) AS model FROM (SELECT doc_id, coalesce(source, 'none') AS source FROM documents)), c AS (SELECT cls, CAST(row_number() OVER (ORDER BY cls) - 1 AS INT) AS class_idx FROM (SELECT DISTINCT cls FROM l))
SELECT 'nested' AS layout, l.cls, class_idx, model FROM l JOIN c ON c.cls = l.cls UNION ALL SELECT 'flat', '_flat', 0, model FROM (SELECT model, row_number() OVER (ORDER BY model) AS i, count(*) OVER () AS n FROM l) WHERE i <= floor(n * 8e-1)
UNION ALL SELECT 'held out', cls, class_idx, model FROM (SELECT l.cls, class_idx, model, row_number() OVER (ORDER BY l.cls, model) AS i, count(*) OVER () AS n FROM l JOIN c ON c.cls = l.cls) WHERE i > floor(n * 8e-1)""")
def model_layouts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    model = F.col("doc_id").cast("string")
    files = lambda *folders: d.select(F.explode(F.array(F.lit("face_grids.npy"), F.lit("notes.txt"))).alias("f"), *[c.alias(f"c{i}") for i, c in enumerate(folders)]).select(F.concat_ws("/", *[f"c{i}" for i in range(len(folders))], "f").alias("path"))
    nested = pl.model_samples(files(F.lit("train"), F.col("source"), model), "train").withColumn("layout", F.lit("nested"))
    flat = pl.model_samples(files(model), "train").withColumn("layout", F.lit("flat"))
    held = pl.model_samples(files(F.col("source"), model), "test").withColumn("layout", F.lit("held out"))
    return nested.unionByName(flat).unionByName(held)


@query("SELECT split, cls, name FROM (SELECT CASE n_nationkey % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split, 'r' || n_regionkey AS cls, n_name AS name FROM nation)")
def sample_folders(spark, sf_dir):
    to = _folder(spark, "samples")
    n = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "train").otherwise("test").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"), F.col("n_name").alias("c"), F.col("n_name").alias("value"))
    n.write.partitionBy("a", "b", "c").text(to)
    found = readers.scan_samples(spark, to, "*.txt")
    plain = lambda c: F.regexp_replace(c, "^[abc]=", "")
    at = lambda k: F.element_at(F.split("path", "/"), F.lit(-k))
    return found.select(plain(at(4)).alias("split"), plain(F.col("split")).alias("cls"), F.url_decode(plain(F.col("class"))).alias("name"))


@query("""SELECT file, CASE WHEN n > 0 THEN name || '_' || n ELSE name END AS name FROM (SELECT file, name, row_number() OVER (PARTITION BY file, name ORDER BY ord) - 1 AS n FROM (
SELECT file, ord, CASE WHEN raw IS NULL OR regexp_matches(lower(raw), 'unnamed') THEN 'Part_' || lpad(CAST(row_number() OVER (PARTITION BY file ORDER BY ord) AS VARCHAR), 3, '0') ELSE raw END AS name FROM (
SELECT o_custkey AS file, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unnamed solid' ELSE o_orderpriority END AS raw FROM orders WHERE o_orderkey % 5 > 0)))""")
def flat_part_names(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "unnamed solid").otherwise(F.translate("o_orderpriority", "/", "-"))
    solids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), k.alias("ord"), raw.alias("name"), (k % 5).alias("n_solids"))
    return readers.flat_parts(solids).select("file", "name")


@query("SELECT 'd' || doc_id || '.step' AS path, 'd' || doc_id AS name, 1e0 AS volume, 6e0 AS area FROM documents")
def fallback_parts(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".step")).alias("path"))
    return readers.fallback_part(files).select("path", "name", "volume", "area")


@query("SELECT o_custkey AS file, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS bundle FROM orders GROUP BY o_custkey")
def sibling_bundles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("bundle"), F.struct("o_totalprice", "o_orderkey").alias("rank"))
    return readers.sibling_bundle(o)


@query(f"""WITH {ASSEMBLY}, r AS (SELECT *, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS prim FROM a) SELECT kind, subject, count(*) AS n FROM (SELECT CASE size % 3 WHEN 0 THEN 'screwedInto' WHEN 1 THEN 'containedIn' ELSE 'relatedTo' END AS kind, part_id AS subject FROM a WHERE parent_id IS NOT NULL) GROUP BY 1, 2""")
def scene_arc_names(spark, sf_dir):
    a = _assembly(spark, sf_dir)
    prims = a.select("part_id", F.col("part_id").alias("path"))
    kind = F.when(F.col("size") % 3 == 0, "fastener").when(F.col("size") % 3 == 1, "contained_in").otherwise("odd")
    edges = a.where("parent_id is not null").select(kind.alias("kind"), F.col("part_id").alias("subject_id"), F.col("parent_id").alias("target_id"))
    return sinks.scene_arcs(prims, edges).groupBy(F.col("arc").alias("kind"), "subject").agg(F.count("*").alias("n"))


@query(f"""{ctes('fx_parts').replace('WITH', 'WITH RECURSIVE', 1)}, n AS (SELECT part_id, CASE WHEN part_id > 20 THEN part_id // 3 END AS up, name, CASE WHEN regexp_matches(q, '^[A-Za-z_]') THEN q ELSE 'p_' || q END AS prim FROM (SELECT *, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS q FROM fx_parts)),
u AS (SELECT part_id, up, CASE WHEN rn > 0 THEN prim || '_' || rn ELSE prim END AS prim FROM (SELECT *, row_number() OVER (PARTITION BY prim ORDER BY part_id) - 1 AS rn FROM n)),
w AS (SELECT part_id, '/' || prim AS path FROM u WHERE up IS NULL OR up NOT IN (SELECT part_id FROM u) UNION ALL SELECT u.part_id, w.path || '/' || u.prim FROM w JOIN u ON u.up = w.part_id) SELECT part_id, path FROM w""")
def scene_prim_paths(spark, sf_dir):
    k = F.col("part_id")
    return sinks.scene_prims(view(spark, sf_dir, "fx_parts").select("part_id", "ord", "name", F.when(k > 20, F.floor(k / 3)).alias("parent_id")))


@query("""WITH f AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(coalesce(text, '')) AS h FROM documents), k AS (SELECT h, min(path) AS canonical FROM f GROUP BY h) SELECT path AS removed, canonical FROM f JOIN k ON k.h = f.h WHERE path <> canonical""")
def texture_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return ql.duplicate_textures(d)


HEADS = ("89504E470D0A", "FFD8FFE0", "424D36", "47494638", "44445320", "762F3101", "233F52", "00000010", "ABCDEF", "")


@query(f"SELECT s_suppkey, ['png', 'jpg', 'bmp', 'gif', 'dds', 'exr', 'hdr', 'tga', NULL, NULL][s_suppkey % {len(HEADS)} + 1] AS format FROM supplier")
def texture_formats(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("s_suppkey") % len(HEADS) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", ql.texture_format(F.unhex(head)).alias("format"))


@query("SELECT page_id, regexp_matches(lower(ltrim(substr(html, 1, 512), ' ')), '^(<!doctype html|<html)') AS html FROM pages")
def html_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ql.looks_like_html(F.col("html")).alias("html"))


@query(f"{ctes('fx_parts')}, m AS (SELECT part_id, name, kind, row_number() OVER (PARTITION BY kind ORDER BY ord) AS i FROM fx_parts), s AS (SELECT s_suppkey, s_name, s_nationkey % 6 AS kind, row_number() OVER (PARTITION BY s_nationkey % 6 ORDER BY s_suppkey) AS i FROM supplier) SELECT m.part_id, s.s_suppkey AS mesh FROM m LEFT JOIN s ON s.kind = m.kind AND s.i = m.i")
def meshes_in_order(spark, sf_dir):
    parts = view(spark, sf_dir, "fx_parts").select("part_id", "ord", F.col("kind").alias("manifest_id"))
    meshes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mesh"), F.col("s_suppkey").alias("ord"), (F.col("s_nationkey") % 6).cast("int").alias("manifest_id"))
    return sm.meshes_by_position(parts, meshes).select("part_id", "mesh")


@query("SELECT a.p_partkey, b.m AS mesh FROM part a LEFT JOIN (SELECT p_name, min(p_partkey) AS m FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) b ON b.p_name = a.p_name")
def meshes_named(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    meshes = p.where("p_partkey % 2 = 0").groupBy("name").agg(F.min("p_partkey").alias("mesh"))
    return sm.meshes_by_name(p, meshes).select("p_partkey", "mesh")


@query("SELECT s_suppkey, substr(md5('id:' || s_suppkey), 1, 8) || '-' || substr(md5('id:' || s_suppkey), 9, 4) || '-' || substr(md5('id:' || s_suppkey), 13, 4) || '-' || substr(md5('id:' || s_suppkey), 17, 4) || '-' || substr(md5('id:' || s_suppkey), 21, 12) AS id, '2026-01-01T00:00:0' || (s_suppkey % 10) || 'Z' AS stamp FROM supplier")
def stable_ids(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("s_suppkey") % 10)
    return s.select("s_suppkey", tx.stable_uuid(F.concat(F.lit("id:"), F.col("s_suppkey").cast("string"))).alias("id"), tx.iso_time(at).alias("stamp"))
