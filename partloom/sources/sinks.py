"""Writing part tables as documents, scenes, exchange text and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.text import prim_name
from partloom.operators.plumbing import assembly_paths, unique_names


def manifest_json(meta: DataFrame, parts: DataFrame, relationships: DataFrame) -> DataFrame:
    """One JSON document per manifest_id. A document is one row, as its readers need it whole."""
    fold = lambda df, name: df.groupBy("manifest_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in df.columns if c not in ("manifest_id", "ord")]).alias("x")))), lambda r: r["x"]).alias(name))
    j = meta.join(fold(parts, "parts"), "manifest_id", "left").join(fold(relationships, "relationships"), "manifest_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array())
    head = F.struct(*[c for c in meta.columns if c != "manifest_id"]).alias("meta")
    return j.select("manifest_id", F.to_json(F.struct(head, empty("parts").alias("parts"), empty("relationships").alias("relationships"))).alias("value"))


def null_free_json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "true"})


def next_version(history: DataFrame) -> DataFrame:
    """The next snapshot label, v0001 for an empty history (version int)."""
    n = F.coalesce(F.max("version"), F.lit(0)) + 1
    return history.agg(F.concat(F.lit("v"), F.lpad(n.cast("string"), 4, "0")).alias("label"), n.alias("version"))


def write_snapshot(parts: DataFrame, root: str, version: int) -> None:
    """A version of the part table as a partition of the history; a rerun replaces it."""
    parts.write.mode("overwrite").parquet(f"{root}/version={version:04d}")


def _zipped(pdf):
    import io
    import zipfile

    import pandas as pd

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for member, content in sorted(zip(pdf["member"], pdf["content"], strict=True)):
            archive.writestr(zipfile.ZipInfo(member), bytes(content))
    return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})


def zip_bundles(members: DataFrame) -> DataFrame:
    """members (path, member, content) -> path, content: one zip archive for each bundle."""
    return members.select("path", "member", "content").groupBy("path").applyInPandas(_zipped, "path string, content binary")


def history_line(at: Column, message: Column) -> Column:
    """A line of a bundle's history log."""
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("] "), message)


def write_history(parts: DataFrame, root: str, message: str, at: Column) -> int:
    """A snapshot of the part table as the next version of a bundle, and a line in its log; the new version."""
    spark = parts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    log = "version int, line string"
    history = spark.read.schema(log).parquet(f"{root}/log") if known else spark.createDataFrame([], log)
    version = next_version(history).first()["version"]
    write_snapshot(parts, f"{root}/parts", version)
    spark.range(1).select(F.lit(version).alias("version"), history_line(at, F.lit(message)).alias("line")).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return version


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _per_document(parts: DataFrame) -> tuple[list[str], object]:
    """The columns that tell documents apart, and the window of a document's parts in order."""
    keys = ["manifest_id"] if "manifest_id" in parts.columns else []
    return keys, Window.partitionBy(*(keys or [F.lit(0)])).orderBy("ord")


def exchange_text(parts: DataFrame) -> DataFrame:
    """A minimal STEP text for each manifest_id: header, two entities per part with odd and even numbers, and the end marks."""
    keys, w = _per_document(parts)
    n = F.row_number().over(w)
    name = F.replace(F.col("name"), F.lit("'"), F.lit("''"))
    body = parts.select(*keys, (2 * n).alias("pos"), F.format_string("#%d = PRODUCT('%s','%s','',());\n#%d = PRODUCT_DEFINITION_FORMATION('','',#%d);", 2 * n - 1, name, name, 2 * n, 2 * n - 1).alias("line"))
    spark = parts.sparkSession
    head = (0, "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_SCHEMA(('AUTOMOTIVE_DESIGN'));\nENDSEC;\nDATA;")
    ends = spark.createDataFrame([head, (2**31 - 1, "ENDSEC;\nEND-ISO-10303-21;")], "pos int, line string")
    if keys:
        ends = parts.select(*keys).distinct().crossJoin(F.broadcast(ends))
    return ends.union(body)


def gltf_nodes(parts: DataFrame) -> DataFrame:
    """Node rows, numbered within each manifest_id, with their children; a part whose parent is missing is a root."""
    keys, w = _per_document(parts)
    numbered = parts.withColumn("node", F.row_number().over(w) - 1)
    up = numbered.select(*keys, F.col("part_id").alias("parent_id"), F.col("node").alias("parent_node"))
    linked = numbered.join(up, [*keys, "parent_id"], "left")
    children = linked.where("parent_node is not null").groupBy(*keys, F.col("parent_node").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("children"))
    return linked.join(children, [*keys, "node"], "left").withColumn("root", F.col("parent_node").isNull())


def gltf_document(parts: DataFrame) -> DataFrame:
    """parts (manifest_id, ord, part_id, parent_id, name, material struct, source_type) -> manifest_id, value: a glTF JSON document.

    A default material comes first, then one for each part. Extras carry the part's id and source. A document is one
    row, as its readers need it whole.
    """
    rows = gltf_nodes(parts)
    extras = F.struct(F.col("part_id").alias("part_uuid"), "source_type")
    node = F.struct("node", F.struct("name", "children", extras.alias("extras")).alias("x"))
    pbr = lambda color, metallic, rough: F.struct(color.alias("baseColorFactor"), metallic.alias("metallicFactor"), rough.alias("roughnessFactor"))
    m = F.col("material")
    material = F.struct("node", F.struct(m["name"].alias("name"), pbr(m["base_color"], m["metallic"], m["roughness"]).alias("pbrMetallicRoughness")).alias("x"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda r: r["x"])
    folded = rows.groupBy("manifest_id").agg(listed(node).alias("nodes"), listed(material).alias("own"), F.array_sort(F.collect_list(F.when(F.col("root"), F.col("node")))).alias("roots"))
    default = F.struct(F.lit("default").alias("name"), pbr(F.array(*map(F.lit, (0.7, 0.7, 0.7, 1.0))), F.lit(0.0), F.lit(0.5)).alias("pbrMetallicRoughness"))
    doc = F.struct(
        F.struct(F.lit("2.0").alias("version")).alias("asset"), F.lit(0).alias("scene"), F.array(F.struct(F.col("roots").alias("nodes"))).alias("scenes"), "nodes",
        F.concat(F.array(default), "own").alias("materials"),
    )
    return folded.select("manifest_id", F.to_json(doc).alias("value"))


def first_materials(parts: DataFrame) -> DataFrame:
    """Materials without repeats; the first definition of a name stays."""
    return parts.where("material is not null").groupBy(F.col("material.name").alias("name")).agg(F.min_by("material", "ord").alias("material"))


def datasmith_rows(parts: DataFrame) -> DataFrame:
    """Rows for the XML sink (rowTag StaticMeshActor): translations in cm with Y mirrored; a material's name and the id go along."""
    at = lambda i, k: F.get("translation", i) * k
    place = F.struct(at(0, 0.1).alias("_tx"), at(1, -0.1).alias("_ty"), at(2, 0.1).alias("_tz"))
    under = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    meta = F.array(F.struct(F.lit("part_uuid").alias("_Key"), F.col("part_id").cast("string").alias("_Value")))
    name = F.col("name")
    columns = [under(name).alias("_Name"), name.alias("_Label"), F.concat(F.lit("SM_"), under(name)).alias("_Mesh"), place.alias("Transform"), meta.alias("MetaData")]
    if "material" in parts.columns:
        columns.append(F.array(F.struct(under(F.concat(F.lit("M_"), F.col("material.name"))).alias("_Name"))).alias("Material"))
    return parts.select(*columns)


def datasmith_materials(parts: DataFrame) -> DataFrame:
    """Rows for the XML sink (rowTag Material): one for each name, the first definition stays."""
    m = first_materials(parts).select("material.*")
    four = lambda c: F.format_string("%.4f", c)
    color = F.concat(F.lit("("), F.array_join(F.transform("base_color", four), ","), F.lit(")"))
    pairs = (("BaseColor", color), ("Metallic", four(F.col("metallic"))), ("Roughness", four(F.col("roughness"))))
    return m.select(F.replace(F.concat(F.lit("M_"), "name"), F.lit(" "), F.lit("_")).alias("_Name"), F.col("name").alias("_Label"), F.array(*[F.struct(F.lit(k).alias("_Name"), v.alias("_Value")) for k, v in pairs]).alias("Property"))


def write_datasmith(parts: DataFrame, path: str) -> None:
    """Scene XML under ``path``: actors, and materials in a folder beside them where parts have them."""
    out = lambda rows, tag, to: rows.write.mode("overwrite").format("xml").option("rootTag", "DatasmithUnrealScene").option("rowTag", tag).save(to)
    if "material" in parts.columns:
        out(datasmith_rows(parts), "StaticMeshActor", f"{path}/actors")
        out(datasmith_materials(parts), "Material", f"{path}/materials")
    else:
        out(datasmith_rows(parts), "StaticMeshActor", path)


# Names of relationship arcs in a scene.
ARC_NAMES = {"fastener": "screwedInto", "contained_in": "containedIn", "mate": "matedWith", "contact": "inContactWith", "weld": "weldedTo", "bond": "bondedTo", "custom": "relatedTo"}


def scene_prims(parts: DataFrame) -> DataFrame:
    """part_id and its prim path: sanitised names, unique among equals, joined from the root down."""
    named = unique_names(parts.withColumn("prim", prim_name(F.col("name"))), "prim", "ord")
    paths = assembly_paths(named, "part_id", "parent_id", "unique_name")
    return paths.select(F.col("id").alias("part_id"), F.concat(F.lit("/"), "path").alias("path"))


def scene_arcs(prims: DataFrame, edges: DataFrame) -> DataFrame:
    """Arcs between prims; edges with an unknown end are dropped."""
    names = F.create_map(*[F.lit(x) for kv in ARC_NAMES.items() for x in kv])
    j = edges.join(prims.select(F.col("part_id").alias("subject_id"), F.col("path").alias("subject")), "subject_id").join(prims.select(F.col("part_id").alias("target_id"), F.col("path").alias("target")), "target_id")
    return j.select("subject", F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("relatedTo")).alias("arc"), "target")


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON object per line, nulls left out."""
    return events.select(null_free_json(F.struct(*events.columns)).alias("value"))
