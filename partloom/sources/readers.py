"""Reading documents and files into part tables."""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import geometry as g
from partloom.operators.features import shape_key
from partloom.sources.schemas import MANIFEST


def manifest_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """docs (manifest_id and the columns of MANIFEST) -> tables meta, parts, relationships, pmi."""
    each = lambda name: docs.select("manifest_id", F.posexplode(name).alias("ord", "x")).select("manifest_id", "ord", "x.*")
    return {"meta": docs.select("manifest_id", "meta.*"), "parts": each("parts"), "relationships": each("relationships"), "pmi": each("global_pmi")}


def read_manifests(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Manifest JSON files -> tables meta, parts, relationships, pmi, keyed by manifest_id (the file); unknown keys are ignored."""
    return manifest_tables(spark.read.schema(MANIFEST).json(path, multiLine=True).withColumn("manifest_id", F.input_file_name()))


def _zip_members(batches):
    import io
    import zipfile

    import pandas as pd

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                rows += [(path, i, m.filename, m.file_size, archive.read(m)) for i, m in enumerate(archive.infolist()) if not m.is_dir()]
        yield pd.DataFrame(rows, columns=["path", "pos", "member", "size", "content"])


def zip_members(files: DataFrame) -> DataFrame:
    """files (path, content) of zip archives -> their members, in order, with their contents."""
    return files.select("path", "content").mapInPandas(_zip_members, "path string, pos int, member string, size long, content binary")


def bundle_manifests(members: DataFrame) -> dict[str, DataFrame]:
    """members (path, member, content) -> the manifest tables of bundles, keyed by the bundle's path."""
    own = members.where("member = 'manifest.json'").select(F.col("path").alias("manifest_id"), F.from_json(F.decode("content", "UTF-8"), MANIFEST).alias("m"))
    return manifest_tables(own.select("manifest_id", "m.*"))


def open_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The manifest tables of a bundle, a folder or a zip file (or a pattern of zip files). Zip members are read in place."""
    if path.rstrip("/").endswith(".zip"):
        return bundle_manifests(zip_members(_files(spark, path)))
    return read_manifests(spark, f"{path.rstrip('/')}/manifest.json")


def read_unreal_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Bundle JSON (cm, left-handed) -> bundle, ord, part_id, name, translation in canonical mm, rotation, scale, mesh_ref,
    material (the first, or a grey default), source_type, tags. Bundles know no parents."""
    material = "struct<name:string,base_color:array<double>,metallic:double,roughness:double>"
    part = f"uuid:string,name:string,transform:struct<translation:array<double>,rotation:array<double>,scale:array<double>>,mesh_ref:string,materials:array<{material}>,source_provenance:map<string,string>,tags:array<string>"
    docs = spark.read.schema(f"parts array<struct<{part}>>").json(path, multiLine=True)
    p = docs.select(F.input_file_name().alias("bundle"), F.posexplode("parts").alias("ord", "p")).select("bundle", "ord", "p.*")
    at = lambda i, k: F.coalesce(F.get("transform.translation", i), F.lit(0.0)) * k
    first, name = F.get("materials", 0), F.coalesce("name", F.lit("Unknown"))
    grey = F.array(*map(F.lit, GREY))
    return p.select(
        "bundle", "ord", F.col("uuid").alias("part_id"), name.alias("name"), F.array(at(0, 10.0), at(1, -10.0), at(2, 10.0)).alias("translation"),
        F.coalesce("transform.rotation", F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))).alias("rotation_quat"), F.coalesce("transform.scale", F.array(*[F.lit(1.0)] * 3)).alias("scale"), "mesh_ref",
        F.struct(F.coalesce(first["name"], F.concat(F.lit("mat_"), name)).alias("name"), F.coalesce(first["base_color"], grey).alias("base_color"), F.coalesce(first["metallic"], F.lit(0.0)).alias("metallic"), F.coalesce(first["roughness"], F.lit(0.5)).alias("roughness")).alias("material"),
        F.when(F.coalesce(F.try_element_at("source_provenance", F.lit("Datasmith_SourceCADPath")), F.lit("")) != "", "original_step").otherwise("unreal_native").alias("source_type"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


# The colour of parts without a material.
GREY = (0.7, 0.7, 0.7, 1.0)


def read_datasmith_materials(spark: SparkSession, path: str) -> DataFrame:
    """Materials defined in scene XML (elements with properties): name, base_color, metallic, roughness; a later one wins."""
    schema = "_Name string, Property array<struct<_Name:string,_Value:string>>"
    out = None
    for source_ord, tag in enumerate(("Material", "MasterMaterial")):
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("ord", F.struct(F.lit(source_ord), F.monotonically_increasing_id()))
        out = rows if out is None else out.unionByName(rows)
    out = out.where("Property is not null").groupBy(F.col("_Name").alias("name")).agg(F.max_by("Property", "ord").alias("p"))
    value = lambda k: F.get(F.filter("p", lambda x: x["_Name"] == k), 0)["_Value"]
    color = F.transform(F.split(F.regexp_replace(value("BaseColor"), "[()]", ""), ","), lambda x: x.try_cast("double"))
    rgba = F.when(F.size(color) >= 3, F.array_append(F.slice(color, 1, 3), F.lit(1.0))).otherwise(F.array(*map(F.lit, GREY)))
    number = lambda k, default: F.coalesce(value(k).try_cast("double"), F.lit(default))
    return out.select("name", F.coalesce(rgba, F.array(*map(F.lit, GREY))).alias("base_color"), number("Metallic", 0.0).alias("metallic"), number("Roughness", 0.5).alias("roughness"))


def read_datasmith(spark: SparkSession, path: str) -> DataFrame:
    """Actors of scene XML, ``Actor`` rows before ``StaticMeshActor`` rows: names, mesh, materials, tags, metadata, provenance, place.

    part_id is the id that an earlier export left in the metadata, else the name.
    """
    transform = "Transform struct<_tx:double,_ty:double,_tz:double,_qx:double,_qy:double,_qz:double,_qw:double,_sx:double,_sy:double,_sz:double>"
    schema = f"_Name string, _Label string, _Layer string, _Folder string, _Mesh string, Material array<struct<_Name:string>>, Tag array<struct<_Value:string>>, MetaData array<struct<_Key:string,_Value:string>>, {transform}"
    out = None
    for source_ord, tag in enumerate(("Actor", "StaticMeshActor")):
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("source_ord", F.lit(source_ord)).withColumn("element", F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    t = F.col("Transform")
    pairs = F.coalesce("MetaData", F.array().cast("array<struct<_Key:string,_Value:string>>"))
    meta = F.map_from_entries(F.transform(F.filter(pairs, lambda m: m["_Key"].isNotNull()), lambda m: F.struct(m["_Key"], m["_Value"])))
    out = out.withColumn("metadata", meta)
    known = F.get(F.map_values(F.map_filter("metadata", lambda k, v: F.endswith(k, F.lit("_uuid")))), 0)
    source = lambda k: F.try_element_at("metadata", F.lit(k))
    whole = lambda k, default: F.coalesce(t[k], F.lit(default))
    return out.select(
        "source_ord", "element", F.coalesce(known, "_Name").alias("part_id"), F.coalesce("_Label", "_Name").alias("name"), F.col("_Mesh").alias("mesh"), F.col("_Layer").alias("layer"), F.col("_Folder").alias("folder"),
        F.transform("Material", lambda m: m["_Name"]).alias("materials"), F.transform("Tag", lambda x: x["_Value"]).alias("tags"), "metadata",
        F.when(source("Datasmith_SourceCADPath").isNotNull(), "original_step").otherwise("unreal_native").alias("source_type"), source("Datasmith_SourceCADPath").alias("source_path"), source("Datasmith_SourceHash").alias("source_hash"),
        F.array(whole("_tx", 0.0) * 10.0, whole("_ty", 0.0) * -10.0, whole("_tz", 0.0) * 10.0).alias("translation"), F.array(*[whole(f"_q{k}", float(k == "w")) for k in "xyzw"]).alias("rotation_quat"), F.array(*[whole(f"_s{k}", 1.0) for k in "xyz"]).alias("scale"),
    )


COMPONENTS = {5120: ("b", 1), 5121: ("B", 1), 5122: ("h", 2), 5123: ("H", 2), 5125: ("I", 4), 5126: ("f", 4)}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}


class Listed(Sequence):
    """A list within a JSON text: only where its elements begin is kept, and each is decoded when it is asked for."""

    def __init__(self, text: str, starts: array, decode):
        self.text, self.starts, self.decode = text, starts, decode

    def __len__(self):
        return len(self.starts)

    def __getitem__(self, i):
        return [self[k] for k in range(len(self))[i]] if isinstance(i, slice) else self.decode(self.text, self.starts[i])[0]


_SPACE = re.compile(r"[ \t\n\r]*")


def decoded_document(content) -> dict:
    """json.loads, but for the lists of a document's own members, which are ``Listed``: a large one takes its text and little more."""
    text = str(content, json.detect_encoding(bytes(content[:4])), "surrogatepass")
    decode = json.JSONDecoder().raw_decode
    space = lambda at: _SPACE.match(text, at).end()

    def sign(at: int, *wanted: str) -> tuple[str, int]:
        at = space(at)
        if text[at : at + 1] not in wanted:
            raise json.JSONDecodeError(f"Expecting one of {wanted}", text, at)
        return text[at], space(at + 1)

    at = space(0)
    if text[at : at + 1] != "{":
        return json.loads(text)
    out, at = {}, space(at + 1)
    more = text[at : at + 1] != "}"
    at += not more
    while more:
        sign(at, '"')
        key, at = decode(text, at)
        at = sign(at, ":")[1]
        if text[at : at + 1] == "[":
            starts, at = array("q"), space(at + 1)
            inside = text[at : at + 1] != "]"
            at += not inside
            while inside:
                starts.append(at)
                found, at = sign(decode(text, at)[1], ",", "]")
                inside = found == ","
            out[key] = Listed(text, starts, decode)
        else:
            out[key], at = decode(text, at)
        found, at = sign(at, ",", "}")
        more = found == ","
    if space(at) != len(text):
        raise json.JSONDecodeError("Extra data", text, at)
    return out


def split_glb(content) -> tuple[dict, bytes]:
    """The JSON document and binary chunk of a GLB file (bytes, or a view of them), or of a plain glTF file without one."""
    if content[:4] != b"glTF":
        return decoded_document(content), b""
    at, doc, blob = 12, {}, b""
    while at + 8 <= len(content):
        size, kind = struct.unpack_from("<II", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == 0x4E4F534A:
            doc = decoded_document(body)
        elif kind == 0x004E4942:
            blob = body
        at += 8 + size + (-size) % 4
    return doc, blob


def accessor(doc: dict, blob: bytes, index: int):
    """An accessor's values as an array of rows; tightly packed data only."""
    import numpy as np

    a = doc["accessors"][index]
    view = doc["bufferViews"][a["bufferView"]]
    code, _ = COMPONENTS[a["componentType"]]
    width = WIDTHS[a["type"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    return np.frombuffer(blob, dtype="<" + code, count=a["count"] * width, offset=start).reshape(a["count"], width)


def _contents(batches):
    """Batches (path, content) -> each path with a view of its content, which is not copied."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py(), memoryview(content.as_buffer())


#: Nodes that are handed on at once.
NODES = 1 << 14
_PLACE = "translation array<double>, rotation array<double>, scale array<double>, matrix array<double>"


def _position(doc: dict, mesh: int | None) -> dict:
    """The accessor of the positions of a mesh's first primitive."""
    primitives = doc["meshes"][mesh].get("primitives", []) if mesh is not None else []
    at = primitives[0].get("attributes", {}).get("POSITION") if primitives else None
    return {} if at is None else doc["accessors"][at]


def _gltf_nodes(bounds: bool):
    def run(batches):
        import pyarrow as pa

        many = pa.list_(pa.float64())
        fields = pa.schema([("path", pa.string()), ("node", pa.int32()), ("name", pa.string()), ("part_id", pa.string()), ("parent", pa.int32()), ("mesh", pa.int32()), *((k, many) for k in ("translation", "rotation", "scale", "matrix", *(("low", "high") if bounds else ())))])
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)
        for path, content in _contents(batches):
            doc, _ = split_glb(content)
            nodes, rows = doc.get("nodes", []), []
            parent = {c: i for i, n in enumerate(nodes) for c in n.get("children", [])}
            for i, n in enumerate(nodes):
                extras = n.get("extras") or {}
                part = extras.get("part_uuid") or next((v for k, v in extras.items() if k.endswith("_uuid")), None)
                box = (lambda a: (a.get("min"), a.get("max")))(_position(doc, n.get("mesh"))) if bounds else ()
                rows.append((path, i, n.get("name"), part, parent.get(i), n.get("mesh"), n.get("translation"), n.get("rotation"), n.get("scale"), n.get("matrix"), *box))
                if len(rows) == NODES:
                    yield table(rows)
                    rows = []
            yield table(rows)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def gltf_nodes_of(files: DataFrame, bounds: bool = False) -> DataFrame:
    """files (path, content) -> nodes of glTF/GLB documents with their parents (children inverted) and ids from extras.

    bounds: with the least and greatest values (low, high) that the document states for the positions of the node's mesh.
    """
    schema = f"path string, node int, name string, part_id string, parent int, mesh int, {_PLACE}" + (", low array<double>, high array<double>" if bounds else "")
    return files.select("path", "content").mapInArrow(_gltf_nodes(bounds), schema)


def read_gltf_nodes(spark: SparkSession, path: str) -> DataFrame:
    return gltf_nodes_of(_files(spark, path))


def _gltf_materials(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            doc, _ = split_glb(bytes(content))
            for i, node in enumerate(doc.get("nodes", [])):
                name, extras = node.get("name") or f"Node_{i}", node.get("extras") or {}
                primitives = doc["meshes"][node["mesh"]].get("primitives", []) if node.get("mesh") is not None else []
                at, made = primitives[0].get("material") if primitives else None, doc.get("materials", [])
                m = made[at] if at is not None and at < len(made) else {"name": f"mat_{name}"}
                pbr = m.get("pbrMetallicRoughness", {})
                color = (list(map(float, pbr.get("baseColorFactor", GREY))) + [1.0])[:4]
                rows.append((path, i, name, m.get("name") or f"material_{at}", color, float(pbr.get("metallicFactor", 0.0)), float(pbr.get("roughnessFactor", 0.5)), m.get("alphaMode", "OPAQUE").lower(), bool(m.get("doubleSided", False)), extras.get("source_type", "unreal_native")))
        yield pd.DataFrame(rows, columns=["path", "node", "name", "material", "base_color", "metallic", "roughness", "alpha_mode", "double_sided", "source_type"])


def gltf_materials_of(files: DataFrame) -> DataFrame:
    """files (path, content) -> the material of each node: that of its mesh's first primitive, else a grey one."""
    schema = "path string, node int, name string, material string, base_color array<double>, metallic double, roughness double, alpha_mode string, double_sided boolean, source_type string"
    return files.select("path", "content").mapInPandas(_gltf_materials, schema)


#: Triangles that are handed on at once.
TRIANGLES = 1 << 16


def _gltf_triangles(batches):
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    names = [f"{n}{a}" for n in "abc" for a in "xyz"]
    fields = pa.schema([("path", pa.string()), ("mesh", pa.int32()), *((n, pa.int64()) for n in "abc"), *((n, pa.float64()) for n in names), ("n_vertices", pa.int64())])

    def frame(held):
        path, mesh, idx, corners, sizes, lengths = ([x[k] for x in held] for k in range(6))
        each = lambda values, kind: np.repeat(np.array(values, dtype=kind), lengths)
        idx, corners = np.concatenate(idx), np.concatenate(corners)
        columns = {"path": each(path, object), "mesh": each(mesh, np.int32), **{n: idx[:, k] for k, n in enumerate("abc")}, **{n: corners[:, k] for k, n in enumerate(names)}}
        return pa.RecordBatch.from_pandas(pd.DataFrame(columns | {"n_vertices": each(sizes, np.int64)}), schema=fields, preserve_index=False)

    held, n = [], 0
    for path, content in _contents(batches):
        doc, blob = split_glb(content)
        for m, mesh in enumerate(doc.get("meshes", [])):
            base = 0
            for p in mesh.get("primitives", []):
                if p.get("mode", 4) != 4 or "POSITION" not in p.get("attributes", {}):
                    continue
                xyz = accessor(doc, blob, p["attributes"]["POSITION"])
                idx = accessor(doc, blob, p["indices"]).reshape(-1, 3) if "indices" in p else np.arange(len(xyz) // 3 * 3).reshape(-1, 3)
                idx = idx.astype(np.int64)
                held.append((path, m, idx + base, xyz[idx].astype(float).reshape(-1, 9), base + len(xyz), len(idx)))
                base, n = base + len(xyz), n + len(idx)
                if n >= TRIANGLES:
                    yield frame(held)
                    held, n = [], 0
    if held:
        yield frame(held)


def gltf_triangles_of(files: DataFrame) -> DataFrame:
    """files (path, content) -> triangles of all TRIANGLES primitives with their corners.

    Vertex numbers run on over a mesh's primitives; n_vertices is their number so far.
    """
    corners = ", ".join(f"{n}{a} double" for n in "abc" for a in "xyz")
    return files.select("path", "content").mapInArrow(_gltf_triangles, f"path string, mesh int, a long, b long, c long, {corners}, n_vertices long")


def read_gltf_triangles(spark: SparkSession, path: str) -> DataFrame:
    return gltf_triangles_of(_files(spark, path))


def mesh_fingerprints(triangles: DataFrame) -> DataFrame:
    """Triangles of glTF meshes -> path, mesh, box, volume and area in canonical mm, counts and topology key."""
    t = triangles
    for k in "abc":
        for axis, value in zip("xyz", g.gltf_to_canonical(g.triple(k)), strict=True):
            t = t.withColumn(f"_{k}{axis}", value)
    a, b, c = (g.triple(f"_{k}") for k in "abc")
    normal = g.cross(g.minus(b, a), g.minus(c, a))
    t = t.withColumn("_area", g.norm(normal) / 2).withColumn("_six", g.dot(a, normal))
    box = [f(F.greatest(*[F.col(f"_{k}{x}") for k in "abc"]) if n == "max" else F.least(*[F.col(f"_{k}{x}") for k in "abc"])).alias(f"{n}_{x}") for n, f in (("min", F.min), ("max", F.max)) for x in "xyz"]
    out = t.groupBy("path", "mesh").agg(*box, F.abs(F.sum("_six") / 6).alias("volume"), F.sum("_area").alias("area"), F.max("n_vertices").alias("n_vertices"), F.count("*").alias("n_faces"), F.collect_list("_area").alias("_areas"))
    key = shape_key("mesh", F.col("n_faces").cast("string"), F.lit(0), F.col("n_vertices").cast("string"), F.col("_areas"), F.array().cast("array<double>"))
    return out.withColumn("topology_hash", key).drop("_areas")


MOST_VERTICES, MOST_INDICES = 10_000_000, 30_000_000


def udsmesh_header(content: bytes) -> tuple[int, int, int]:
    """(offset, vertices, indices) of a mesh file with an 8-byte or a 16-byte header, whichever gives sane counts."""
    for offset, at in ((8, 0), (16, 8)):
        if len(content) >= offset:
            v, i = struct.unpack_from("<II", content, at)
            if 0 < v <= MOST_VERTICES and 0 < i <= MOST_INDICES and offset + 12 * v + 4 * i <= len(content):
                return offset, v, i
    return 0, 0, 0


def _udsmesh(batches):
    import numpy as np
    import pandas as pd

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            content = bytes(content)
            at, v, i = udsmesh_header(content)
            xyz = np.frombuffer(content, "<f4", 3 * v, at).tolist() if v else []
            idx = np.frombuffer(content, "<u4", i, at + 12 * v).tolist() if v else []
            rows.append((path, v, i // 3, xyz, idx))
        yield pd.DataFrame(rows, columns=["path", "n_vertices", "n_faces", "xyz", "indices"])


MESH = "path string, n_vertices int, n_faces int, xyz array<float>, indices array<long>"


def udsmesh_of(files: DataFrame) -> DataFrame:
    """files (path, content) of binary meshes; those without a sane header give empty meshes."""
    return files.select("path", "content").mapInPandas(_udsmesh, MESH)


def read_udsmesh(spark: SparkSession, path: str) -> DataFrame:
    return udsmesh_of(_files(spark, path))


def _bundle_meshes(batches):
    import numpy as np
    import pandas as pd

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            content = bytes(content)
            v, i = struct.unpack_from("<II", content, 8) if len(content) >= 16 else (0, 0)
            ok = 0 < v <= MOST_VERTICES and i % 3 == 0 and 16 + 12 * v + 4 * i <= len(content)
            v, i = (v, i) if ok else (0, 0)
            xyz = np.frombuffer(content, "<f4", 3 * v, 16).reshape(-1, 3) * np.array([10, -10, 10], "<f4") if v else np.zeros((0, 3))
            rows.append((path, v, i // 3, xyz.ravel().tolist(), np.frombuffer(content, "<u4", i, 16 + 12 * v).tolist() if i else []))
        yield pd.DataFrame(rows, columns=["path", "n_vertices", "n_faces", "xyz", "indices"])


def bundle_meshes_of(files: DataFrame) -> DataFrame:
    """files (path, content) of a bundle's mesh files (mark, version, two counts, vertices, indices) in canonical mm."""
    return files.select("path", "content").mapInPandas(_bundle_meshes, MESH)


def read_url_manifest(spark: SparkSession, path: str, csv: bool = False, keep_marked: bool = False) -> DataFrame:
    """URLs of a text file (first comma field of each line) or of a CSV file's url column, whatever its case.

    Blank rows go, and rows that start with # unless ``keep_marked``.
    """
    if csv:
        table = spark.read.csv(path, header=True)
        column = next((c for c in table.columns if c.strip().lower() == "url"), None)
        if column is None:
            raise ValueError(f"{path} has no url column: {table.columns}")
        urls = table.select(F.trim(column).alias("url"))
    else:
        urls = spark.read.text(path).select(F.trim(F.split("value", ",")[0]).alias("url"))
    marked = F.startswith("url", F.lit("#"))
    return urls.where(F.col("url").isNotNull() & (F.col("url") != "") & (F.lit(keep_marked) | ~marked))


def product_names(spark: SparkSession, path: str) -> DataFrame:
    return product_names_of(_files(spark, path))


def product_names_of(files: DataFrame) -> DataFrame:
    """files (path, content): the first PRODUCT name in the first 2 MiB of each exchange file, else its stem."""
    head = F.decode(F.substring("content", 1, 2097152), "ISO-8859-1")
    found = F.regexp_extract(head, "(?i)PRODUCT\\s*\\(\\s*'([^']+)'", 1)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), "\\.[^.]*$", "")
    return files.select("path", F.when(found != "", found).otherwise(stem).alias("name"))


def scan_samples(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under root/split/class/name -> split, class, name, path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split("path", "/")
    at = lambda k: F.element_at(parts, F.lit(-k))
    return files.select(at(3).alias("split"), at(2).alias("class"), F.regexp_replace(at(1), "\\.[^.]*$", "").alias("name"), "path", "length")


# What exporters write where a product has no name of its own.
DEFAULT_NAMES = ("open cascade step translator", "opencascade step translator", "step translator", "translator-")
MORE_DEFAULTS = "open cascade|unnamed|^solid\\d*$|^shape\\d*$"


def flat_parts(solids: DataFrame) -> DataFrame:
    """solids (file, ord, name, n_solids, ...) -> named parts: entities without solids go, default names become Part_nnn, repeats get _1, _2.

    A name is a default if it is null or blank or holds one of a few fragments that exporters write. nnn is the part's
    place in its file, from 1. A file or a name of any number of parts is ranked in pieces.
    """
    from partloom.operators.plumbing import unique_names
    from partloom.operators.prefix import ranked

    placed = ranked(solids.where("n_solids >= 1"), ["file"], ["ord"], "_place")
    low = F.lower(F.trim("name"))
    default = F.col("name").isNull() | (low == "") | low.rlike(MORE_DEFAULTS) | reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in DEFAULT_NAMES])
    named = placed.withColumn("name", F.when(default, F.format_string("Part_%03d", F.col("_place") + 1)).otherwise(F.col("name"))).drop("_place")
    return unique_names(named, "name", "ord", within=("file",)).withColumn("name", F.col("unique_name")).drop("unique_name")


def fallback_part(files: DataFrame) -> DataFrame:
    """One unit-cube part for each file that can't be read."""
    return files.select("path", F.regexp_replace(F.substring_index("path", "/", -1), "\\.[^.]*$", "").alias("name"), F.array(*[F.lit(0.0)] * 3).alias("bbox_min"), F.array(*[F.lit(1.0)] * 3).alias("bbox_max"), F.lit(1.0).alias("volume"), F.lit(6.0).alias("area"), F.lit("fallback").alias("topology_hash"))


def split_file(spark: SparkSession, path: str, val: float = 0.1, seed: str = "seed") -> DataFrame:
    """{"train": [...], "test": [...]}: the test list as given, val carved from train by hash."""
    from partloom.functions.text import hash_fraction

    d = spark.read.schema("train array<string>, test array<string>").json(path, multiLine=True)
    test = d.select(F.explode("test").alias("sample_id"), F.lit("test").alias("split"))
    train = d.select(F.explode("train").alias("sample_id"))
    carved = hash_fraction(F.concat(F.lit(seed + ":"), "sample_id")) < val
    return test.union(train.select("sample_id", F.when(carved, "val").otherwise("train")))


def sibling_bundle(candidates: DataFrame) -> DataFrame:
    """candidates (file, bundle, rank): the first existing sibling bundle of each file."""
    return candidates.groupBy("file").agg(F.min_by("bundle", "rank").alias("bundle"))
