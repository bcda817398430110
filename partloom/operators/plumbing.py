"""Dataset plumbing: keys, splits, leakage, resume, archives, prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.text import family_stem, hash_fraction
from partloom.operators.prefix import ranked
from partloom.tables import written


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def canonical_parts(parts: DataFrame, key: str = "topology_hash", excluded: tuple[str, ...] = ("root", "empty")) -> DataFrame:
    """Adds canonical_id: the first part (by ord) with the same hash; excluded sentinels stand for themselves.

    Aggregate and join rather than a window, so a hash that many parts share isn't gathered.
    """
    own = F.col(key).isNull() | F.col(key).isin(*excluded)
    firsts = parts.where(~own).groupBy(F.col(key).alias("_key")).agg(F.min_by("part_id", "ord").alias("_first"))
    joined = parts.join(firsts, (F.col(key) == F.col("_key")) & ~own, "left")
    return joined.withColumn("canonical_id", F.coalesce("_first", "part_id")).drop("_key", "_first")


def dedup_summary(parts: DataFrame, key: str = "topology_hash", excluded: tuple[str, ...] = ("root", "empty")) -> DataFrame:
    usable = F.col(key).isNotNull() & ~F.col(key).isin(*excluded)
    return parts.agg(F.count("*").alias("n_parts"), F.count_distinct(F.when(usable, F.col(key))).alias("n_unique"))


def spread_labels(canonical: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of canonical parts (part_id) handed to every instance."""
    return canonical.join(labels.withColumnRenamed("part_id", "canonical_id"), "canonical_id", "left")


def resume(todo: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def last_results(log: DataFrame, key: str, order: str) -> DataFrame:
    """An append-only log's latest row per key."""
    return first_by(log, [key], F.col(order).desc())


def complete_samples(artefacts: DataFrame, needed: int = 3) -> DataFrame:
    return artefacts.groupBy("sample_id").agg(F.count_distinct("kind").alias("kinds")).where(F.col("kinds") >= needed).select("sample_id")


def carve_validation(samples: DataFrame, key: Column, ratio: float, seed: str = "seed") -> DataFrame:
    """Train rows whose hash is below the ratio become val."""
    moved = (F.col("split") == "train") & (hash_fraction(F.concat(F.lit(seed + ":"), key)) < ratio)
    return samples.withColumn("split", F.when(moved, "val").otherwise(F.col("split")))


def ratio_split(samples: DataFrame, order: str, group: list[str], ratio: float = 0.8) -> DataFrame:
    """By position in each group's sorted list: the first floor(ratio * n) rows are train. A group of any size is ranked in pieces."""
    sizes = samples.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.count("*").alias("_n"))
    own = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], F.lit(True))
    placed = ranked(samples, group, [order], "_rank").join(sizes, own)
    return placed.select(*samples.columns, F.when(F.col("_rank") < F.floor(F.lit(ratio) * F.col("_n")), "train").otherwise("test").alias("split"))


def class_index(samples: DataFrame, cls: str) -> DataFrame:
    """Index of each class in sorted order, over the small table of distinct classes."""
    names = samples.select(F.col(cls).alias("_cls")).distinct().withColumn("class_idx", (F.row_number().over(Window.orderBy("_cls")) - 1).cast("int"))
    return samples.join(names, F.col(cls) == F.col("_cls")).drop("_cls")


def family_leakage(samples: DataFrame, part_number: Column) -> DataFrame:
    """Test rows whose family also has train rows, with the number of those."""
    f = samples.withColumn("family", family_stem(part_number))
    train = f.where("split = 'train'").groupBy("family").agg(F.count("*").alias("siblings"))
    return f.where("split = 'test'").join(train, "family")


def leakage_by_class(samples: DataFrame, part_number: Column, cls: str) -> DataFrame:
    leaked = family_leakage(samples, part_number).groupBy(cls).agg(F.count("*").alias("leaked"), F.count_distinct("family").alias("families"))
    tests = samples.where("split = 'test'").groupBy(cls).agg(F.count("*").alias("tests"))
    out = tests.join(leaked, cls, "left").na.fill(0, ["leaked", "families"])
    return out.withColumn("rate", F.round(F.col("leaked") / F.col("tests"), 4))


def longest_prefix(samples: DataFrame, index: DataFrame, name: str, key: str, sep: str = "__") -> DataFrame:
    """Each sample with the longest prefix of its name, at a separator, that the index has.

    Prefixes are generated and matched by an equi-join; no string is compared with the whole index.
    """
    parts = F.split(F.col(name), sep)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    cand = samples.withColumn("_prefix", F.explode(prefixes))
    hit = cand.join(index, F.col("_prefix") == F.col(key))
    return first_by(hit, [name], F.length("_prefix").desc()).drop("_prefix")


def resolve_sources(requests: DataFrame, roots: dict[str, DataFrame]) -> DataFrame:
    """requests (sample_id, kind, key) against one index (key, path, root_ord) per kind; the first root wins."""
    out = None
    for kind, index in roots.items():
        one = requests.where(F.col("kind") == kind).join(index.groupBy("key").agg(F.min_by("path", "root_ord").alias("path")), "key")
        out = one if out is None else out.unionByName(one)
    return out


def archive_scan(members: DataFrame, extensions: tuple[str, ...], member_limit: int, total_limit: int) -> DataFrame:
    """members (archive, pos, name, size) -> status of each member with one of the extensions, in order.

    Unsafe paths are reported; other extensions are dropped in silence; too large members are reported; the running
    total includes the member that trips it and every later one.
    """
    unsafe = F.col("name").rlike("(^|[/\\\\])\\.\\.([/\\\\]|$)") | F.col("name").rlike("^([/\\\\]|[A-Za-z]:)")
    wanted = F.lower(F.regexp_extract("name", "(\\.[^./\\\\]*)$", 1)).isin(*extensions)
    rows = members.withColumn("_unsafe", unsafe).where(F.col("_unsafe") | wanted)
    counted = ~F.col("_unsafe") & (F.col("size") <= member_limit)
    w = Window.partitionBy("archive").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(F.when(counted, F.col("size")).otherwise(0)).over(w)
    status = F.when(F.col("_unsafe"), "skipped_unsafe_path").when(F.col("size") > member_limit, "skipped_member_too_large").when(running > total_limit, "skipped_archive_too_large").otherwise("staged")
    return rows.withColumn("running", running).withColumn("status", status).drop("_unsafe")


def export_cap(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of a group as staged, the next one as truncated; later ones aren't emitted."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap + 1).withColumn("status", F.when(F.col("_n") <= cap, "staged").otherwise("truncated")).drop("_n")


def url_dedup(urls: DataFrame, limit: int | None = None) -> DataFrame:
    """The first row (by ord) of each URL, in order, at most ``limit``: the limit is the caller's."""
    firsts = urls.groupBy("url").agg(F.min("ord").alias("ord"))
    return firsts.orderBy("ord").limit(limit) if limit else firsts


def unique_names(df: DataFrame, name: str, order: str, sep: str = "_", within: tuple[str, ...] = ()) -> DataFrame:
    """Later rows of one name get _1, _2, ... in order, within each of ``within``. A name of any number of rows is ranked in pieces."""
    rank = F.col("_rank")
    named = ranked(df, [*within, name], [order], "_rank")
    return named.withColumn("unique_name", F.when(rank > 0, F.concat_ws(sep, name, rank)).otherwise(F.col(name))).drop("_rank")


# Words of a slug that don't change the geometry.
MATERIAL_TOKENS = (
    "steel", "stainless", "stainless-steel", "aluminum", "brass", "bronze", "titanium", "nickel", "plastic", "nylon", "carbon", "silver", "iron", "copper", "monel", "inconel",
    "18", "8", "316", "304", "410", "440", "highly", "corrosion", "resistant", "high", "strength", "wide", "thickness", "range",
)


def geometry_key(url: Column) -> Column:
    """A leaf slug without its trailing number and material words."""
    slug = F.regexp_replace(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), "~+$", "")
    tokens = F.split(F.regexp_replace(slug, "-\\d+$", ""), "-")
    return F.array_join(F.filter(tokens, lambda t: (t != "") & ~t.isin(*MATERIAL_TOKENS)), "-")


def dedup_by_geometry(items: DataFrame, url: str, priority: str, order: str) -> DataFrame:
    """The item of best (lowest) priority for each geometry key; ties keep list order."""
    keyed = items.withColumn("geometry_key", geometry_key(F.col(url)))
    return keyed.groupBy("geometry_key").agg(F.min_by(F.struct(*items.columns), F.struct(priority, order)).alias("_best")).select("geometry_key", "_best.*")


def family_order(items: DataFrame, slug: Column, tokens: list[str]) -> DataFrame:
    """Sort key of priority tokens: the least index of a token the slug holds, 10000 without one, then the slug."""
    index = F.least(*[F.when(F.contains(slug, F.lit(t)), i).otherwise(10000) for i, t in enumerate(tokens)], F.lit(10000))
    return items.withColumn("priority", index).withColumn("slug", slug)


def retention(rows: DataFrame, kept: Column, split: str, source: str) -> DataFrame:
    """Kept and total per split and source, with roll-ups; null stands for all."""
    out = rows.withColumn("_kept", kept.cast("long")).rollup(split, source).agg(F.count("*").alias("total"), F.sum("_kept").alias("kept"))
    return out.withColumn("rate", F.col("kept") / F.col("total"))


def guard_holdout(rows: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """rows, or a failing query if one of them is in the holdout."""
    marks = holdout.select(F.col(key)).distinct().withColumn("_held", F.lit(True))
    joined = rows.join(marks, key, "left")
    clash = F.concat(F.lit("holdout row in a split: "), F.col(key).cast("string"))
    return joined.where(F.when(F.col("_held"), F.raise_error(clash).cast("boolean")).otherwise(F.lit(True))).drop("_held")


def assembly_paths(nodes: DataFrame, node: str = "part_id", parent: str = "parent_id", name: str = "name", sep: str = "/") -> DataFrame:
    """Path of names from the root down to each node, by doubling: each round joins paths to the paths of their heads.

    Heads alone are doubled first, an action that gives the number of rounds; a cycle of parents raises ValueError.
    """
    now = nodes.select(F.col(node).alias("id"), F.col(parent).alias("head"), F.col(name).cast("string").alias("path"), F.lit(1).alias("depth"))
    known = nodes.select(F.col(node).alias("known"))
    now = now.join(known, F.col("head") == F.col("known"), "left").withColumn("head", F.col("known")).drop("known")
    heads, rounds, most = written(now.select("id", "head").distinct()), 0, nodes.count()
    while not heads.where("head is not null").isEmpty():
        if 1 << rounds >= most:
            raise ValueError(f"{parent} has a cycle")
        above = heads.select(F.col("id").alias("head"), F.col("head").alias("next"))
        heads, rounds = written(heads.join(above, "head", "left").select("id", F.col("next").alias("head")).distinct()), rounds + 1
    for _ in range(rounds):
        up = now.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("path").alias("above"), F.col("depth").alias("d"))
        now = now.join(up, "head", "left").select("id", F.col("next").alias("head"), F.when(F.col("above").isNotNull(), F.concat_ws(sep, "above", "path")).otherwise(F.col("path")).alias("path"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"))
    return now.select("id", "path", "depth")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have, and those of one alone: n_shared, n_a_only, n_b_only."""
    side = lambda df, name: df.select(F.col(key)).distinct().withColumn(name, F.lit(1))
    j = side(a, "a").join(side(b, "b"), key, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both, one, other = F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b").isNull(), F.col("a").isNull()
    return j.agg(n(both).alias("n_shared"), n(one).alias("n_a_only"), n(other).alias("n_b_only"))


def paired_without(a: DataFrame, b: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Rows of both tables side by side (a's columns, then b's as b_*), without the excluded keys."""
    right = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    return a.join(right, key).join(excluded.select(key), key, "left_anti")


def looked_up(rows: DataFrame, table: DataFrame, key: str, default: str = "_unknown") -> DataFrame:
    """rows with the table's other columns, ``default`` where the key is missing there."""
    found = [c for c in table.columns if c != key]
    return rows.join(table, key, "left").na.fill(default, found)


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def class_weighted_sample(rows: DataFrame, key: str, cls: str, n: int, seed: str = "sample") -> DataFrame:
    """n rows without replacement, seeded, each class about as likely as any other whatever its size.

    A row of a class with c rows has weight 1/c; the n least of -ln(u) / weight are taken (Efraimidis and Spirakis).
    """
    sizes = rows.groupBy(F.col(cls).alias("_cls")).agg(F.count("*").alias("_n"))
    u = hash_fraction(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    j = rows.join(sizes, F.col(cls).eqNullSafe(F.col("_cls")))
    ranked = j.withColumn("_at", -F.log(F.greatest(u, F.lit(1e-10))) * F.col("_n"))
    return ranked.orderBy("_at", key).limit(n).drop("_cls", "_n", "_at")


def padded(rows: DataFrame, group: str, order: str, value: str, length: int) -> DataFrame:
    """group, values, mask: each group's values in order, cut or padded with zeros to one length; mask marks the padding."""
    own = rows.groupBy(group).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, value))), 1, length), lambda r: r[value].cast("double")).alias("own"))
    fill = lambda x: F.array_repeat(x, F.lit(length) - F.size("own"))
    return own.select(group, F.concat("own", fill(F.lit(0.0))).alias("values"), F.concat(F.transform("own", lambda v: F.lit(False)), fill(F.lit(True))).alias("mask"))


def model_samples(listing: DataFrame, split: str = "train", ratio: float = 0.8, marker: str = "face_grids.npy") -> DataFrame:
    """listing (path, relative to the root) -> cls, class_idx, model: the samples of a split.

    A model is a folder that holds the marker. If the root has a folder named as the split, that is read whole; else
    the root's samples in order of class and model are cut at ``ratio`` (train before it). If the first five folders
    are models themselves, the layout is flat and all are of the class ``_flat``; else folders are classes.
    """
    nested = bool(listing.agg(F.max(F.startswith("path", F.lit(split + "/")))).first()[0])
    if nested:
        listing = listing.where(F.startswith("path", F.lit(split + "/"))).withColumn("path", F.substring("path", len(split) + 2, 1 << 30))
    parts = F.split("path", "/")
    inside = listing.where((F.size(parts) > 1) & ~F.startswith("path", F.lit("."))).select(parts.alias("p"))
    firsts = inside.groupBy(F.col("p")[0].alias("dir")).agg(F.max((F.size("p") == 2) & (F.col("p")[1] == marker)).alias("own")).orderBy("dir").limit(5).collect()
    if firsts and all(r["own"] for r in firsts):
        found = inside.where((F.size("p") == 2) & (F.col("p")[1] == marker)).select(F.lit("_flat").alias("cls"), F.col("p")[0].alias("model"))
        classes = found.select("cls").distinct()
    else:
        found = inside.where((F.size("p") == 3) & (F.col("p")[2] == marker)).select(F.col("p")[0].alias("cls"), F.col("p")[1].alias("model"))
        classes = inside.select(F.col("p")[0].alias("cls")).distinct()
    index = classes.select("cls", (F.row_number().over(Window.orderBy("cls")) - 1).cast("int").alias("class_idx"))  # as many as classes
    found = found.distinct().join(index, "cls")
    if nested:
        return found.select("cls", "class_idx", "model")
    placed = written(ranked(found, [], ["cls", "model"]), "samples")
    cut = int(placed.count() * ratio)
    return placed.where(F.col("rank") < cut if split == "train" else F.col("rank") >= cut).select("cls", "class_idx", "model")
