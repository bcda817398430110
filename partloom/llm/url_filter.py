"""URL filters by a cascade of Bloom filters, with DataFrame functions only.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1
admits wrongly, level 3 the listed keys that level 2 admits, and so on until a
level admits nothing wrongly. Over the corpus's complete key universe the
parity of the first level that refuses a key is then exact membership; no join
takes part. Only keys that pass level 1 are ever shuffled.

A key is a host suffix followed by a path prefix, as in a rule, of the numbers
of labels and characters that rules have. What a rule says is a cascade too: the
rules of each verdict are told apart from the other rules.

A list too large for one filter is dealt by a hash into segments with filters
of their own. Every executor holds all filters, 12 bits for a listed key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.runtime import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


@dataclass(frozen=True)
class Cascade:
    """bits: of level 1 per key; later levels have half as many. most_bits: of one filter, 32 MB; more keys make more segments."""

    bits: int = 12
    hashes: int = 4
    most_bits: int = 1 << 28


@dataclass(frozen=True)
class Levels:
    """filters[level][segment]: the bits of a filter, in 64-bit words, high byte first."""

    filters: list[list[bytes]]
    segments: int


def host_of(url: Column) -> Column:
    after = F.regexp_replace(url, "(?s)^.*?://", "")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    after = F.regexp_replace(url, "(?s)^.*?://", "")
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The URL's (host suffix, path prefix) keys of these numbers of labels and characters, longest first, ties to the longer host."""
    given = F.array(*[F.struct(F.lit(labels).alias("labels"), F.lit(n).alias("n")) for labels, n in shapes]) if shapes else F.lit(None).cast("array<struct<labels:int,n:int>>")
    fits = F.filter(given, lambda s: (s["labels"] <= F.size(F.split(host, "\\."))) & (s["n"] <= F.length(path)))
    suffix = lambda s: F.call_function("substring_index", host, F.lit("."), -s["labels"])
    keys = F.transform(fits, lambda s: F.struct((-F.length(suffix(s)) - s["n"]).alias("order"), (-F.length(suffix(s))).alias("host_order"), F.concat(suffix(s), F.substring(path, F.lit(1), s["n"])).alias("key")))
    return F.transform(F.array_sort(F.coalesce(keys, F.array().cast("array<struct<order:int,host_order:int,key:string>>"))), lambda x: x["key"])


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(segments)).cast("int")


def _positions(key: Column, level: int, n_bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(f"{level}/{i}"), key), F.lit(n_bits)) for i in range(hashes)]


def _filters_of(keys: DataFrame, level: int, n_bits: int, hashes: int, segments: int) -> list[bytes]:
    """A Bloom filter for each segment, n_bits each; one is put together in one task, and its size is bounded."""
    spots = keys.select(_segment(F.col("key"), segments).alias("segment"), F.explode(F.array(*_positions(F.col("key"), level, n_bits, hashes))).alias("at"))
    set_words = spots.groupBy("segment", F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(segments * (n_bits // 64)).select(F.floor(F.col("id") / (n_bits // 64)).cast("int").alias("segment"), (F.col("id") % (n_bits // 64)).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = every.union(set_words).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", F.lpad(F.hex("bits"), 16, "0").alias("hex")))), lambda w: w["hex"]), "")
    found = dict.fromkeys(range(segments), b"")
    for segment, bits in words.groupBy("segment").agg(F.unhex(line).alias("bits")).toLocalIterator():
        found[segment] = bytes(bits)
    return [found[i] for i in range(segments)]


def _admits(key: Column, level: int, filters: list[bytes], hashes: int) -> Column:
    n_bits = len(filters[0]) * 8
    held = F.lit(filters[0]) if len(filters) == 1 else F.element_at(F.array(*map(F.lit, filters)), _segment(key, len(filters)) + 1)
    hit = F.lit(True)
    for at in _positions(key, level, n_bits, hashes):
        place = (F.floor(at / 64) * 8 + 8 - F.floor((at % 64) / 8)).cast("int")
        byte = F.conv(F.hex(F.substring(held, place, F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


def build_cascade(listed: DataFrame, universe: DataFrame, params: Cascade = Cascade()) -> Levels:
    """listed, universe: one column ``key``. Filters whose alternation is exact on listed and universe."""
    p = params
    inside = materialise(listed.select("key").where("key is not null").distinct(), "listed")
    segments = max(1, -(-inside.count() * p.bits // p.most_bits))
    outside, levels = None, []
    while True:
        level = len(levels)
        side = inside if level % 2 == 0 else outside
        most = side.groupBy(_segment(F.col("key"), segments)).count().agg(F.max("count")).first()[0]
        if not most:
            return Levels(levels, segments)
        bits = max(64, -(-most * (p.bits if level == 0 else max(2, p.bits // 2)) // 64) * 64)
        levels.append(_filters_of(side, level, bits, p.hashes, segments))
        admitted = _admits(F.col("key"), level, levels[-1], p.hashes)
        if level == 0:
            passed = universe.where(admitted).select("key", F.lit(0).alias("in")).union(inside.select("key", F.lit(1)))
            outside = materialise(passed.groupBy("key").agg(F.max("in").alias("in")).where("in = 0").select("key"), "admitted")
        elif level % 2 == 1:
            inside = materialise(inside.where(admitted), "admitted")
        else:
            outside = materialise(outside.where(admitted), "admitted")


def is_listed(key: Column, levels: Levels, params: Cascade = Cascade()) -> Column:
    """Membership by the parity of the first level that refuses the key."""
    out = F.lit(len(levels.filters) % 2 == 1)
    for level in reversed(range(len(levels.filters))):
        out = F.when(_admits(key, level, levels.filters[level], params.hashes), out).otherwise(F.lit(level % 2 == 1))
    return out


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, verdict."""
    rows = F.array(*[F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in rules]) if rules else F.array().cast("array<struct<rule:string,verdict:string>>")
    return spark.range(0, 1, 1, 1).select(F.inline(rows))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, default: str = "allow", params: Cascade = Cascade()) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict.

    rules: a few of them, or a table (rule, verdict) of any number; one verdict
    per rule. A rule fits its host and that host's subdomains if the path
    starts with the rule's path; the longest rule wins, and ``default`` is the
    verdict of URLs that no rule fits. Null URLs and those without ``://`` have
    an empty host and path, so no rule with a host fits them. A long URL has no
    more keys than rules have shapes. Repeated rows are judged one by one;
    other columns are ignored; an empty table gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    table = table.select(F.col("rule").alias("key"), "verdict").where("key is not null")
    host = F.substring_index("key", "/", 1)
    shapes = table.select(F.size(F.split(host, "\\.")).alias("labels"), (F.length("key") - F.length(host)).alias("n")).distinct()
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = keys_of(F.col("host"), F.col("path"), sorted(map(tuple, shapes.collect())))  # as many as label counts times path lengths
    levels = build_cascade(table, parsed.select(F.explode(keys).alias("key")), params)
    found = parsed.withColumn("rule", F.try_element_at(F.filter(keys, lambda k: is_listed(k, levels, params)), F.lit(1)))
    verdict = F.lit(None).cast("string")
    for name in sorted(r[0] for r in table.select("verdict").distinct().collect()):  # the few kinds of verdict
        its = build_cascade(table.where(F.col("verdict") == name), table, params)
        verdict = F.coalesce(verdict, F.when(is_listed(F.col("rule"), its, params), F.lit(name)))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), F.lit(default)).otherwise(verdict).alias("verdict"))
