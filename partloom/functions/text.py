"""Column functions for names, keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_fraction(key: Column) -> Column:
    """The first 32 bits of md5 as a fraction of 0xFFFFFFFF."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def split_of(key: Column, test: float = 0.10, val: float = 0.10, seed: str = "seed") -> Column:
    """test, val or train by the fraction of ``seed:key``; test is cut first."""
    h = hash_fraction(F.concat(F.lit(seed + ":"), key))
    return F.when(h < test, "test").when(h < test + val, "val").otherwise("train")


def family_stem(part_number: Column) -> Column:
    """Digits and letters before the trailing digits: 8822T912 -> 8822T; else the number itself."""
    stem = F.regexp_extract(part_number, "^(\\d+[A-Za-z]+)\\d+$", 1)
    return F.when(stem != "", stem).otherwise(part_number)


def slugify(name: Column, limit: int = 90) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, limit)


def safe_name(name: Column, limit: int = 80) -> Column:
    """Letters, digits, - and _ as they are, anything else as _."""
    return F.substring(F.regexp_replace(name, "[^\\p{L}\\p{N}_-]", "_"), 1, limit)


def normal_name(name: Column) -> Column:
    """The stem of a path with separators as spaces."""
    leaf = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    stem = F.regexp_replace(leaf, "(?<=.)\\.[^.]*$", "")
    return F.regexp_replace(F.translate(stem, "#", " "), "[_\\-+.]+", " ")


def name_tokens(name: Column) -> Column:
    words = F.split(F.trim(F.translate(F.lower(name), "_-", "  ")), "\\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, .95 without case, .8 if one holds the other, else shared words over the longer list."""
    low_a, low_b = F.trim(F.lower(a)), F.trim(F.lower(b))
    words_a, words_b = name_tokens(low_a), name_tokens(low_b)
    most = F.greatest(F.size(words_a), F.size(words_b))
    shared = F.size(F.array_intersect(words_a, words_b)) / F.when(most > 0, most)
    empty = (F.size(words_a) == 0) | (F.size(words_b) == 0)
    held = F.contains(low_b, low_a) | F.contains(low_a, low_b)
    return F.when(a == b, 1.0).when(low_a == low_b, 0.95).when(held, 0.8).when(empty, 0.0).otherwise(shared)


def prim_name(name: Column) -> Column:
    """A scene-graph identifier: other characters as _, and p_ before a first digit."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.concat(F.lit("p_"), clean))


def base_type(label: Column) -> Column:
    """A label without its confidence band, wherever the prefix stands."""
    return F.replace(F.replace(label, F.lit("possible_"), F.lit("")), F.lit("likely_"), F.lit(""))


RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


def safe_filename(name: Column) -> Column:
    """A file name that every file system takes: reserved characters as _, no outer dots or blanks, no device names."""
    clean = F.regexp_replace(F.regexp_replace(name, '[<>:"/\\\\|?*\\x00-\\x1F]', "_"), "^[. ]+|[. ]+$", "")
    stem = F.upper(F.substring_index(clean, ".", 1))
    return F.when(clean == "", "unnamed").when(stem.isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def stable_uuid(key: Column) -> Column:
    """An id in the form of a UUID that is the same for the same key, from its md5."""
    h = F.md5(key.cast("binary"))
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def iso_time(at: Column) -> Column:
    """A time as ISO 8601 text in UTC, to the second, whatever the session's zone."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
