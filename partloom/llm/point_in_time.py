"""Point-in-time features of sales: what was known about a client at a moment, by persistent segment trees.

A fact about a client has an event time and a moment from which it is known, no
earlier than its event time. So what a query at time t over d days may use are
the facts known by t with an event time after t - d. A segment tree over the
event times that gets the facts in the order in which they became known, and
keeps every version, answers that: t finds the version, t - d the range. The
tree is held level by level in numpy arrays: for each version the version of the
left child, and running sums of the left children's weights; a batch of queries
descends it together.

Distinct items are sums too. Of each item only its latest known occurrence is a
point: when a later one becomes known, the new point gets weight 1 and the old
one -1 from that version on.

Facts and queries are dealt into shards of clients. A client with more than
``capacity`` facts is cut into slices of its time, a slice into parts by hash if
one hour holds more; queries go to the slices that their windows touch, and
their partial sums are added up. No shard, window or broadcast grows with one
client, sale or item.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.runtime import materialise

DAY = 86_400_000_000
HOUR = 3_600_000_000
NEVER = (1 << 63) - 1
QUERY, CLICK, SALE, LINE, ITEM = range(5)
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


@dataclass(frozen=True)
class PointInTime:
    """days: windows. delay: from arrival to use, in minutes. ahead: days in which a sale sets the label.

    spread: a sale's query comes up to so many seconds after it. capacity: facts of a client that one shard takes whole.
    """

    days: tuple[int, ...] = (2, 14)
    delay: int = 240
    ahead: int = 7
    spread: int = 259_200
    capacity: int = 65_536


def micros(column: str) -> Column:
    """Microseconds from 1970 of a timestamp without a zone, read as UTC whatever the session's zone."""
    c = F.col(column)
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def cents(column: str) -> Column:
    """floor(100 * x + 0.5); null and what isn't finite count as 0."""
    x = F.col(column).cast("double")
    whole = F.when((F.abs(x) < 1e15) & ~F.isnan(x), F.floor(100 * x + 0.5).cast("long"))
    return F.coalesce(whole, F.lit(0).cast("long"))


def _known(event: Column, arrived: Column, p: PointInTime) -> Column:
    """The moment from which a fact is known; a null arrival never comes."""
    return F.when(arrived.isNull(), NEVER).otherwise(F.greatest(event, arrived + p.delay * 60_000_000))


def _fact(kind: int, e, a, n, w, **more) -> list[Column]:
    """The columns of a fact: event time, known from, weights n and w, and for clicks purchase (p) and click_id."""
    columns = {"kind": F.lit(kind).cast("byte"), "client": F.col("client"), "e": e, "a": a, "n": n, "w": w, "p": F.lit(0), "id": F.lit(None)}
    kinds = {"kind": "byte"}
    return [(c if isinstance(c, Column) else F.lit(c)).cast(kinds.get(k, "long")).alias(k) for k, c in (columns | more).items()]


def _named_sales(sales: DataFrame, p: PointInTime) -> DataFrame:
    """Sales with a client and a time, each row with a number of its own, which its query keeps."""
    rows = sales.where("client_id is not null and sold_at is not null")
    offset = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % p.spread
    rows = rows.select(
        F.monotonically_increasing_id().alias("qid"), F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("client"), micros("sold_at").alias("sold"),
        micros("arrived_at").alias("arrived"), cents("total").alias("cents"), offset.alias("offset"),
    )
    rows = rows.withColumn("t", F.col("sold") + F.col("offset") * 1_000_000).withColumn("known", _known(F.col("sold"), F.col("arrived"), p))
    return materialise(rows.drop("offset", "arrived"), "sales")


def _latest_points(seen: DataFrame) -> DataFrame:
    """seen (client, item, e, a) -> facts: a point of weight 1 for each occurrence that is the latest when it becomes known, -1 for the one it follows.

    The running latest is taken within days and over the days before, so an item with very many occurrences isn't walked in one task.
    """
    seen = seen.withColumn("day", F.floor(F.col("a") / F.lit(DAY)))
    group = ["client", "item", "day"]
    inside = Window.partitionBy(*group).orderBy("a", "e").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("client", "item").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.groupBy(*group).agg(F.max("e").alias("most")).select(*group, F.max("most").over(earlier).alias("carried"))
    rows = seen.withColumn("inside", F.max("e").over(inside)).join(carried, group)
    rows = rows.withColumn("before", F.greatest("inside", "carried")).where("before is null or e > before")
    both = F.array(F.struct(F.col("e").alias("e"), F.lit(1).cast("long").alias("n")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("e"), F.lit(-1).cast("long").alias("n"))))
    points = rows.select("client", "a", F.explode(F.array_compact(both)).alias("point"))
    return points.select(*_fact(ITEM, F.col("point.e"), F.col("a"), F.col("point.n"), 0))


def facts_of(clicks: DataFrame, sales: DataFrame, lines: DataFrame, p: PointInTime) -> list[DataFrame]:
    """Facts of clicks, of the sales of ``_named_sales``, of their lines and of their items; lines of one sale and day are summed up before they meet it."""
    same = [F.col(c).alias(f"c{i}") for i, c in enumerate(("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props"))]
    once = clicks.where("client_id is not null and ts is not null and arrived_at is not null").select(*same[:-1], F.sha2(F.col("props").cast("string"), 256).alias("c6")).distinct()
    once = once.select(F.col("c0").cast("long").alias("click_id"), F.col("c1").alias("ts"), F.col("c2").alias("arrived_at"), F.col("c3").cast("long").alias("client"), F.col("c4").alias("kind"), F.col("c5").alias("value"))
    bought = F.coalesce((F.col("kind") == "purchase").cast("long"), F.lit(0))
    seen = once.select(*_fact(CLICK, micros("ts"), _known(micros("ts"), micros("arrived_at"), p), 1, cents("value"), p=bought, id=F.col("click_id")))
    sold = sales.select(*_fact(SALE, F.col("sold"), F.col("known"), 1, F.col("cents")))

    known = lines.where("sale_id is not null and shipped_at is not null").select(F.col("sale_id").cast("long").alias("line_sale"), F.col("item_id").alias("item"), micros("shipped_at").alias("shipped"), cents("amount").alias("cents"))
    of_sale = sales.where("sale_id is not null").select("sale_id", "client", "sold", "known")
    by_day = known.groupBy("line_sale", "shipped").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    sent = by_day.join(of_sale, F.col("line_sale") == F.col("sale_id")).select(*_fact(LINE, F.col("sold"), F.greatest("known", "shipped"), F.col("n"), F.col("cents")))
    by_item = known.where("item is not null").groupBy("line_sale", "item").agg(F.min("shipped").alias("shipped"))
    items = by_item.join(of_sale, F.col("line_sale") == F.col("sale_id")).select("client", "item", F.col("sold").alias("e"), F.greatest("known", "shipped").alias("a"))
    never = F.lit(NEVER)
    return [seen, sold, sent.where(F.col("a") < never), _latest_points(items.where(F.col("a") < never))]


def time_slices(facts: DataFrame, p: PointInTime) -> tuple[DataFrame, DataFrame]:
    """For clients with more than ``capacity`` facts: (client, hour, slice, parts), and (client, slice, parts, begin, end) of the slices' times."""
    hour = F.floor(F.col("e") / F.lit(HOUR)).alias("hour")
    hours = facts.groupBy("client", hour).agg(F.count("*").alias("n"))
    crowded = hours.groupBy("client").agg(F.sum("n").alias("all")).where(F.col("all") > p.capacity).select("client")
    before = F.sum("n").over(Window.partitionBy("client").orderBy("hour")) - F.col("n")
    hours = hours.join(crowded, "client", "left_semi").withColumn("slice", F.floor(before / F.lit(p.capacity)).cast("int"))
    slices = hours.groupBy("client", "slice").agg(F.min("hour").alias("first"), F.ceil(F.sum("n") / F.lit(2 * p.capacity)).cast("int").alias("parts"))
    slices = materialise(slices.withColumn("last", F.lead("first").over(Window.partitionBy("client").orderBy("slice"))), "slices")
    by_hour = hours.join(slices.select("client", "slice", "parts"), ["client", "slice"]).select("client", "hour", "slice", "parts")
    return by_hour, slices.select("client", "slice", "parts", (F.col("first") * HOUR).alias("begin"), F.coalesce(F.col("last") * HOUR, F.lit(NEVER)).alias("end"))


class VersionedTree:
    """A segment tree over key ranks 0 to n - 1 with a version after each of n insertions.

    keys: the rank inserted by each version. weights: of each insertion. A level
    holds the nodes' entries side by side, each in the order of versions; ``left``
    says how many of the entries before a place go to left children, which is a
    node's pointer to the version of its child.
    """

    def __init__(self, keys: np.ndarray, weights: list[np.ndarray]):
        self.depth = max(1, len(keys).bit_length())
        self.left, self.cut, self.sums = [], [], []
        for bit in range(self.depth - 1, -1, -1):
            goes_left = (keys >> bit) & 1 == 0
            self.left.append(np.concatenate([[0], np.cumsum(goes_left)]).astype(np.int32))
            order = np.concatenate([np.flatnonzero(goes_left), np.flatnonzero(~goes_left)])
            self.cut.append(int(self.left[-1][-1]))
            keys, weights = keys[order], [w[order] for w in weights]
            self.sums.append([np.concatenate([[0], np.cumsum(w[: self.cut[-1]])]) for w in weights])

    def below(self, rank: np.ndarray, version: np.ndarray) -> list[np.ndarray]:
        """How many keys below ``rank`` the version holds, and the sums of their weights."""
        start, stop = np.zeros(len(version), dtype=np.int64), version.astype(np.int64)
        out = [np.zeros(len(version), dtype=np.int64) for _ in range(1 + len(self.sums[0]))]
        for level, bit in enumerate(range(self.depth - 1, -1, -1)):
            right = (rank >> bit) & 1 == 1
            a, b = self.left[level][start].astype(np.int64), self.left[level][stop].astype(np.int64)
            out[0] += np.where(right, b - a, 0)
            for total, s in zip(out[1:], self.sums[level], strict=True):
                total += np.where(right, s[b] - s[a], 0)
            start, stop = np.where(right, self.cut[level] + start - a, a), np.where(right, self.cut[level] + stop - b, b)
        return out

    def kth(self, k: np.ndarray, version: np.ndarray) -> np.ndarray:
        """The k-th smallest key (from 0) that the version holds; k must be below their number."""
        start, stop, k = np.zeros(len(version), dtype=np.int64), version.astype(np.int64), k.copy()
        key = np.zeros(len(version), dtype=np.int64)
        for level, bit in enumerate(range(self.depth - 1, -1, -1)):
            a, b = self.left[level][start].astype(np.int64), self.left[level][stop].astype(np.int64)
            right = k >= b - a
            k -= np.where(right, b - a, 0)
            key |= right.astype(np.int64) << bit
            start, stop = np.where(right, self.cut[level] + start - a, a), np.where(right, self.cut[level] + stop - b, b)
        return key


class _Facts:
    """The facts of one kind in a shard, in the order of (unit, event time, id), with their tree."""

    def __init__(self, unit, e, a, weights, tie=None):
        order = np.lexsort(((e if tie is None else tie), e, unit))
        self.unit, self.e = unit[order], e[order]
        known = np.argsort(a[order], kind="stable")
        self.known = a[order][known]
        self.order, self.tree = order, VersionedTree(known, [w[order][known] for w in weights])

    def rank(self, unit: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How many facts lie before or at (unit, upto)."""
        n = len(self.e)
        both = np.lexsort((np.concatenate([np.zeros(n, dtype=np.int8), np.ones(len(unit), dtype=np.int8)]), np.concatenate([self.e, upto]), np.concatenate([self.unit, unit])))
        asked = both >= n
        out = np.empty(len(unit), dtype=np.int64)
        out[both[asked] - n] = np.cumsum(~asked)[asked]
        return out


def answer_shard(rows: dict[str, np.ndarray], p: PointInTime) -> dict[str, np.ndarray]:
    """The partial results of a shard's queries, one for each window: qid, d, ahead (sales in the label's days), the sums, last_ts and last_row (-1: none)."""
    kind, unit = rows["kind"], rows["unit"]
    asked = np.flatnonzero(kind == QUERY)
    at, t = unit[asked], rows["e"][asked]
    facts = {}
    for k, weights in ((CLICK, ("p", "w")), (SALE, ("w",)), (LINE, ("n", "w")), (ITEM, ("n",))):
        i = np.flatnonzero(kind == k)
        facts[k] = (i, weights)
    out = {"row": np.tile(asked, len(p.days)), "d": np.repeat(np.array(p.days, dtype=np.int32), len(asked)), "last_row": np.full(len(asked) * len(p.days), -1)}
    columns = {CLICK: ("n_clicks", "n_purchases", "click_cents"), SALE: ("n_sales", "sale_cents"), LINE: (None, "n_lines", "line_cents"), ITEM: (None, "n_items")}
    for k, (i, weights) in facts.items():
        held = _Facts(unit[i], rows["e"][i], rows["a"][i], [rows[w][i] for w in weights], rows["id"][i] if k == CLICK else None)
        version = np.searchsorted(held.known, t, side="right")
        top = held.rank(at, np.full(len(at), NEVER))
        upto = held.tree.below(top, version)
        if k == SALE:
            ahead = held.rank(at, t + p.ahead * DAY) - held.rank(at, t)
            out["ahead"] = np.tile(ahead, len(p.days))
        parts = []
        for j, d in enumerate(p.days):
            under = held.tree.below(held.rank(at, t - d * DAY), version)
            parts.append([x - y for x, y in zip(upto, under, strict=True)])
            if k == CLICK and len(i):
                some = np.flatnonzero(parts[-1][0] > 0)
                last = held.tree.kth(upto[0][some] - 1, version[some])
                out["last_row"][j * len(asked) + some] = i[held.order[last]]
        for c, column in enumerate(columns[k]):
            if column:
                out[column] = np.concatenate([x[c] for x in parts])
    return out


COLUMNS = ("kind", "client", "slice", "part", "e", "a", "n", "w", "p", "id")
PARTIAL = "qid long, sale_id long, t long, slices int, d int, ahead long, " + ", ".join(f"{c} long" for c in SUMS) + ", last_ts long, last_id long"


def _answers(p: PointInTime):
    def run(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_numpy() for c in ("kind", "client", "slice", "part", "e", "a", "n", "w", "p")}
        ids = table.column("id").combine_chunks()
        rows["id"] = ids.fill_null(-(1 << 63)).to_numpy()
        order = np.lexsort((rows["part"], rows["slice"], rows["client"]))
        new = np.zeros(len(order), dtype=bool)
        for c in ("part", "slice", "client"):
            new[1:] |= rows[c][order][1:] != rows[c][order][:-1]
        rows["unit"] = np.empty(len(order), dtype=np.int64)
        rows["unit"][order] = np.cumsum(new)
        got = answer_shard(rows, p)
        at, last = got["row"], got["last_row"]
        none = pa.array(last < 0)
        where = pa.array(np.maximum(last, 0))
        pick = lambda column: pa.compute.if_else(none, pa.scalar(None, pa.int64()), column.take(where))
        # A query's row has its number in w, the sale in id, and in n the slices it was sent to.
        columns = {"qid": rows["w"][at], "sale_id": ids.take(pa.array(at)), "t": rows["e"][at], "slices": rows["n"][at].astype(np.int32), "d": got["d"], "ahead": got["ahead"]}
        columns |= {c: got[c] for c in SUMS} | {"last_ts": pick(table.column("e").combine_chunks()), "last_id": pick(ids)}
        return pa.table(columns)

    return run


def point_in_time(clicks: DataFrame, sales: DataFrame, lines: DataFrame, params: PointInTime = PointInTime()) -> DataFrame:
    """clicks, sales, lines -> per sale and window: sale_id, d, t_us, label, n_clicks, n_purchases, click_cents, last_click_id, n_sales, sale_cents, n_lines, n_items, line_cents.

    Sales without a client or a time have no row and count nowhere; every other
    sales row is a sale, repeated rows too, and has the lines of its sale_id; a
    null sale_id counts as the empty text when t is drawn, and has no lines. A
    null arrival never comes: such a sale counts for labels only, such a click
    nowhere. A line without a shipping time isn't shipped. Null or non-finite
    amounts count as 0 cents, as do those of 1e15 and more. Among clicks of one
    time a null click_id is the smallest; it can be the last click, whose id is
    then null. Other columns are ignored; empty tables give no rows or zeros.
    """
    p = params
    named = _named_sales(sales, p)
    facts = reduce(DataFrame.union, [materialise(f, "facts") for f in facts_of(clicks, named, lines, p)])
    by_hour, slices = time_slices(facts, p)
    shards = max(1, -(-2 * facts.count() // p.capacity))
    facts = facts.withColumn("hour", F.floor(F.col("e") / F.lit(HOUR))).join(by_hour, ["client", "hour"], "left").drop("hour")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("a", "e", "id", "w"), F.col("parts"))).otherwise(0).cast("int")
    facts = facts.withColumn("own", F.col("slice").isNotNull()).withColumn("slice", F.coalesce("slice", F.lit(0))).withColumn("part", part)
    asked = named.select("client", F.col("t").alias("e"), F.col("qid").alias("w"), F.col("sale_id").alias("id"))
    touched = slices.withColumnRenamed("client", "its_client")
    touches = (F.col("client") == F.col("its_client")) & (F.col("begin") <= F.col("e") + p.ahead * DAY) & (F.col("end") > F.col("e") - max(p.days) * DAY)
    sent = asked.join(touched, touches, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    many = (F.col("slice").isNotNull()).cast("long")
    sent = sent.select(*_fact(QUERY, F.col("e"), 0, many, F.col("w"), id=F.col("id")), F.col("slice").isNotNull().alias("own"), F.coalesce("slice", F.lit(0)).alias("slice"), "part")
    rows = facts.select(*sent.columns).union(sent)
    # A cut client's slices are shards of their own, the whole clients share the others.
    unit = F.xxhash64("client", "slice", "part")
    shard = F.when(F.col("own"), unit).otherwise(F.pmod(unit, F.lit(shards)))
    partial = rows.withColumn("shard", shard).drop("own").groupBy("shard").applyInArrow(_answers(p), PARTIAL)
    partial = materialise(partial, "partial")
    last = F.max(F.when(F.col("last_ts").isNotNull(), F.struct("last_ts", "last_id")))
    summed = partial.where("slices > 0").groupBy("qid", "d").agg(F.first("sale_id").alias("sale_id"), F.first("t").alias("t"), F.sum("ahead").alias("ahead"), *[F.sum(c).alias(c) for c in SUMS], last.alias("last"))
    done = [summed.withColumn("last_id", F.col("last.last_id")), partial.where("slices = 0")]
    counts = ("n_clicks", "n_purchases", "click_cents")
    rest = ("n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
    columns = ["sale_id", "d", F.col("t").alias("t_us"), (F.col("ahead") > 0).alias("label"), *counts, F.col("last_id").alias("last_click_id"), *rest]
    return done[0].select(*columns).union(done[1].select(*columns))
