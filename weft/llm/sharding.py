"""Sharding by a k-d tree over metadata.

Texts that are equal stay together, so the tree's points are groups of equal texts, weighted by bytes.
A leaf that still holds more than one shard is split along the dimension in which it is widest
(in units of the whole table's range), at a weighted quantile that a few rounds of distributed
histograms narrow down; the shards go to both sides in proportion to their bytes. Bins are even in the value at first, then even in the
logarithm while a range spans more than a factor of two, and even in the value (and at last in the group's key) afterwards, so that
every round but the first narrows the search by the number of bins whatever the values are, and no cut is left unfinished. Points, leaves,
histograms and cuts are tables; the driver sees the totals of the whole table and one count a round.

Defined results: a null text counts as empty; metadata that is null, NaN or infinite counts as 0; texts are told
apart by 64-bit hashes (a collision puts two texts into one shard); a text of any length is one group, and a group
that is larger than a shard fills a shard of its own; equal rows get neighbouring slots; fewer groups than shards
leave shards empty; an empty table gives an empty table; columns that are not named are not looked at, and
``sharded`` replaces one named ``shard`` and passes all others through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

BINS = 4096
#: A cut may miss its quantile by this share of the leaf.
TOLERANCE = 0.001
SLOT_ROWS = 10_000
#: A node's number is its level, its parent's first shard and its side.
_LEVEL = 1 << 34
_LEAST, _MOST = -(2**63), 2**63 - 1


def _number(df: DataFrame, column: str) -> Column:
    """A metadata column as a number; strings by their CRC."""
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        v = c.cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.coalesce(F.unix_timestamp(c).cast("double"), F.lit(0.0))
    return F.coalesce(F.crc32(c.cast("string").cast("binary")).cast("double"), F.lit(0.0))


def kd_shards(items: DataFrame, weight: str, group: str, dims: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(group, shard) for each value of the long column ``group`` of ``items``.

    ``weight`` is a long column; ``dims`` are double columns (a group's smallest value counts). Either
    the number of ``shards`` is given, or ``target_bytes``, which the leaves reach.
    """
    dims_ = [f"__d{i}" for i in range(len(dims))]
    points = items.groupBy(F.col(group).alias("__group")).agg(F.sum(weight).alias("__w"), *[F.min(d).alias(c) for d, c in zip(dims, dims_, strict=True)])
    points = durable(points.withColumn("__node", F.lit(0).cast("long")), "points")
    whole = _extents(points, dims_)
    ends = whole.first()
    if ends is None:
        return points.select(F.col("__group").alias(group), F.lit(0).alias("shard"))
    if shards is None:
        shards = max(1, -(-int(ends["bytes"]) // int(target_bytes)))
    scale = [max(b - a, 1e-300) for a, b in zip(ends["low"], ends["high"], strict=True)]
    leaves = durable(whole.select("node", F.lit(0).alias("first"), F.lit(int(shards)).alias("shards"), "bytes", "low", "high"), "leaves")
    level, more = 0, shards > 1
    while more:  # both sides of a cut get fewer shards
        level += 1
        open_ = leaves.filter("shards > 1").withColumn("tag", F.lit(level * _LEVEL) + F.col("first") * F.lit(2).cast("long"))
        cuts = _search(points, _start(open_, scale), dims_)
        points = durable(_split(points, cuts, dims_), "points")  # else each level would split anew from the root
        leaves, more = _watched(leaves.filter("shards = 1").unionByName(_halves(_extents(points, dims_), open_)), F.col("shards") > 1, "leaves")
    numbers = leaves.select(F.col("node").alias("__leaf"), F.col("first").alias("shard"))
    return points.join(numbers, F.col("__node") == F.col("__leaf")).select(F.col("__group").alias(group), "shard")


def _watched(df: DataFrame, unfinished: Column, name: str) -> tuple[DataFrame, int]:
    """``df`` as a table, and how many of its rows are unfinished, observed while it is written."""
    seen = Observation()
    return durable(df.observe(seen, F.count_if(unfinished).alias("n")), name), seen.get["n"]


def _extents(points: DataFrame, dims: list[str]) -> DataFrame:
    """(node, bytes, low, high) of every node that has points."""
    ends = [F.array(*[f(d) for d in dims]).alias(k) for k, f in (("low", F.min), ("high", F.max))]
    return points.groupBy(F.col("__node").alias("node")).agg(F.sum("__w").alias("bytes"), *ends)


def _halves(extents: DataFrame, parents: DataFrame) -> DataFrame:
    """The leaves below ``parents``. Shards are dealt by bytes; a leaf that couldn't be split keeps one, its others stay empty."""
    up = parents.select("tag", "first", "shards", F.col("bytes").alias("all"))
    side = extents.join(up, F.col("node") - F.pmod("node", F.lit(2)) == F.col("tag"))
    left = F.when(F.col("node") % 2 == 0, F.col("bytes")).otherwise(F.col("all") - F.col("bytes"))
    share = F.least(F.greatest(F.round(F.col("shards") * left / F.col("all")).cast("int"), F.lit(1)), F.col("shards") - 1)
    alone = F.col("bytes") == F.col("all")
    one = F.col("node") % 2 == 0
    first = F.when(alone | one, F.col("first")).otherwise(F.col("first") + share)
    return side.select("node", first.alias("first"), F.when(alone, 1).when(one, share).otherwise(F.col("shards") - share).alias("shards"), "bytes", "low", "high")


def _start(leaves: DataFrame, scale: list[float]) -> DataFrame:
    """A search for each leaf's weighted quantile: first along its widest dimension, then along the key among equal values."""
    wide = [(F.get("high", F.lit(i)) - F.get("low", F.lit(i))) / F.lit(x) for i, x in enumerate(scale)]
    dim = F.array_position(F.array(*wide), F.greatest(*wide) if len(wide) > 1 else wide[0]).cast("int") - 1
    x = leaves.withColumn("dim", dim).select("node", "tag", "dim", "bytes", (F.col("bytes") * F.floor(F.col("shards") / 2) / F.col("shards")).alias("goal"), F.get("low", F.col("dim")).alias("low"), F.get("high", F.col("dim")).alias("high"))
    return x.select("*", (F.col("low") == F.col("high")).alias("by_key"), F.lit(_LEAST).alias("key_low"), F.lit(_MOST).alias("key_high"), F.lit(0).cast("double").alias("below"), F.lit(False).alias("done"), F.col("low").alias("value"), F.lit(_LEAST).alias("cut_key"), F.lit(False).alias("looked"))


def _search(points: DataFrame, cuts: DataFrame, dims: list[str]) -> DataFrame:
    """Narrow every cut to its quantile, all leaves at once: one aggregation a round."""
    live = cuts
    while True:  # the range of values, then of keys, shrinks until one group is left
        x = points.join(live, F.col("__node") == F.col("node")).withColumn("v", F.get(F.array(*dims), F.col("dim")))
        step = F.when(F.col("high") > F.col("low"), (_place(F.col("v")) - _place(F.col("low"))) / (_place(F.col("high")) - _place(F.col("low"))) * BINS).otherwise(0.0)
        whole = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  differences of keys don't fit into a long
        key_step = (whole("__group") - whole("key_low")).cast("double") / ((whole("key_high") - whole("key_low")).cast("double") + 1) * BINS
        keep = F.when(F.col("by_key"), (F.col("v") == F.col("low")) & F.col("__group").between(F.col("key_low"), F.col("key_high"))).otherwise(F.col("v").between(F.col("low"), F.col("high")))
        bin_ = F.least(F.floor(F.when(F.col("by_key"), key_step).otherwise(step)).cast("int"), F.lit(BINS - 1))
        sums = [F.sum("__w").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"), F.min("__group").alias("ka"), F.max("__group").alias("kb")]
        bins = x.filter(keep).groupBy("node", bin_.alias("bin")).agg(*sums)
        cuts, more = _watched(cuts.filter("done").unionByName(_narrowed(bins, live)), ~F.col("done"), "cuts")
        if not more:
            return cuts
        live = cuts.filter("not done")


def _place(x: Column) -> Column:
    """Where a value lies within [low, high]: by itself at first, then by its logarithm while these are far apart."""
    low, high = F.col("low"), F.col("high")
    near = ~F.col("looked") | ((low > 0) & (high <= 2 * low)) | ((high < 0) & (low >= 2 * high))
    size = F.log2(F.abs(x)) + 1100  # above 0 for every double
    return F.when(near, x).when(x > 0, size).when(x < 0, -size).otherwise(0.0)


def _narrowed(bins: DataFrame, live: DataFrame) -> DataFrame:
    """The searches after a look at their histograms: done at a bin's edge that is near enough the goal, else gone into the bin that holds it."""
    own = Window.partitionBy("node").orderBy("bin")
    x = bins.select("*", (F.sum("w").over(own) - F.col("w")).alias("before"), F.lead("a").over(own).alias("next_a"), F.lead("ka").over(own).alias("next_ka"))
    x = x.join(live, "node").withColumn("left", F.col("below") + F.col("before")).withColumn("right", F.col("left") + F.col("w"))
    # the first bin that reaches the goal, or the last one
    last = F.col("next_ka").isNull()
    x = x.filter((F.col("left") < F.col("goal")) | (F.col("before") == 0)).filter((F.col("right") >= F.col("goal")) | last)
    by_key = F.col("by_key")
    to_left, to_right = F.abs(F.col("goal") - F.col("left")), F.abs(F.col("right") - F.col("goal"))
    near = (by_key & (F.col("ka") == F.col("kb"))) | (F.least(to_left, to_right) <= F.col("bytes") * TOLERANCE)
    more = ~last | (by_key & (F.col("right") < F.col("bytes")))  # something follows the bin: in the histogram, or larger values in the leaf
    at_left = (F.col("left") > 0) & ((to_left <= to_right) | ~more)  # the bin goes right
    at_right = ~at_left & more  # the bin goes left, what follows right
    stuck = ~at_left & ~at_right
    # a bin that holds everything: what lies above a single group's value goes right, other bins are looked into
    done = near & (~stuck | by_key)
    value = F.when(by_key & stuck, F.col("low") + F.abs(F.col("low")) * 1e-15 + 1e-300).when(by_key, F.col("low")).when(at_left, F.col("a")).otherwise(F.col("next_a"))
    cut_key = F.when(by_key & at_left, F.col("ka")).when(by_key & at_right, F.coalesce("next_ka", F.when(F.col("kb") < _MOST, F.col("kb") + 1).otherwise(F.lit(_MOST)))).otherwise(F.lit(_LEAST))
    return x.select(
        "node", "tag", "dim", "bytes", "goal",
        F.when(done | by_key, F.col("low")).otherwise(F.col("a")).alias("low"),
        F.when(done | by_key, F.col("high")).otherwise(F.col("b")).alias("high"),
        F.when(by_key, True).otherwise(~done & (F.col("a") == F.col("b"))).alias("by_key"),
        F.when(by_key & ~done, F.col("ka")).otherwise(F.col("key_low")).alias("key_low"),
        F.when(by_key & ~done, F.col("kb")).otherwise(F.col("key_high")).alias("key_high"),
        F.when(done, F.col("below")).otherwise(F.col("left")).alias("below"),
        done.alias("done"),
        F.when(done, value).otherwise(F.col("value")).alias("value"),
        F.when(done, cut_key).otherwise(F.col("cut_key")).alias("cut_key"),
        F.lit(True).alias("looked"),
    )


def _split(points: DataFrame, cuts: DataFrame, dims: list[str]) -> DataFrame:
    x = points.join(cuts.select("node", "tag", "dim", "value", "cut_key"), F.col("__node") == F.col("node"), "left")
    v = F.get(F.array(*dims), F.col("dim"))
    right = (v > F.col("value")) | ((v == F.col("value")) & (F.col("__group") >= F.col("cut_key")))
    node = F.when(F.col("node").isNull(), F.col("__node")).otherwise(F.col("tag") + right.cast("long"))
    return x.select("__group", "__w", *dims, node.alias("__node"))


def shard_documents(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", dims=("n_chars", "source", "lang", "doc_id")) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document; shards of near equal bytes."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = [d for d in dims if d in docs.columns] or [key]
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("__text"),
        *[_number(docs, d).alias(f"__m{i}") for i, d in enumerate(found)],
    )
    rows = durable(rows, "items")
    placed = kd_shards(rows, "size", "__text", [f"__m{i}" for i in range(len(found))], shards, target_bytes)
    placed = rows.select("doc_id", "size", "text_crc32", "__text").join(placed, "__text")
    placed = durable(placed.withColumn("__row", F.monotonically_increasing_id()), "placed")  # numbers hold once they are written
    return _slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, in buckets of bounded size."""
    buckets = max(1, placed.count() // SLOT_ROWS)
    spread = F.when(F.col("doc_id").isNull(), F.col("__row"))  # rows without an id may be equal in great numbers
    placed = placed.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "__text", spread), F.lit(buckets)))
    counts = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "__text", "__row")
    numbered = placed.withColumn("__at", F.row_number().over(inside) - 1)
    return numbered.join(counts, ["shard", "__bucket"]).withColumn("slot", (F.col("__before") + F.col("__at")).cast("long"))


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents themselves with a column ``shard`` in front, which replaces one of that name."""
    found = [d for d in ("n_chars", "source", "lang", key) if d in docs.columns]
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.withColumnsRenamed(names)
    body = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    rows = docs.select((F.octet_length(body).cast("long") + 8).alias("size"), F.xxhash64(body).alias("__text"), *[_number(docs, names[d]).alias(f"__m{i}") for i, d in enumerate(found)])
    placed = kd_shards(rows, "size", "__text", [f"__m{i}" for i in range(len(found))], shards, target_bytes)
    out = docs.withColumn("__text", F.xxhash64(body)).join(placed.withColumnRenamed("shard", "__shard"), "__text")
    return out.select(F.col("__shard").alias("shard"), *[F.col(v).alias(c) for c, v in names.items() if c != "shard"])
