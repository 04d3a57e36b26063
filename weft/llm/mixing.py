"""Mixing sources to target weights.

Tokens are summed per source, which gives each source a target and a repetition rate
(target / tokens). A document appears floor(rate) times, and once more with the probability of the
rest, drawn from a hash of the seed, its id, its text and its number among rows that are equal in both, so that rows
without an id, or under one id, are drawn apart. Everything is DataFrame functions; the documents
themselves are never shuffled while the table of sources is small (checked), and are salted by
source beyond that. Equal rows are found by a count of keys: ``mix_plan`` numbers them from the count; ``mix`` gives each
of them the floor of their mean copies, and what is left over to one of them.

Defined results: a null text has no tokens; a null source is a source of its own and comes last;
a source without tokens has rate 0; texts of any length count whole; rows that repeat are drawn one by one, and those equal in
source, id and text are told from others by 128-bit hashes; an empty table gives an empty table; columns that are not named here are passed through by ``mix`` and dropped by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources, their table is sent to every task instead of shuffled to.
BROADCAST_SOURCES = 10_000
_SALTS = 32


def words(text: str):
    return F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(docs: DataFrame, source: str = "source", text: str = "text", weights=(5, 2, 1), max_rate: int = 3) -> DataFrame:
    """(source, source_size, target) of each source.

    Sources in code point order, nulls last, weigh ``weights``, repeated as needed. The targets share
    the sum of all tokens by weight; none exceeds ``max_rate`` times its source, what is above is
    shared again by weight.
    """
    spark = docs.sparkSession
    sums = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(words(text)).alias("source_size"))
    # a distributed rank: ranges of the sorted order, and the rows before each range
    runs = sums.repartitionByRange(8, F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    runs = durable(runs.select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("at")), "sources")
    starts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("run").collect()  # one row a range
    rank, before = F.lit(0).cast("long"), 0
    for row in starts:
        rank = F.when(F.col("run") == row["run"], F.col("at") - F.lit(row["first"]) + F.lit(before)).otherwise(rank)
        before += row["n"]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = runs.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_rate).cast("double").alias("most"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, reached = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("most")
        capped, held, free = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if capped == reached or not free:
            break
        reached, level = capped, (float(total) - (held or 0.0)) / free
    share = F.lit(0.0) if level is None else F.least(F.col("weight") * F.lit(level), F.col("most"))
    plan = ranked.select("source", "source_size", share.alias("target"))
    return F.broadcast(plan) if before <= BROADCAST_SOURCES else plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def fingerprint(key: str, text: str):
    """128 bits of a row's id and text, as hex digits."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("binary"))


def draw(seed: int, finger, number):
    """A number in [0, 1) that depends on the seed, a row's fingerprint and its number among its equals."""
    text = F.concat_ws(":", F.lit(str(seed)), finger, number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names that can't clash with those of the plan."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), names


def _met(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with (source, finger) beside the plan of their source."""
    plan = plan.withColumnsRenamed({c: f"__plan_{c}" for c in plan.columns})
    on = F.col("__source").eqNullSafe(F.col("__plan_source"))
    if "__plan___salt" in plan.columns:
        on = on & (F.pmod(F.xxhash64("__finger"), F.lit(_SALTS)) == F.col("__plan___salt"))
    rate = F.when(F.col("__plan_source_size") > 0, F.col("__plan_target") / F.col("__plan_source_size")).otherwise(0.0)
    return rows.join(plan, on, "left").withColumn("__rate", rate)


def _copies(seed: int, number):
    rate = F.col("__rate")
    return F.floor(rate).cast("long") + (draw(seed, F.col("__finger"), number) < rate - F.floor(rate)).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1, **how) -> DataFrame:
    """The documents of the mix, each as often as its source's rate asks for; the columns of ``docs``."""
    docs, names = _renamed(docs)
    plan = source_targets(docs, names[source], names[text], **how)
    rows = docs.withColumn("__source", F.col(names[source])).withColumn("__finger", fingerprint(names[key], names[text]))
    equal = rows.groupBy("__source", "__finger").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
    taken = _met(equal, plan).select("__source", "__finger", "__n", "__rate", number.alias("__number")).withColumn("__copies", _copies(seed, F.col("__number")))
    taken = taken.groupBy("__source", "__finger").agg(F.max("__n").alias("__n"), F.sum("__copies").alias("__all"))
    taken = durable(taken.select(F.col("__source").alias("__s"), F.col("__finger").alias("__f"), F.floor(F.col("__all") / F.col("__n")).alias("__each"), F.pmod("__all", "__n").alias("__rest")), "equal")
    same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__finger") == F.col("__f"))
    whole = list(names.values())
    if taken.limit(1).count():
        found = _met(rows, plan).join(taken, same, "left")
        spread = found.withColumn("__copies", F.coalesce("__each", _copies(seed, F.lit(0))))
        one = F.struct(*whole)
        left = found.filter("__rest > 0").groupBy("__source", "__finger").agg(F.min("__rest").alias("__copies"), F.any_value(one).alias("__row"))
        parts = spread.select(*whole, "__copies").union(left.select("__row.*", "__copies"))
    else:
        parts = _met(rows, plan).withColumn("__copies", _copies(seed, F.lit(0))).select(*whole, "__copies")
    parts = parts.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return parts.select(*[F.col(v).alias(c) for c, v in names.items()])


def mix_plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1, **how) -> DataFrame:
    """Of every document: its size, its source's size and target, and the tokens that the mix takes of it."""
    docs, names = _renamed(docs)
    plan = source_targets(docs, names[source], names[text], **how)
    rows = docs.select(F.col(names[key]).alias("doc_id"), F.col(names[source]).alias("__source"), words(names[text]).alias("size"), fingerprint(names[key], names[text]).alias("__finger"))
    counted = rows.groupBy("doc_id", "__source", "size", "__finger").agg(F.count(F.lit(1)).alias("__n"))
    counted = _met(counted, plan).withColumn("__number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return counted.select("doc_id", "size", F.col("__plan_source_size").alias("source_size"), F.col("__plan_target").alias("target"), (F.col("size") * _copies(seed, F.col("__number"))).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS finger, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             (source_size * 3)::DOUBLE AS most FROM s),
o AS (SELECT *, most / weight AS ratio,
             coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
l AS (SELECT min_by(lev, held) AS level FROM (SELECT held, ratio, ((SELECT sum(source_size) FROM s)::DOUBLE - held) / free AS lev FROM o) WHERE lev <= ratio),
t AS (SELECT source, source_size, least(weight * level, most) AS target FROM r, l),
p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('1:' || finger || ':' || (row_number() OVER (PARTITION BY d.source, doc_id, finger) - 1)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
