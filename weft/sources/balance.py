"""Heavy keys: found by count, their rows dealt in salts, the other side's rows repeated for each salt.

A hub of a graph, or a large batch, holds a share of all rows under one key, which a plain join sends to one task. ``Heavy`` counts
the rows of a table by key in a fixed number of places (a key's place is a hash), so that the count moves
``PLACES`` rows a partition at most, whatever the number of keys. A place with more than a share of a partition's mean is heavy, and
there are at most ``SHARE`` times the partitions of such places, so that they come to the driver and become part of the
expressions. Where nothing is heavy a join stays as it is.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places for each shuffle partition.
PLACES = 64
#: A place is heavy from a partition's mean rows divided by this.
SHARE = 4
#: Fewer rows than this in a place are never heavy.
LEAST = 1000
SALT = "__salt"


class Heavy:
    """How many salts the rows of each heavy place are dealt in. Counting is a job of its own, run when this is made."""

    def __init__(self, df: DataFrame, keys: list[str], least: int | None = None):
        self.keys = list(keys)
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.places = partitions * PLACES
        # first the sum over all, so that the driver gets heavy places only
        counted = df.select(self._place().alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
        whole = counted.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()  # one row
        self.rows = whole["rows"] or 0
        limit = max(LEAST if least is None else least, self.rows // (partitions * SHARE))
        found = counted.filter(F.col("n") > limit).collect() if (whole["most"] or 0) > limit else []  # SHARE * partitions rows
        self.salts = {r["place"]: -(-r["n"] // limit) for r in found}

    def __bool__(self) -> bool:
        return bool(self.salts)

    def _place(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.places))

    def _salts(self) -> Column:
        known = F.create_map(*[F.lit(v) for v in chain.from_iterable(self.salts.items())])
        return F.coalesce(F.element_at(known, self._place()), F.lit(1))

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` with a salt in each row of a heavy place, from a hash of the row, and 0 in the others."""
        if not self.salts:
            return df.withColumn(SALT, F.lit(0))
        columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        salts = self._salts()
        return df.withColumn(SALT, F.when(salts > 1, F.pmod(F.xxhash64(*columns), salts)).otherwise(0).cast("int"))

    def repeated(self, df: DataFrame) -> DataFrame:
        """``df`` with a row for each salt of its place."""
        if not self.salts:
            return df.withColumn(SALT, F.lit(0))
        return df.withColumn(SALT, F.explode(F.sequence(F.lit(0), self._salts() - 1)))

    def join(self, many: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
        """``many`` joined with ``one`` on the keys; rows of ``many`` under a heavy key meet a copy of ``one``'s row in several tasks."""
        if not self.salts:
            return many.join(one, self.keys, how)
        return self.dealt(many).join(self.repeated(one), [*self.keys, SALT], how).drop(SALT)


def heavy(df: DataFrame, keys: list[str]) -> Heavy:
    """The heavy places of a table, counted once for each DataFrame and keys."""
    known = df.__dict__.setdefault("_weft_heavy", {})
    at = (*keys, df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if at not in known:
        known[at] = Heavy(df, keys)
    return known[at]
