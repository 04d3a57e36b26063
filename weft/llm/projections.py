"""Near-duplicate embeddings by counting collisions in one-dimensional projections.

Two vectors at an angle of at most that of ``cosine`` lie close together in every projection on a random line. Unit
vectors are projected on ``LINES`` lines; each projection is sorted, and around every vector a window of fixed half-width says
which others collide with it. Pairs with enough collisions are verified by their cosine in double precision. As the
difference of two projections at distance d is normal with deviation d, the count that a true pair reaches with probability
``COUNTED`` is known exactly, whatever the data.

On one line alone, a window holds a fixed share of all rows, so that all windows together grow with the square of the table. Rows
are therefore first dealt to blocks, several times over: in each of several tables, a block is the combination of sides of
median cuts of further projections, about ``ROWS`` rows in each. Windows are taken inside blocks. How many tables there are
is calibrated to ``TOGETHER``: from the distance of a sample's projections to the cuts follows how likely a
partner at exactly the threshold lies on the same side of all of them. A pair that meets in several tables counts in the first.

Equal vectors are one class with a number of copies. Where a block is large, the normalised mean of those rows that are near a
pivot is tried as a centre: all rows within half the angle of a centre are within the angle of each other, are linked
without comparison and counted by a sum. Blocks above ``TILE`` rows are compared in pairs of tiles, of which those of
one centre's rows are left out. So a large group of near copies costs its members times the other tiles of its blocks.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components link with
nothing, are their own component and kept; so are rows without an id, whose component is null unless linked; rows that share
an id are rows of their own (kept if their id is the smallest); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounds, durable, grouped_rows
from .graph import components

COSINE = 0.9
LINES = 24
#: Half-width of a window, in distances of the threshold.
WIDTH = 1.2
COUNTED = 0.995
TOGETHER = 0.97
ROWS = 128
TILE = 1024
#: Rows from which cuts, and of these from which the number of tables is taken.
SAMPLE, _CALIBRATION = 8192, 1024
TABLES = 512
#: Blocks of more than this share of all rows (and more than a tile) propose centres.
CENTRE_SHARE = 1000
#: Tables whose large blocks do, and pivots that are tried in each.
_CENTRE_TABLES, _PIVOTS = 4, 8
_SALTS = 16
#: Classes of more copies than this, and than a thousandth of all rows, are matched with their rows by a table sent to every task.
_HOT = 10_000


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal law."""
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(x) / math.sqrt(2)))


def least_count(lines: int = LINES, width: float = WIDTH, recall: float = COUNTED) -> int:
    """The highest count that a pair at the threshold's distance reaches with probability ``recall``."""
    p = math.erf(width / math.sqrt(2))
    reach = 0.0
    for count in range(lines, -1, -1):
        reach += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if reach >= recall:
            return count
    return 0


class Cuts:
    """Lines and median cuts of all tables, and how many tables the recall asks for."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, per_block: int = ROWS, recall: float = TOGETHER):
        dim = sample.shape[1]
        self.bits = max(0, round(math.log2(max(rows, 1) / per_block))) if rows > per_block else 0
        rng = np.random.default_rng(41)
        self.lines, self.cuts, missed = [], [], np.ones(min(len(sample), _CALIBRATION))
        sine = math.sqrt(1 - cosine**2)
        while len(self.lines) < TABLES:
            lines = rng.standard_normal((dim, self.bits))
            v = sample @ lines
            cut = np.median(v, axis=0) if len(sample) else np.zeros(self.bits)
            v = v[:_CALIBRATION]
            self.lines.append(lines)
            self.cuts.append(cut)
            # a partner at the threshold projects to cosine * v plus a normal part across v's vector
            across = np.sqrt(np.maximum((lines**2).sum(axis=0)[None] - v**2, 1e-12)) * sine / math.sqrt(max(dim - 1, 1))
            same = _normal(np.where(v > cut, 1, -1) * (cosine * v - cut) / across).prod(axis=1) if self.bits and len(sample) else np.ones(len(v))
            missed *= 1 - same
            if missed.mean() <= 1 - recall if len(sample) else True:
                break
        self.lines, self.cuts = np.concatenate(self.lines, axis=1), np.concatenate(self.cuts)

    @property
    def tables(self) -> int:
        return max(1, len(self.cuts) // self.bits) if self.bits else 1

    def blocks(self, x: np.ndarray) -> np.ndarray:
        """The block of each row in each table."""
        if not self.bits:
            return np.zeros((len(x), 1), np.int64)
        side = (x @ self.lines > self.cuts).reshape(len(x), self.tables, self.bits)
        return side @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, v, copies, least) of distinct vectors, and (vec_id, cls) of all rows."""
    found = rows.groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    found = durable(found.withColumn("cls", F.monotonically_increasing_id()), "classes")
    many = max(_HOT, rows.count() // 1000)
    hot = F.broadcast(found.filter(F.col("copies") > many).select("v", "cls"))  # a thousand rows at most
    near = rows.join(hot, "v", "left")
    rest = near.filter("cls is null").drop("cls").join(found.filter(F.col("copies") <= many).select("v", "cls"), "v")
    return found, near.filter("cls is not null").select("vec_id", "cls").union(rest.select("vec_id", "cls"))


def balls(placed: DataFrame, large: DataFrame, dim: int, cosine: float) -> np.ndarray:
    """Centres that large blocks propose: means of the rows near one of some pivots of the block, far from each other."""
    inside = placed.select("v", F.posexplode("blocks").alias("tab", "block")).join(F.broadcast(large), ["tab", "block"])
    drawn = F.when(F.pmod(F.xxhash64("v"), F.col("every")) == 0, F.struct(F.xxhash64("v", F.lit(5)).alias("at"), "v"))
    pivots = inside.groupBy("tab", "block").agg(F.slice(F.sort_array(F.collect_list(drawn)), 1, _PIVOTS)["v"].alias("pivots"))  # of about 64
    held = placed.sparkSession.sparkContext.broadcast({(r["tab"], r["block"]): unit(np.array(r["pivots"], float)) for r in pivots.collect() if r["pivots"]})

    def run(batches):
        total = {}
        for batch in batches:
            if not len(batch):
                continue
            tab, block, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), unit(_matrix(batch.column(2), dim))
            for t, k in np.unique(np.column_stack([tab, block]), axis=0).tolist():
                own = x[(tab == t) & (block == k)]
                for i, c in enumerate(held.value.get((t, k), ())):
                    close = own[own @ c >= cosine]
                    total[t, k, i] = total.get((t, k, i), 0) + np.append(close.sum(axis=0), len(close))
        if total:
            t, k, i = (pa.array(c, pa.int32()) for c in zip(*total, strict=True))
            yield pa.RecordBatch.from_arrays([t, k, i, pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["tab", "block", "pivot", "sums"])

    sums = inside.select("tab", "block", "v").mapInArrow(run, "tab int, block int, pivot int, sums array<double>")
    sums = sums.groupBy("tab", "block", "pivot").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(dim + 1)]).alias("sums"))
    kept = np.zeros((0, dim))
    for row in sorted(sums.collect(), key=lambda r: (-r["sums"][-1], r["tab"], r["block"], r["pivot"])):  # _PIVOTS a large block
        c = np.array(row["sums"][:-1])
        if row["sums"][-1] >= TILE / 8 and c.any() and (kept @ unit(c[None])[0] < cosine).all():
            kept = np.concatenate([kept, unit(c[None])])
    return kept


def compare(x: np.ndarray, y: np.ndarray, same: bool, lines: np.ndarray, half: float, least: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) that collide ``least`` times in windows around x's projections and pass the cosine."""
    px, py = unit(x) @ lines, unit(y) @ lines
    count = np.zeros((len(x), len(y)), np.int8)
    for j in range(lines.shape[1]):
        order = np.argsort(py[:, j])
        line = py[order, j]
        lo, hi = np.searchsorted(line, px[:, j] - half, "left"), np.searchsorted(line, px[:, j] + half, "right")
        edge = np.zeros((len(x), len(y) + 1), np.int8)
        rows = np.arange(len(x))
        edge[rows, lo] += 1
        edge[rows, hi] -= 1
        count[:, order] += np.cumsum(edge[:, :-1], axis=1, dtype=np.int8)
    a, b = np.nonzero(count >= least)
    if same:
        keep = a < b
        a, b = a[keep], b[keep]
    out = []
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    for lo in range(0, len(a), 1 << 16):
        i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        out.append(np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= cosine)
    good = np.concatenate(out) if out else np.zeros(0, bool)
    return a[good], b[good]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each of n rows by links inside one unit of work."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(units: DataFrame, dim: int, cosine: float, lines: int = LINES) -> DataFrame:
    """(a, b, n): n is what a's links weigh; b is a class that a reaches (or a). Units of work: tab, block, left, right tile."""
    distance = math.sqrt(2 - 2 * cosine)
    half, least = WIDTH * distance, least_count(lines)
    directions = np.random.default_rng(43).standard_normal((dim, lines))

    def run(batches):
        for whole in grouped_rows(batches, 4):
            cut = bounds(whole, 4)
            tab, side, cls, copies, ball = (whole.column(c).to_numpy() for c in (0, 4, 5, 6, 7))
            x = scaled(_matrix(whole.column(8), dim))
            seen, ends = whole.column(9).flatten().to_numpy(), np.append(0, np.cumsum(tab))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                left, right = lo + np.flatnonzero(side[lo:hi] != 2), lo + np.flatnonzero(side[lo:hi] != 1)
                same = bool((side[lo:hi] == 0).any())
                found = [(np.zeros(0, np.int64),) * 2]
                for at in range(0, len(left), TILE):
                    for to in range(at if same else 0, len(right), TILE):
                        i, j = left[at : at + TILE], right[to : to + TILE]
                        p, q = compare(x[i], x[j], same and at == to, directions, half, least, cosine)
                        found.append((i[p], j[q]))
                a, b = (np.concatenate(f) for f in zip(*found, strict=True))
                t = int(tab[lo])
                new = (ball[a] < 0) | (ball[a] != ball[b])
                if t:
                    earlier = seen[ends[lo] : ends[hi]].reshape(hi - lo, t)
                    new &= (earlier[a - lo] != earlier[b - lo]).all(axis=1)
                a, b = a[new], b[new]
                if not len(a):
                    continue
                n = np.bincount(a - lo, copies[b], hi - lo) + np.bincount(b - lo, copies[a], hi - lo)
                root = _roots(hi - lo, a - lo, b - lo)
                met = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(cls[lo + met]), pa.array(cls[lo + root[met]]), pa.array(n[met].astype(np.int64))], names=["a", "b", "n"])

    dealt = units.repartition("tab", "block", "left", "right").sortWithinPartitions("tab", "block", "left", "right")
    return dealt.select("tab", "block", "left", "right", "side", "cls", "copies", "ball", "v", "seen").mapInArrow(run, "a long, b long, n long")


def units_of(placed: DataFrame) -> DataFrame:
    """Rows of every block, each once or, in blocks above a tile, once for each pair of tiles that it takes part in.

    ``seen`` are a row's blocks in the tables before.
    """
    rows = placed.select("cls", "copies", "ball", "v", "blocks", F.posexplode("blocks").alias("tab", "block"))
    rows = rows.withColumn("seen", F.slice("blocks", F.lit(1), F.col("tab"))).drop("blocks")
    sizes = placed.select("ball", F.posexplode("blocks").alias("tab", "block")).groupBy("tab", "block", "ball").agg(F.count(F.lit(1)).alias("k"))
    # a block's parts: its rows of each centre, and of none; as many as it has centres
    part = F.struct("ball", F.ceil(F.col("k") / TILE).cast("int").alias("tiles"))
    parts = sizes.groupBy("tab", "block").agg(F.sum("k").alias("k"), F.sort_array(F.collect_list(part)).alias("parts")).filter(F.col("k") > TILE)
    before = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda n, p: n + p["tiles"])
    parts = parts.select("tab", "block", F.transform("parts", lambda p, i: F.struct(p["ball"].alias("ball"), p["tiles"].alias("tiles"), before(i).alias("first"))).alias("parts"), before(F.size("parts")).alias("all"))
    parts = durable(parts, "tiles").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(_SALTS)).cast("int")).join(parts, ["tab", "block", "salt"], "left")
    rows = rows.withColumn("part", F.filter("parts", lambda p: p["ball"] == F.col("ball"))[0])
    first, to, total = F.col("part.first"), F.col("part.first") + F.col("part.tiles"), F.col("all")
    own = F.coalesce(first + F.pmod(F.xxhash64("cls", F.lit(7)), F.col("part.tiles")).cast("int"), F.lit(0))
    none = F.array().cast("array<int>")
    others = F.concat(F.when(first > 0, F.sequence(F.lit(0), first - 1)).otherwise(none), F.when(to < total, F.sequence(to, total - 1)).otherwise(none))
    met = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("ball") < 0, F.sequence(F.lit(0), total - 1)).otherwise(others)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(met))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    tiles = [F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right")]
    return rows.select("tab", "block", *tiles, side.alias("side"), "cls", "copies", "ball", "v", "seen")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = df.sparkSession
    kind = df.schema[vector].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(T.ArrayType(kind)).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.withColumn("ok", F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False)))
    widths = rows.filter("ok").groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    dim = widths["w"] if widths else 1
    rows = durable(rows.withColumn("ok", F.col("ok") & (F.size("v") == dim)), "vectors")
    classes, members = classes_of(rows.filter("ok").select("vec_id", "v"))
    n = classes.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    picked = classes.filter(F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(SAMPLE).toArrow()  # SAMPLE rows
    cuts = Cuts(unit(_matrix(picked.column(0).combine_chunks(), dim)) if len(picked) else np.zeros((0, dim)), n, cosine)
    shared = spark.sparkContext.broadcast(cuts)

    def place(batches):
        for batch in batches:
            if len(batch):
                found = shared.value.blocks(unit(_matrix(batch.column(2), dim)))
                ends = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel().astype(np.int32)))], names=["cls", "copies", "v", "blocks"])

    schema = T.StructType([*[classes.schema[c] for c in ("cls", "copies", "v")], T.StructField("blocks", T.ArrayType(T.IntegerType()))])
    placed = durable(classes.select("cls", "copies", "v").mapInArrow(place, schema), "placed")
    least = max(TILE, n // CENTRE_SHARE)
    large = placed.select(F.posexplode(F.slice("blocks", 1, _CENTRE_TABLES)).alias("tab", "block")).groupBy("tab", "block").count().filter(F.col("count") > least)
    large = durable(large.select("tab", "block", F.greatest(F.lit(1), F.floor(F.col("count") / 64)).alias("every")), "large")  # CENTRE_SHARE a table at most
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    centres = balls(placed, large, dim, cosine) if large.limit(1).count() else np.zeros((0, dim))
    middle = spark.sparkContext.broadcast(centres)

    def belong(batches):
        for batch in batches:
            if len(batch):
                ball = np.full(len(batch), -1, np.int64)
                if len(middle.value):
                    s = unit(_matrix(batch.column(2), dim)) @ middle.value.T
                    ball = np.where(s.max(axis=1) >= half, s.argmax(axis=1), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball)], names=["cls", "copies", "v", "blocks", "ball"])

    placed = durable(placed.mapInArrow(belong, T.StructType([*schema.fields, T.StructField("ball", T.LongType())])), "balls")
    found = durable(links(units_of(placed), dim, cosine), "links")
    within = placed.filter("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("together"), F.min("cls").alias("first"))
    inside = placed.filter("ball >= 0").select("cls", "ball", "copies").join(F.broadcast(within), "ball")  # a row a centre
    edges = found.select("a", "b").union(inside.select(F.col("cls").alias("a"), F.col("first").alias("b")))
    roots = components(edges)
    counts = found.select("a", "n").union(inside.select("cls", F.col("together") - F.col("copies"))).groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    named = classes.select("cls", "copies", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").join(counts, "cls", "left")
    named = named.select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = members.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int")).join(named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["cls", "salt"])
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
