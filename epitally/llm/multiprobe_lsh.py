"""Nearest vectors by inner product: p-stable hashing that probes perturbed buckets.

Vectors are scaled by the largest norm and completed to unit length by one more component, queries by a
zero, so that the nearest in Euclid's sense have the largest inner products. Vectors whose norms lie in the same power of two
form a band with a scale and tables of its own, so a few long vectors do not press all others into one cell. Each
table hashes by several Gaussian projections cut into cells; a query visits, beside its own, the buckets whose cells
are moved by one, in the order in which they are likely to hold neighbours, in every band. Candidates of all
tables are reranked by their exact inner products. The buckets visited grow with the vectors, and a query that found
too few candidates visits all.

Equal vectors are one entry of the index, their ids beside it, so copies cost nothing. Index and
probes meet by table and shard of buckets; a bucket above a size is spread over several shards, all of them
visited. A task holds one shard and returns its nearest per query only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_numpy, shared_table

TABLES = 8
# Probes per table of up to PROBED vectors; beyond, they grow by this power of the number, which keeps the recall.
PROBES = 60
PROBED = 50_000
PROBES_POWER = 0.4
# Bands of no more vectors are one bucket.
SMALL_BAND = 256
# In standard deviations of a projection.
WIDTH = 2.5
# Projections per table for each doubling of the number of vectors.
PROJECTIONS_PER_DOUBLING = 0.6
SHARD_ROWS = 50_000
MOST_TOGETHER = 20_000
SEED = 20


def probe_order(projections: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of moves in the order of their expected distance, the empty one first.

    A move is a rank among the 2m distances from a query to the walls of its cell, least first; the expected
    squares of those distances are known, so the order is found once for all queries. The two walls
    of one projection have ranks that add up to 2m - 1, and no set holds both.
    """
    m = projections
    cost = [(j * (j + 1)) / (4 * (m + 1) * (m + 2)) if j <= m else
            1 - (2 * m + 1 - j) / (m + 1) + ((2 * m + 1 - j) * (2 * m + 2 - j)) / (4 * (m + 1) * (m + 2))
            for j in range(1, 2 * m + 1)]
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, moves = heapq.heappop(heap)
        if all(2 * m - 1 - j not in moves for j in moves):
            out.append(moves)
        last = moves[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*moves, last + 1)))
    return out


class Hashes:
    """The projections of all tables, made from a seed alike in every task."""

    def __init__(self, dimension: int, projections: int, tables: int, width: float):
        rng = np.random.default_rng(SEED)
        self.axes = rng.normal(size=(tables, dimension + 1, projections))
        self.shifts = rng.uniform(0, width, size=(tables, 1, projections))
        self.width = width
        self.mixers = rng.integers(1, 2**62, size=projections, dtype=np.int64) * 2 + 1

    def cells(self, table: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of unit vectors, and where in its cell each projection lies, 0 to 1."""
        at = (units @ self.axes[table] + self.shifts[table]) / self.width
        cells = np.floor(at)
        return cells.astype(np.int64), at - cells

    def bucket(self, table: int, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((cells + 1000) * self.mixers).sum(axis=-1) * np.int64(31) + table

    def probed(self, table: int, units: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
        """Buckets to visit, a row per query, likely ones first."""
        cells, part = self.cells(table, units)
        m = cells.shape[1]
        walls = np.concatenate([part, 1 - part], axis=1)
        ranked = np.argsort(walls, axis=1, kind="stable")
        lines = np.arange(len(units))
        out = np.empty((len(units), len(order)), np.int64)
        for i, moves in enumerate(order):
            moved = cells.copy()
            for j in moves:
                wall = ranked[:, j]
                moved[lines, wall % m] += np.where(wall < m, -1, 1)
            out[:, i] = self.bucket(table, moved)
        return out


class Bands:
    """How each band of norms is hashed; band ``i`` has the tables from ``i * tables`` on."""

    def __init__(self, sizes: list[tuple[int, int, float]], dimension: int, tables: int, probes: int, width: float,
                 shard_rows: int):
        self.number = {exponent: i for i, (exponent, _, _) in enumerate(sizes)}
        self.largest = [norm for _, _, norm in sizes]
        self.shards = [max(1, -(-n // shard_rows)) for _, n, _ in sizes]
        self.probes = [math.ceil(probes * max(1.0, n / PROBED) ** PROBES_POWER) for _, n, _ in sizes]
        self.projections = [max(4, round(PROJECTIONS_PER_DOUBLING * math.log2(n)))
                            if n > SMALL_BAND and 0 < norm < math.inf else 0 for _, n, norm in sizes]
        self.tables, self.settings = tables, (dimension, tables, width)

    def hashes(self) -> list["Hashes | None"]:
        dimension, tables, width = self.settings
        return [Hashes(dimension, m, tables, width) if m else None for m in self.projections]

    def orders(self) -> list[list[tuple[int, ...]]]:
        return [probe_order(m, n) if m else [()] for m, n in zip(self.projections, self.probes)]

    def tables_of(self, band: int) -> range:
        return range(self.tables) if self.projections[band] else range(1)


def usable(vector: Column) -> Column:
    """True for a vector without missing or non-finite components that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = as_numpy(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(vectors: np.ndarray, largest: float) -> np.ndarray:
    scaled = vectors / largest
    rest = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
            shard_rows: int = SHARD_ROWS, most_together: int = MOST_TOGETHER) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` nearest found for each query row.

    ``is_query`` is a condition on ``vec_id``. Rows with an unusable vector, a missing id or, where lengths differ,
    another length than most (ties: the smallest) take no part. Rows equal in id and vector are one query; each
    stays a candidate, but for one of them as the query's own. Ties go to the smaller id. Where there are ``k`` candidates
    at all, a query gets ``k`` rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = lengths["n"] if lengths else 1
    rows = rows.where(F.size("v") == dimension).select(
        "vec_id", F.col("v").cast("array<double>").alias("v")
    ).select("vec_id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), "v")

    copies = rows.groupBy("k1", "k2", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    least = Window.partitionBy("k1", "k2").orderBy("vec_id")
    members = shared_table(
        copies.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1).drop("_n"), "members"
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # A norm that underflows or overflows keeps a band of its own, without hashing.
    band = F.coalesce(F.ceil(F.log2(F.when(norm < float("inf"), norm))), F.lit(5000)).cast("int").alias("band")
    classes = shared_table(rows.groupBy("k1", "k2").agg(F.any_value("v").alias("v")).select("*", band), "classes")
    queries = shared_table(
        rows.where(is_query).select(F.col("vec_id").alias("query_id"), "k1", "k2", "v")
        .dropDuplicates(["query_id", "k1", "k2"]), "queries"
    )
    # One row per power of two.
    sizes_of = classes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).orderBy("band")
    found_bands = [(r["band"], r["n"], r["norm"]) for r in sizes_of.collect()]
    bands = Bands(found_bands, dimension, tables, probes, width, shard_rows)
    largest = max(bands.largest, default=1.0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = bands.hashes()
        for batch in batches:
            numbers = np.array([bands.number[b] for b in batch.column("band").to_pylist()], np.int64)
            for i in np.unique(numbers).tolist():
                part = batch.take(pa.array(np.flatnonzero(numbers == i)))
                units = _units(_matrix(part.column("v")), bands.largest[i]) if hashes[i] else None
                for t in bands.tables_of(i):
                    buckets = hashes[i].bucket(t, hashes[i].cells(t, units)[0]) if hashes[i] else np.zeros(len(part), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), i * tables + t, np.int32)), pa.array(buckets),
                         *(part.column(c) for c in ("k1", "k2", "v"))], names=["t", "bucket", "k1", "k2", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, orders = bands.hashes(), bands.orders()
        for whole in batches:
            # Few queries at once, as each has many probes.
            for start in range(0, len(whole), 1000):
                batch = whole.slice(start, 1000)
                found = _matrix(batch.column("v"))
                scaled = found / np.abs(found).max(axis=1)[:, None]
                units = np.pad(scaled / np.linalg.norm(scaled, axis=1)[:, None], ((0, 0), (0, 1)))
                for i, order in enumerate(orders):
                    for t in bands.tables_of(i):
                        buckets = hashes[i].probed(t, units, order) if hashes[i] else np.zeros((len(units), 1), np.int64)
                        at = pa.array(np.repeat(np.arange(len(units)), buckets.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(buckets.size, i * tables + t, np.int32)), pa.array(buckets.ravel()),
                             *(batch.column(c).take(at) for c in ("query_id", "k1", "k2"))],
                            names=["t", "bucket", "query_id", "k1", "k2"])

    entries = shared_table(classes.mapInArrow(index, "t int, bucket long, k1 long, k2 long, v array<double>"), "index")
    sizes = shared_table(
        entries.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / most_together).cast("int").alias("parts")), "buckets"
    )
    # Tables of a band are dealt over as many shards as the band needs.
    per_band = F.array(*[F.lit(n) for n in bands.shards or [1]])
    shard_count = F.element_at(per_band, (F.floor(F.col("t") / F.lit(tables)) + 1).cast("int"))
    shard = F.pmod(F.xxhash64("t", "bucket", "part"), shard_count).cast("int").alias("shard")
    placed = entries.join(sizes.where("parts > 1"), ["t", "bucket"], "left").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod("k1", "parts")).otherwise(0).cast("int")
    ).select("t", shard, F.lit(0).alias("kind"), "bucket", "k1", "k2", F.lit(None).cast("long").alias("query_id"), "v",
             F.lit(None).cast("array<long>").alias("buckets"))
    visits = queries.select("query_id", "k1", "k2", "v").mapInArrow(
        probe, "t int, bucket long, query_id long, k1 long, k2 long"
    ).join(sizes, ["t", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # At most as many buckets as probes meet in one list.
    listed = visits.select("t", shard, "query_id", "k1", "k2", "bucket").groupBy("t", "shard", "query_id", "k1", "k2").agg(
        F.collect_set("bucket").alias("buckets")
    ).join(queries, ["query_id", "k1", "k2"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = None, [], None
        for batch in batches:
            place = list(zip(batch.column("t").to_pylist(), batch.column("shard").to_pylist()))
            kinds = batch.column("kind").to_pylist()
            begin = 0
            while begin < len(place):
                end = begin
                while end < len(place) and place[end] == place[begin] and kinds[end] == kinds[begin]:
                    end += 1
                part = batch.slice(begin, end - begin)
                if place[begin] != here:
                    here, held, ready = place[begin], [], None
                if kinds[begin] == 0:
                    held.append((as_numpy(part.column("bucket")), as_numpy(part.column("k1")),
                                 as_numpy(part.column("k2")), _matrix(part.column("v"))))
                elif held:
                    ready = ready or tuple(np.concatenate(x) for x in zip(*held))
                    yield _nearest_of(part, *ready, k + 1, largest)
                begin = end

    def candidates_of(entries: DataFrame, asking: DataFrame) -> DataFrame:
        """The nearest of the entries that each query visits; an entry found in several tables is one candidate."""
        asked = asking.select("t", "shard", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "k1", "k2",
                              "query_id", "v", "buckets")
        together = entries.union(asked).repartition(tables * sum(bands.shards or [1]), "t", "shard").sortWithinPartitions(
            "t", "shard", "kind", "bucket"
        )
        found = together.mapInArrow(rank, "query_id long, q1 long, q2 long, k1 long, k2 long, score double")
        return found.groupBy("query_id", "q1", "q2", "k1", "k2").agg(F.max("score").alias("score"))

    candidates = shared_table(candidates_of(placed, listed), "candidates")
    # Copies of a candidate count as often as they are there. A query itself is among its candidates, if it is found at all.
    key = ["query_id", "k1", "k2"]
    counts = members.groupBy("k1", "k2").agg(F.sum("copies").alias("copies"))
    enough = candidates.join(counts, ["k1", "k2"]).groupBy("query_id", "q1", "q2").agg(F.sum("copies").alias("found")).where(
        F.col("found") > k
    ).select("query_id", F.col("q1").alias("k1"), F.col("q2").alias("k2"))
    lacking = shared_table(queries.join(enough, key, "left_anti"), "lacking")
    if not lacking.isEmpty():
        # Their lists are empty: all entries of the first table of each band.
        first = placed.where(F.col("t") % tables == 0)
        shards = first.select("t", "shard").distinct()
        everywhere = F.broadcast(shards.agg(F.collect_list(F.struct("t", "shard")).alias("all")))
        visiting = lacking.join(everywhere).select(*key, "v", F.inline("all")).withColumn("buckets", F.array().cast("array<long>"))
        more = candidates_of(first, visiting)
        candidates = candidates.unionByName(more).groupBy("query_id", "q1", "q2", "k1", "k2").agg(F.max("score").alias("score"))
    # All that tie with the last one stay until their ids are known; one of them may be the query's own.
    best = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"))
    short = candidates.withColumn("_n", F.rank().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))
    left = F.least(F.col("copies") - own.cast("int"), F.lit(k))
    each = short.join(members, ["k1", "k2"]).withColumn("_left", left).where("_left > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left").cast("long")))
    )
    final = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _nearest_of(asked: pa.RecordBatch, bucket: np.ndarray, k1: np.ndarray, k2: np.ndarray, vectors: np.ndarray,
                most: int, largest: float) -> pa.RecordBatch:
    """The nearest entries of one shard for each query, among the buckets it visits, and all that tie with the last."""
    queries, wanted = _matrix(asked.column("v")), asked.column("buckets").to_pylist()
    lines, places, scores = [], [], []
    for i, (query, buckets) in enumerate(zip(queries, wanted)):
        begins = np.searchsorted(bucket, buckets, "left")
        ends = np.searchsorted(bucket, buckets, "right")
        spans = [(b, e) for b, e in zip(begins.tolist(), ends.tolist()) if e > b] if buckets else [(0, len(bucket))]
        if not spans:
            continue
        at = np.concatenate([np.arange(b, e) for b, e in spans])
        rough = np.concatenate([vectors[b:e] @ query for b, e in spans])
        if len(at) > most:
            # Rough sums may differ in their last bits from the exact ones, so what is as near as that stays.
            last = np.partition(rough, len(rough) - most)[len(rough) - most]
            near = np.linalg.norm(query) * largest * len(query) * 1e-15
            at = at[rough >= last - near]
        # The same sum for a pair of vectors wherever it is taken.
        exact = (vectors[at] * query).sum(axis=1)
        if len(at) > most:
            kept = exact >= np.partition(exact, len(exact) - most)[len(exact) - most]
            at, exact = at[kept], exact[kept]
        lines += [i] * len(at)
        places.append(at)
        scores.append(exact)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    line = pa.array(lines, pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(asked.column(c).take(line) for c in ("query_id", "k1", "k2")), pa.array(k1[at]), pa.array(k2[at]),
         pa.array(np.concatenate(scores) if scores else np.zeros(0))],
        names=["query_id", "q1", "q2", "k1", "k2", "score"])
