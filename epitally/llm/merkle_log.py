"""A Merkle manifest of a table: a log of tree nodes in postorder, proofs read from it, and their check.

Every group of rows has a tree of its own, whose root is a leaf of the tree over all groups. A node is the SHA-256 of
up to sixteen consecutive nodes below it, as hexadecimal text; the last run of a level may be shorter, even one
node long, and the tree ends where one node is left.

Builders work on aligned ranges of 4,096 nodes, so a group with most rows is split, and append the nodes in the order
in which they are completed: first the nodes below, then the node, which is postorder. In a full tree a
node's place in that order follows from its level, its index and the number of leaves alone (:func:`position`), so
whoever reads a range of the log finds every sibling without a search and without pointers.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_null_safe
from ..operators.ranges import ranked
from .common import lower_ascii, shared_table

ARITY = 16
# Levels that one builder completes above its input; it takes ARITY ** TIER nodes.
TIER = 3
BLOCK = ARITY**TIER

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_OUT = 4096

NODE_SCHEMA = "tree string, level int, index long, leaves long, position long, digest binary, is_root boolean"
PATH_SCHEMA = "tree string, index long, leaves long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF_SCHEMA = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
HEADER, NODE, LEAF = 0, 1, 2


def height(leaves: int) -> int:
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder of its tree, from 0.

    When the node is complete, so is every node that lies in the leaves up to its last one: on its own level and
    below all that have begun, above only those that ended before the node's first leaf.
    """
    through = min((index + 1) * ARITY**level, leaves)
    done, size = 0, 1
    for _ in range(level + 1):
        done += -(-through // size)
        size *= ARITY
    above = index
    while above:
        above //= ARITY
        done += above
    return done - 1


def tier_of_root(leaves: int) -> int:
    return max(0, -(-height(leaves) // TIER) - 1)


def field(c: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


@dataclasses.dataclass
class Forest:
    """The nodes of all trees, one written table per tier, and one row per tree with its root."""

    tiers: list[DataFrame]
    roots: DataFrame

    @property
    def log(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tiers)


class Output:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= ROWS_OUT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def node_digest(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def append_nodes(base: int):
    """Nodes above an aligned range of nodes of level ``base``, in completion order; holds the open runs only."""
    schema = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("leaves", pa.int64()),
                        ("position", pa.int64()), ("digest", pa.binary()), ("is_root", pa.bool_())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Output(schema)
        open_runs: list[list[bytes]] = [[] for _ in range(TIER)]
        for tree, index, leaves, digest in rows_of(batches):
            count = -(-leaves // ARITY**base)
            if base == 0:
                yield from out.add(tree, 0, index, leaves, position(0, index, leaves), digest, count == 1)
            open_runs[0].append(digest)
            last, level = index, 0
            while level < TIER and count > 1 and (last % ARITY == ARITY - 1 or last == count - 1):
                digest = node_digest(open_runs[level])
                open_runs[level].clear()
                last, count, level = last // ARITY, -(-count // ARITY), level + 1
                yield from out.add(tree, base + level, last, leaves, position(base + level, last, leaves), digest, count == 1)
                if level < TIER and count > 1:
                    open_runs[level].append(digest)
            if count == 1:
                open_runs = [[] for _ in range(TIER)]
        yield from out.flush()

    return build


def grow(leaves: DataFrame) -> Forest:
    """The trees over ``leaves`` (``tree``, ``index`` from 0, ``leaves``, ``digest``)."""
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    level, tiers = leaves.select("tree", "index", "leaves", "digest"), []
    for tier in range(tier_of_root(most) + 1):
        block = F.floor(F.col("index") / F.lit(BLOCK))
        dealt = level.repartition(F.col("tree"), block).sortWithinPartitions("tree", "index")
        nodes = shared_table(dealt.mapInArrow(append_nodes(tier * TIER), NODE_SCHEMA), "merkle-log")
        tiers.append(nodes)
        done = F.col("level") == (tier + 1) * TIER
        level = nodes.where(done & ~F.col("is_root")).select("tree", "index", "leaves", "digest")
    roots = reduce(DataFrame.unionByName, tiers).where("is_root").select("tree", "leaves", "digest")
    return Forest(tiers, shared_table(roots, "merkle-roots"))


def paths(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[tuple]:
    """For every row that asks, its digest and the siblings left and right of its way up, and its block's header.

    A block's rows come as its header, which holds the way from the block's root on, then its range of the log,
    then the rows that ask. Holds one block.
    """
    header, held, runs = None, {}, {}
    for kind, tree, _, at, leaves, digest, lefts, rights, subroot, root, row_id, forged in rows_of(batches):
        if kind == HEADER:
            header, held, runs = (lefts, rights, subroot, root), {}, {}
        elif kind == NODE:
            held[at] = digest.hex()
        else:
            left, right, index, count, own = [], [], at, -(-leaves // ARITY**base), None
            for level in range(base, base + TIER):
                if count == 1:
                    break
                first = index - index % ARITY
                run = runs.get((level, first))
                if run is None:
                    members = range(first, min(first + ARITY, count))
                    run = runs[level, first] = [held[position(level, i, leaves)] for i in members]
                own = own or run[index - first]
                left.append("".join(run[: index - first]))
                right.append("".join(run[index - first + 1:]))
                index, count = index // ARITY, -(-count // ARITY)
            own = own or held[position(base, at, leaves)]
            yield tree, at, leaves, own, left + header[0], right + header[1], header[2], header[3], row_id, forged


def lower_paths(base: int):
    schema = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("leaves", pa.int64()),
                        ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())),
                        ("subroot", pa.string()), ("root", pa.string())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Output(schema)
        for tree, index, leaves, _, left, right, subroot, root, *_ in paths(batches, base):
            yield from out.add(tree, index, leaves, left, right, subroot, root)
        yield from out.flush()

    return extract


def fold(leaf: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(lefts, rights):
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    out = Output(pa.schema([("id", pa.int64()), *[(n, pa.string()) for n in names[1:]]]))
    for _, _, _, own, left, right, subroot, root, row_id, forged in paths(batches, 0):
        proof = hashlib.sha256("".join(p for pair in zip(left, right) for p in pair).encode()).hexdigest()
        used = own if forged is None else forged.hex()
        yield from out.add(row_id, own, subroot, root, proof, fold(used, left, right))
    yield from out.flush()


def blocks_of(forest: Forest, tier: int, headers: DataFrame, asking: DataFrame) -> DataFrame:
    """Headers, log ranges and asking rows of a tier, dealt by block and sorted as :func:`paths` reads them."""
    base = tier * TIER
    # The tier's input nodes were logged by the tier below, as its highest level.
    logs = forest.tiers[max(0, tier - 1): tier + 1]
    nodes = reduce(DataFrame.unionByName, logs).where(F.col("level").between(base, base + TIER - 1))
    # Trees that ended below have no node here but perhaps their root.
    nodes = nodes.where(F.col("leaves") > ARITY**base) if tier else nodes
    width = F.pow(F.lit(float(ARITY)), F.lit(base + TIER) - F.col("level"))
    empty, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    parts = [
        headers.select(F.lit(HEADER).alias("kind"), "tree", "block", F.lit(0).cast("long").alias("at"), "leaves",
                       F.lit(None).cast("binary").alias("digest"), "lefts", "rights", "subroot", "root",
                       F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("forged")),
        nodes.select(F.lit(NODE).alias("kind"), "tree", F.floor(F.col("index") / width).alias("block"),
                     F.col("position").alias("at"), "leaves", "digest", none.alias("lefts"), none.alias("rights"),
                     empty.alias("subroot"), empty.alias("root"), F.lit(None).cast("long").alias("id"),
                     F.lit(None).cast("binary").alias("forged")),
        asking.select(F.lit(LEAF).alias("kind"), "tree", F.floor(F.col("index") / F.lit(BLOCK)).alias("block"),
                      F.col("index").alias("at"), "leaves", F.lit(None).cast("binary").alias("digest"),
                      none.alias("lefts"), none.alias("rights"), empty.alias("subroot"), empty.alias("root"),
                      "id", "forged"),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "at")


def read_proofs(forest: Forest, headers: DataFrame, asking: DataFrame, final, schema: str) -> DataFrame:
    """``final`` over all leaves of a forest, whose trees' roots go on as ``headers`` says.

    ``headers`` has ``tree``, ``leaves``, ``lefts``, ``rights``, ``subroot`` and ``root``. From the highest tier down, the way
    of each block's root is read from the tier above.
    """
    ends = headers.withColumn("_tier", F.lit(0))
    for tier in range(1, len(forest.tiers)):
        ends = ends.withColumn("_tier", F.when(F.col("leaves") > BLOCK**tier, tier).otherwise(F.col("_tier")))
    ends = shared_table(ends, "merkle-ends")
    above: DataFrame | None = None
    for tier in reversed(range(len(forest.tiers))):
        here = ends.where(F.col("_tier") == tier).withColumn("block", F.lit(0).cast("long")).drop("_tier")
        if above is not None:
            here = here.unionByName(above.withColumnRenamed("index", "block"))
        if tier == 0:
            return blocks_of(forest, 0, here, asking).mapInArrow(final, schema)
        base = tier * TIER
        nodes = forest.tiers[tier - 1].where(F.col("level") == base).where(F.col("leaves") > ARITY**base)
        nodes = nodes.select("tree", "index", "leaves", F.lit(None).cast("long").alias("id"),
                             F.lit(None).cast("binary").alias("forged"))
        above = shared_table(blocks_of(forest, tier, here, nodes).mapInArrow(lower_paths(base), PATH_SCHEMA), "merkle-paths")
    raise AssertionError("a forest has a tier")


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS,
             changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, its ``leaf``, the ``subroot`` of its group, the ``root``, the digest of
    its proof, the root that its leaf folds to, and whether they are equal (``verified``).

    A leaf covers ``fields``. For the check of rows that meet ``where``, the fields named in ``changed`` are taken
    from its columns instead, as if someone had altered the table since; all siblings stay the original ones.

    A missing group is a group, the first one; a row without ``order`` comes first in its group and is not
    altered by a condition on it. Rows with the same ``order`` follow in the order of their leaves; rows repeated in full
    have a leaf each. An empty table gives no row. Other columns are not read.
    """
    now = [F.col(f"`{c}`") for c in fields]
    later = [(changed or {}).get(c, F.col(f"`{c}`")) for c in fields]
    forged = F.when(F.coalesce(where, F.lit(False)) if where is not None else F.lit(changed is not None), leaf_digest(later))
    hashed = shared_table(docs.select(
        F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{order}`").cast("long").alias("id"),
        leaf_digest(now).alias("digest"), forged.alias("forged"),
    ), "merkle-leaves")
    leaves = shared_table(ranked(hashed, ["tree"], ["id", "digest", "forged"], "index", "leaves"), "merkle-ranked")
    trees = grow(leaves)

    # The groups' roots are the leaves of the tree over them.
    groups = shared_table(ranked(trees.roots.select("tree", "digest"), [], ["tree"], "index", "groups"), "merkle-groups")
    top = grow(groups.select(F.lit("").alias("tree"), "index", F.col("groups").alias("leaves"), "digest"))
    root = F.lower(F.hex("digest"))
    nothing = F.array().cast("array<string>")
    ways = read_proofs(
        top,
        top.roots.select("tree", "leaves", nothing.alias("lefts"), nothing.alias("rights"),
                         root.alias("subroot"), root.alias("root")),
        groups.select(F.lit("").alias("tree"), "index", F.col("groups").alias("leaves"),
                      F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("forged")),
        lower_paths(0), PATH_SCHEMA,
    ).select("index", "lefts", "rights", "root")
    # A group's root, its size and its way through the tree above.
    sized = join_null_safe(groups.select("tree", "index", "digest"), trees.roots.select("tree", "leaves"), ["tree"], "inner")
    headers = sized.join(shared_table(ways, "merkle-ways"), "index").select(
        "tree", "leaves", "lefts", "rights", root.alias("subroot"), "root"
    )
    out = read_proofs(trees, headers, leaves.select("tree", "index", "leaves", "id", "forged"), checked, PROOF_SCHEMA)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(name: str = "text") -> dict[str, Column]:
    """The alteration that only lower-cases A-Z of one column."""
    return {name: lower_ascii(F.col(f"`{name}`").cast("string"))}
