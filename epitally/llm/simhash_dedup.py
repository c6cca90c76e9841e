"""Near-duplicate documents by SimHash, found through an inverted index over the bytes of fingerprints.

Two fingerprints of eight bytes that differ in at most two bits share at least six bytes at
their positions. Cut into four pairs of positions, at most two pairs hold a difference, so two
pairs, four positional bytes, are shared whole. The index therefore keeps, for each of the six
ways to take two pairs, one posting list per value of the four bytes: lists of single bytes
would each hold a 256th of all documents and their pairs would grow with the square. Within a list
the shared positional bytes of each pair are tallied; pairs below six are dropped, the rest verified
by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_id, key_columns, keyed, shared_table
from .components import components

WORDS = 3
MOST_BITS = 2
SEED = 42

BYTES = 8
# Positional bytes that fingerprints within the bits share at least.
MIN_SHARED = BYTES - MOST_BITS
PAIRS_OF_POSITIONS = [(0, 1), (2, 3), (4, 5), (6, 7)]
BLOCKS = [a + b for a, b in combinations(PAIRS_OF_POSITIONS, 2)]

# Lists up to this length are tallied pair by pair in one task; longer ones go through `ball_edges`.
MOST_TALLIED = 2048


def simhash(text: str, words: int = WORDS) -> int:
    """The fingerprint of a whole text, unsigned.

    A-Z is lower-cased, words are split at blanks, shingles are ``words`` words joined by a space and
    count as often as they occur. A text with fewer words is one shingle, without words it gives 0.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        starts, ends = [0], [len(line)]
    else:
        starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
        ends = ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = hashes[i: i + (1 << 14)].view(np.uint8).reshape(-1, BYTES)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The key columns of each document and ``fp``, its fingerprint as a signed long."""

    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))

    rows = keyed(docs, id_col, text_col)
    return rows.select("doc", "no_id", "version", F.pandas_udf(fingerprint, T.LongType())("text").alias("fp"))


def _positional(fp, positions):
    """The bytes of a fingerprint column at some positions, as one long."""
    out = F.lit(0).cast("long")
    for place, position in enumerate(positions):
        byte = F.shiftrightunsigned(fp, 8 * position).bitwiseAND(255)
        out = out.bitwiseOR(F.shiftleft(byte, 8 * place))
    return out


def postings(prints: DataFrame) -> DataFrame:
    """``block``, ``value`` and ``fp``: a row per fingerprint and set of four byte positions."""
    fp = F.col("fp")
    blocks = [F.struct(F.lit(i).alias("block"), _positional(fp, p).alias("value")) for i, p in enumerate(BLOCKS)]
    return prints.select("fp", F.explode(F.array(*blocks)).alias("b")).select("b.block", "b.value", "fp")


def tallied_links(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links of one posting list: pairs with enough shared positional bytes and few differing bits.

    Returned are enough of them to connect what all of them connect, at most one per fingerprint.
    """
    cols = fps.view(np.uint64)
    bytes_ = cols.view(np.uint8).reshape(-1, BYTES)
    root = list(range(len(cols)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(len(cols) - 1):
        shared = (bytes_[i + 1:] == bytes_[i]).sum(axis=1, dtype=np.int8)
        likely = np.flatnonzero(shared >= BYTES - most_bits) + i + 1
        for j in likely[np.bitwise_count(cols[likely] ^ cols[i]) <= most_bits].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(fps[i]), int(fps[j])))
    return links


def index_edges(prints: DataFrame, most_bits: int = MOST_BITS, most_tallied: int = MOST_TALLIED) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct fingerprints which differ in ``most_bits`` or fewer."""
    index = shared_table(postings(prints), "postings")
    sizes = index.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = shared_table(index.join(sizes, ["block", "value"]), "listed")
    lists = listed.where(F.col("n") <= most_tallied).groupBy("block", "value").agg(
        F.sort_array(F.collect_list("fp")).alias("fps")
    )

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            values, bounds = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
            links = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                links += tallied_links(values[s:e], most_bits)
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    tallied = lists.select("fps").mapInArrow(tally, "a long, b long")
    return tallied.union(ball_edges(listed.where(F.col("n") > most_tallied), most_bits))


def ball_edges(listed: DataFrame, most_bits: int) -> DataFrame:
    """The same links for posting lists of any length, without pairing their members.

    Fingerprints that differ in two bits or fewer both lie within one flipped bit of some
    value, and fingerprints that do differ by two at most. So each is sent to all values within one bit, among
    the bits outside the list's own bytes; those that meet are linked to the least. At most 33 meet.
    """
    if most_bits != 2:
        raise ValueError("long posting lists are linked for two differing bits")
    fp = F.col("fp")
    flips = F.lit(None).cast("array<long>")
    for block, positions in enumerate(BLOCKS):
        bits = [1 << b for p in range(BYTES) if p not in positions for b in range(8 * p, 8 * p + 8)]
        signed = [b - (1 << 64) if b >= 1 << 63 else b for b in bits]
        flips = F.when(F.col("block") == block, F.array(*[F.lit(b).cast("long") for b in [0, *signed]])).otherwise(flips)
    near = listed.select("block", "fp", F.explode(F.transform(flips, lambda b: fp.bitwiseXOR(b))).alias("near"))
    met = near.groupBy("block", "near").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")


def _rooted(prints: DataFrame, most_bits: int) -> DataFrame:
    """A row per distinct fingerprint: ``fp``, its component's ``root``, its ``least`` id and ``first`` row.

    Documents with equal fingerprints are one node, so copies cost nothing.
    """
    nodes = shared_table(prints.groupBy("fp").agg(
        F.min(F.when(~F.col("no_id"), F.col("doc"))).alias("least"),
        F.min(F.struct("no_id", "doc", "version")).alias("first"),
    ), "nodes")
    linked = components(index_edges(nodes.select("fp"), most_bits))
    return nodes.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest id reachable over links), a row per document.

    A null text is empty. Rows with the same id each keep their fingerprint; a missing id stays missing
    and names no component unless all ids of the component are missing.
    """
    prints = shared_table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    rooted = _rooted(prints, most_bits)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(doc_id(), "fp", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  most_bits: int = MOST_BITS) -> DataFrame:
    """One row of each component, as it is: the one with the smallest id, missing ids last.

    Of other texts under this id the one with the smallest hash stays, of equal rows any one.
    """
    prints = shared_table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    chosen = _rooted(prints, most_bits).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_columns(id_col, text_col))
    keys = ["doc", "no_id", "version"]
    return rows.join(chosen, keys, "left_semi").dropDuplicates(keys).select("row.*")
