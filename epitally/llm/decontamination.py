"""Benchmark items inside documents: size-partitioned MinHash sketches propose, exact shingles decide.

An item of q shingles that a document contains to a share t leaves out at most (1 - t) q of them.
So of any floor((1 - t) q) + 1 of its shingles at least one is in the document, also of those with
the smallest hashes. Items are partitioned by size in powers of two; each partition's sketch holds the
smallest hashes, as many as its largest size needs. A document that holds no shingle of any sketch
contains no item, however long it is, and a hit can't be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_columns, shared_table

WORDS = 5
CONTAINMENT = 0.8
# Bits of the filters that go to every task: 4 MB each, whatever the number of items.
FILTER_BITS = 1 << 25
BITMAP_BITS = 32768


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Runs of ``words`` words, A-Z lower-cased, split at blanks, joined by a space.

    Fewer words are one shingle; a text without words has none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [line]
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return [line[s:e] for s, e in zip(starts, ends[words - 1:].tolist())]


def item_shingles(items: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``item_id`` (the smallest of equal items), ``n_items``, ``n_shingles`` and the distinct ``shingles``."""

    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({s.decode("utf-8", "surrogatepass") for s in shingles(t, words)}))

    found = items.select(
        F.col(id_col).cast("long").alias("id"),
        F.pandas_udf(split, T.ArrayType(T.StringType()))(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        .alias("shingles"),
    )
    return found.where(F.size("shingles") > 0).groupBy("shingles").agg(
        F.min("id").alias("item_id"), F.count(F.lit(1)).alias("n_items")
    ).withColumn("n_shingles", F.size("shingles"))


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """``h``: the hashes that stand for each item, those of its size partition's number."""
    largest = F.pow(2.0, F.floor(F.log2(F.col("n_shingles").cast("double"))) + 1) - 1
    number = F.floor(largest * (1 - containment) + 1e-9).cast("int") + 1
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    return items.select(F.explode(F.slice(hashes, 1, number)).alias("h"))


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with those of the hashes set, built by Spark in blocks of 4 KB."""
    slot = F.pmod("h", F.lit(FILTER_BITS)) + 1
    blocks = hashes.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, bits in blocks.collect():
        at = (block - 1) * BITMAP_BITS // 8
        out[at: at + BITMAP_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


def set_bits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes & np.uint64(FILTER_BITS - 1)
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", words: int = WORDS,
                    containment: float = CONTAINMENT) -> DataFrame:
    """A row per document and distinct item it contains to the given share, with the document's key columns.

    Columns ``doc``, ``no_id``, ``version``, ``item_id``, ``n_items`` (items with these shingles),
    ``n_shared``, ``n_shingles`` (distinct, of the item) and ``containment``. An item with fewer words than
    a shingle is found only where it is the whole document. Empty items and texts match nothing; repeated
    documents give their rows each.
    """
    spark = docs.sparkSession
    items = shared_table(item_shingles(items, item_id, item_text, words), "items")
    wanted = spark.sparkContext.broadcast(bit_filter(sketches(items, containment)))
    each = items.select("item_id", "n_items", "n_shingles", F.explode("shingles").alias("shingle"))
    members = spark.sparkContext.broadcast(bit_filter(each.select(F.xxhash64("shingle").alias("h"))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, any_item, digest = wanted.value, members.value, xxhash.xxh64_intdigest
        for batch in batches:
            rows, found, numbers = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = shingles(text, words)
                hashes = np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts))
                if len(parts) and set_bits(sketch, hashes).any():
                    hits = {parts[j] for j in np.flatnonzero(set_bits(any_item, hashes)).tolist()}
                    found += [h.decode("utf-8", "surrogatepass") for h in hits]
                    rows += [i] * len(hits)
            for name in ("row", "doc", "no_id", "version"):
                numbers.append(batch.column(name).take(pa.array(rows, pa.int64())))
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(found, pa.string())],
                                             names=["row", "doc", "no_id", "version", "shingle"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), *key_columns(id_col, text_col),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hits = shared_table(
        texts.mapInArrow(probe, "row long, doc long, no_id boolean, version long, shingle string"), "hits"
    )
    shared = hits.join(each, "shingle").groupBy(
        "row", "doc", "no_id", "version", "item_id", "n_items", "n_shingles"
    ).agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment - 1e-9)).select(
        "doc", "no_id", "version", "item_id", "n_items", "n_shared", F.col("n_shingles").cast("long").alias("n_shingles"),
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """The rows that contain no item, as they are."""
    found = contained_items(docs, items, id_col, text_col, **options).select("doc", "no_id", "version").distinct()
    rows = docs.select(F.struct(*[_quoted(c) for c in docs.columns]).alias("row"), *key_columns(id_col, text_col))
    return rows.join(found, ["doc", "no_id", "version"], "left_anti").select("row.*")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
