"""Helpers shared by the operators: written tables, text and key columns, batches of text."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"
FILTER_BITS = 1 << 25


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a compressed table in the shared folder.

    The plan is cut there, so what follows never repeats the work and a lost executor costs
    only its running tasks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc`` (0 for a missing id), ``no_id``, ``version`` and ``text``, none of them null.

    ``version`` is a hash of the text: it tells rows with the same id and other texts apart.
    """
    return docs.select(*key_columns(id_col, text_col), text_or_empty(text_col).alias("text"))


def key_columns(id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("doc"),
        F.col(id_col).isNull().alias("no_id"),
        F.xxhash64(text_or_empty(text_col)).alias("version"),
    ]


def doc_id() -> Column:
    return F.when(~F.col("no_id"), F.col("doc")).alias("doc_id")


def among(asked: DataFrame, version: str) -> Column:
    """Whether a version may be among those that ``asked`` names; a fixed number of bits says so."""
    wanted = asked.sparkSession.sparkContext.broadcast(_version_filter(asked))

    def found(versions: pd.Series) -> pd.Series:
        bitmap, at = wanted.value, versions.to_numpy().view(np.uint64) & np.uint64(FILTER_BITS - 1)
        return pd.Series((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1)

    found.__annotations__ = {"versions": pd.Series, "return": pd.Series}
    return F.pandas_udf(found, "boolean")(version)


def _version_filter(asked: DataFrame) -> np.ndarray:
    """Bits of the versions named, built by Spark in blocks of 4 KB."""
    slot = F.pmod("version", F.lit(FILTER_BITS)) + 1
    blocks = asked.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, bits in blocks.collect():
        out[(block - 1) * 4096: block * 4096] = np.frombuffer(bits, np.uint8)
    return out


def as_numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def batches_or_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """All batches with rows, then none: what was held back is complete."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def text_groups(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` characters; a longer text stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)
