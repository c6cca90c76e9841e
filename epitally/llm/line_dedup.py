"""Lines that many documents share, found in one sorted stream and returned as keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, as_numpy, key_columns, keyed, lower_ascii, shared_table

MIN_DOCS = 10
MIN_CHARS = 1

# What a streamed row says: the line goes; its key touches an end of the partition and is not
# decided there; how many documents such a key has in the partition.
DROP, OPEN, EDGE = 0, 1, 2

STREAM_SCHEMA = "kind int, h1 long, h2 long, doc long, no_id boolean, version long, pos int, docs long"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: 128 bits of its key, document, position."""
    lines = keyed(docs, id_col, text_col).select(
        "doc", "no_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keys = lines.select("doc", "no_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "no_id", "version", "pos"
    )


def repeated_lines(min_docs: int):
    """Stream rows sorted by key, document and position; count first occurrences per document.

    Memory is bounded: rows of a key are held only until it has ``min_docs`` documents. The keys
    at both ends of the stream may go on in the next partition, so their counts are reported.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, part: list[np.ndarray]) -> pa.RecordBatch:
            n = len(part[0])
            arrays = [pa.array(np.full(n, kind, "int32")), *map(pa.array, part), pa.nulls(n, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def edge() -> pa.RecordBatch:
            values = [EDGE, *key, 0, False, 0, 0, count]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        names = "kind h1 h2 doc no_id version pos docs".split()
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]
        key, last, count, first, held = None, None, 0, True, []

        def close() -> Iterator[pa.RecordBatch]:
            """End the open run when another key follows."""
            if first:
                yield edge()
                for part in held:
                    yield rows(OPEN, part)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [as_numpy(batch.column(n)) for n in names[1:7]]
            h1, h2, doc, no_id = cols[:4]
            starts_key = np.ones(len(h1), bool)
            starts_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts_key[0] = key != (h1[0], h2[0])
            starts_doc = starts_key.copy()
            starts_doc[1:] |= (doc[1:] != doc[:-1]) | (no_id[1:] != no_id[:-1])
            starts_doc[0] |= last != (doc[0], no_id[0])
            begins = np.flatnonzero(starts_key)
            if not starts_key[0]:
                begins = np.concatenate([[0], begins])
            elif key is not None:
                yield from close()
                first, held, count = False, [], 0
            counts = np.add.reduceat(starts_doc.astype("int64"), begins)
            counts[0] += count
            ends = np.append(begins[1:], len(h1))

            # The first run here may have begun in an earlier batch.
            key, count = (h1[0], h2[0]), int(counts[0])
            head = [c[: ends[0]] for c in cols]
            if count >= min_docs:
                for part in [*held, head]:
                    yield rows(DROP, part)
                held = []
            else:
                held.append(head)
            if len(begins) > 1:
                yield from close()
                first, held = False, []
                inner = np.repeat(counts[1:-1] >= min_docs, ends[1:-1] - begins[1:-1])
                if inner.any():
                    yield rows(DROP, [c[ends[0]: begins[-1]][inner] for c in cols])
                tail = [c[begins[-1]:] for c in cols]
                key, count = (h1[-1], h2[-1]), int(counts[-1])
                if count >= min_docs:
                    yield rows(DROP, tail)
                else:
                    held = [tail]
            last = (doc[-1], no_id[-1])
        if key is not None:
            first = True
            yield from close()

    return stream


def packed(positions: np.ndarray) -> bytes:
    """Compressed bits, one per line up to the last dropped one; a set bit keeps its line."""
    bits = np.ones(8 * (int(positions.max()) // 8 + 1), np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def dropped_positions(bitmap: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return np.flatnonzero(bits == 0)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc``, ``no_id``, ``version`` and ``bitmap`` of each document that loses lines.

    A line goes from every document when its key has ``min_chars`` code points and occurs in
    ``min_docs`` documents. Documents are told apart by their id; a missing id is one of its own.
    Keys are range-partitioned together with the document, so a key in a third of all documents
    is spread over partitions, and its count is the sum of theirs.
    """
    hashes = shared_table(line_hashes(docs, id_col, text_col, min_chars), "lines")
    ranged = hashes.repartitionByRange("h1", "h2", "no_id", "doc").sortWithinPartitions(
        "h1", "h2", "no_id", "doc", "version", "pos"
    )
    found = shared_table(ranged.mapInArrow(repeated_lines(min_docs), STREAM_SCHEMA), "repeats")
    # At most two keys of each partition, hence broadcast.
    spread = found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
    late = found.where(F.col("kind") == OPEN).join(
        F.broadcast(spread.where(F.col("docs") >= min_docs)), ["h1", "h2"], "left_semi"
    )
    gone = found.where(F.col("kind") == DROP).select("doc", "no_id", "version", "pos").union(
        late.select("doc", "no_id", "version", "pos")
    )

    @F.pandas_udf("binary")
    def pack(positions: pd.Series) -> pd.Series:
        return positions.map(packed)

    return gone.groupBy("doc", "no_id", "version").agg(F.collect_list("pos").alias("gone")).select(
        "doc", "no_id", "version", pack("gone").alias("bitmap")
    )


KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                     T.StructField("kept", T.StringType())])


@F.pandas_udf(KEPT)
def without_dropped(texts: pd.Series, bitmaps: pd.Series) -> pd.DataFrame:
    out = []
    for text, bitmap in zip(texts, bitmaps):
        lines = text.split("\n")
        n, gone = len(lines), 0
        if bitmap is not None:
            places = dropped_positions(bitmap)
            gone = len(places)
            for i in places[::-1].tolist() if gone < 50 else ():
                del lines[i]
            if gone >= 50:
                left = np.ones(n, bool)
                left[places] = False
                lines = [lines[i] for i in np.flatnonzero(left).tolist()]
            text = "\n".join(lines)
        out.append((n, gone, text))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                        min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows as struct ``row`` with ``n_lines``, ``n_dropped`` and the text left, ``kept``.

    A null text is one empty line. Rows repeated in full get the same result each and count as one
    document; a document whose lines all go keeps an empty text. Other columns never clash, as
    they stay inside ``row``.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *key_columns(id_col, text_col))
    joined = rows.join(bitmaps, ["doc", "no_id", "version"], "left")
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    return joined.select("row", without_dropped(text, "bitmap").alias("r")).select(
        "row", "r.n_lines", "r.n_dropped", "r.kept"
    )
