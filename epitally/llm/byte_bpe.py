"""Byte-level BPE: whole matrices of pieces are merged at once, and ids are decoded back."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_groups

NO_PAIR = np.iinfo(np.int32).max
# Pieces of more bytes than this are merged through a heap: a matrix would take a round per merge.
LONGEST_ROW = 512
CELLS = 1 << 18
CHARS_AT_ONCE = 500_000
MOST_CACHED = 250_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Open-addressing table from a pair of ids to the id of their merge: keys, values, shift."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[(left << 32) | right] = rank
    bits = max(4, (4 * len(pairs)).bit_length())
    keys = np.full(1 << bits, np.uint64(2**64 - 1))
    values = np.full(1 << bits, NO_PAIR, np.int32)
    wanted = np.fromiter(pairs.keys(), np.uint64, len(pairs))
    merged = np.fromiter(pairs.values(), np.int32, len(pairs))
    shift = 64 - bits
    slots = (wanted * MULTIPLIER) >> np.uint64(shift)
    mask = np.uint64((1 << bits) - 1)
    while len(wanted):
        free = keys[slots] == np.uint64(2**64 - 1)
        _, first = np.unique(slots, return_index=True)
        take = np.zeros(len(slots), bool)
        take[first] = True
        take &= free
        keys[slots[take]], values[slots[take]] = wanted[take], merged[take]
        wanted, merged, slots = wanted[~take], merged[~take], (slots[~take] + np.uint64(1)) & mask
    return keys, values, shift


def latin_form(pattern: str) -> str | None:
    """The pattern with letters, numbers and blanks spelt out for characters below 256.

    On such text the standard library's faster engine then splits alike. None if the pattern uses
    another class.
    """
    chars = [chr(c) for c in range(256)]
    classes = {
        r"\p{L}": "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "L"),
        r"\p{N}": "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "N"),
        r"\s": r"\t-\r \x85\xa0",
    }
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part == r"\S" and not inside:
            out.append(f"[^{classes[r'\s']}]")
        elif part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        elif part[0] == "\\":
            return None
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


class Places(dict):
    """Gives each new piece the next number and remembers it as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        self.new.append(piece)
        return place


class PieceCache:
    """Ids of pieces met before, in one flat array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places = Places()
        self.flat, self.sizes, self.begins = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the pieces that are new in ``places``."""
        self.places.new = []
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def ids(self, places: np.ndarray) -> np.ndarray:
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        steps = np.repeat(self.begins[places] - (ends - sizes), sizes)
        return self.flat[steps + np.arange(len(steps))]


class BytePairs:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray, int] | None = None):
        self.ranks = ranks
        self.pattern = pattern
        self.keys, self.values, self.shift = pairs or pair_table(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id two neighbours merge into, else NO_PAIR; ids below 0 are padding."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        slot = (key * MULTIPLIER) >> np.uint64(self.shift)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NO_PAIR)
        empty, mask = np.uint64(2**64 - 1), np.uint64(len(self.keys) - 1)
        left_over = np.flatnonzero((found != key) & (found != empty))
        while len(left_over):
            slot[left_over] = (slot[left_over] + np.uint64(1)) & mask
            found = self.keys[slot[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (found != empty)]
        out[(left < 0) | (right < 0)] = NO_PAIR
        return out

    def merge_matrix(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of pieces of at most ``width`` bytes: places in the list, padded rows of ids, their lengths.

        Rows are padded to the width. Each round merges the leftmost pair of least rank in every row and
        closes the gap, so the matrix loses a column; rows without a pair are taken out.
        """
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = self.byte_ids[np.array(pieces, f"S{width}").view(np.uint8).reshape(n, width)]
        ids[np.arange(width) >= lengths[:, None]] = -1
        places = np.full((n, width), NO_PAIR, np.int32)
        if width > 1:
            places[:, :-1] = self.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        while len(rows):
            at = places.argmin(axis=1)
            line = np.arange(len(rows))
            best = places[line, at]
            done = best == NO_PAIR
            if done.any():
                yield rows[done], ids[done], lengths[done]
                more = ~done
                rows, lengths, ids, places = rows[more], lengths[more], ids[more], places[more]
                at, best = at[more], best[more]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = best
            behind = np.arange(ids.shape[1] - 1) > at[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            places = np.where(behind, places[:, 1:], places[:, :-1])
            lengths = lengths - 1
            last = ids.shape[1] - 1
            after = np.where(at < last, ids[line, np.minimum(at + 1, last)], -1)
            places[line, at] = self.merged(best, after)
            before = at > 0
            if before.any():
                i, j = line[before], at[before]
                places[i, j - 1] = self.merged(ids[i, j - 1], best[before])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece: a heap gives the leftmost pair of least rank."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.merged(ids[:-1], ids[1:])
        values, after = ids.tolist(), list(range(1, len(ids) + 1))
        before, end = list(range(-1, len(ids) - 1)), len(ids)
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r != NO_PAIR]
        heapify(heap)
        rank_at = dict((i, r) for r, i in heap)
        tokens, known = self.tokens, self.ranks

        def renew(i: int) -> None:
            rank_at.pop(i, None)
            if i >= 0 and after[i] < end:
                rank = known.get(tokens[values[i]] + tokens[values[after[i]]])
                if rank is not None:
                    rank_at[i] = rank
                    heappush(heap, (rank, i))

        while heap:
            rank, i = heappop(heap)
            if rank_at.get(i) != rank:
                continue
            gone = after[i]
            values[i], values[gone] = rank, -1
            rank_at.pop(gone, None)
            after[i] = after[gone]
            if after[i] < end:
                before[after[i]] = i
            renew(i)
            renew(before[i])
        return np.array([v for v in values if v >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, piece after piece, and how many each piece has."""
        sizes = np.ones(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ranks = list(map(self.ranks.get, pieces))
        whole = np.array([r is not None for r in ranks], bool)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        widths[whole], widths[~whole & (lengths > LONGEST_ROW)] = 0, -1
        known = np.flatnonzero(whole)
        parts.append((known, np.array([ranks[i] for i in known.tolist()], np.int32)[:, None], sizes[known]))
        for i in np.flatnonzero(widths == -1).tolist():
            ids = self.merge_long(pieces[i])
            parts.append((np.array([i]), ids[None, :], np.array([len(ids)])))
        for width in np.unique(widths[widths > 0]).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, CELLS // width)
            for s in range(0, len(members), step):
                part = members[s: s + step]
                for rows, ids, n in self.merge_matrix([pieces[i] for i in part.tolist()], width):
                    parts.append((part[rows], ids, n))
        for at, _, n in parts:
            sizes[at] = n
        begins = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        for at, ids, n in parts:
            column = np.arange(ids.shape[1])
            used = column < n[:, None]
            flat[(begins[at][:, None] + column)[used]] = ids[used]
        return flat, sizes

    def encode_texts(self, texts: list[str], cache: PieceCache) -> Iterator[np.ndarray]:
        """Ids of each text; pieces in the cache are not merged again."""
        any_text, latin = regex.compile(self.pattern).findall, latin_form(self.pattern)
        latin_text = re.compile(latin).findall if latin else None

        def split(text: str) -> list[str]:
            if latin_text is not None:
                try:
                    text.encode("latin-1")
                    return latin_text(text)
                except UnicodeEncodeError:
                    pass
            return any_text(text)

        for begin, end in text_groups(texts, CHARS_AT_ONCE):
            if len(cache.places) > MOST_CACHED:
                cache.clear()
            where = cache.places.__getitem__
            places = []
            for text in texts[begin:end]:
                parts = split(text)
                places.append(np.fromiter(map(where, parts), np.int64, len(parts)))
            new = cache.places.new
            if new:
                cache.add(*self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]))
            for parts in places:
                yield cache.ids(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def byte_pairs(spark: SparkSession, path: str, pattern: str):
    """What a :class:`BytePairs` is made of, sent to every executor once; a vocabulary's size is fixed."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, pattern, pair_table(ranks)))


def encoded(docs: DataFrame, pairs, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows with the ids of the whole text as a further column; a null text has none.

    A column of the input named like the new one is replaced.
    """

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, cache = BytePairs(*pairs.value), PieceCache()
        for texts in batches:
            yield pd.Series(list(table.encode_texts(texts.tolist(), cache)), dtype=object)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    as_ids = F.pandas_udf(encode, "array<int>")
    return docs.withColumn(ids_col, as_ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def coded(docs: DataFrame, pairs, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns but the text, then the ids of the whole text and the bytes that the ids decode to.

    One pass by one worker, which holds the results of about ``CHARS_AT_ONCE`` characters, or of one longer text.
    A null text is empty; columns of the input named like the new ones are replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in (text_col, ids_col, bytes_col)]
    names = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = BytePairs(*pairs.value), PieceCache()
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for s, e in text_groups(texts, CHARS_AT_ONCE):
                ids = list(table.encode_texts(texts[s:e], cache))
                bounds = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(s, e - s) for i in range(len(names))],
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids), pa.int32())),
                    pa.array(map(table.decode, ids), pa.binary()),
                ], names=[*names, "ids", "bytes"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, fields)], text.alias("text"))
    return rows.mapInArrow(code, schema).select(
        *[F.col(n).alias(f.name) for n, f in zip(names, fields)], F.col("ids").alias(ids_col), F.col("bytes").alias(bytes_col)
    )


def decoded(pairs, ids: Column) -> Column:
    """The bytes that ids stand for; null ids give none."""

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = BytePairs(*pairs.value)
        for column in batches:
            yield pd.Series([None if ids is None else table.decode(ids) for ids in column], dtype=object)

    decode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(decode, "binary")(ids)
