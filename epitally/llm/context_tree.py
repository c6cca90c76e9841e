"""Context-tree weighting over bytes: training counts, the weighted tree, and scores of texts.

A byte is eight binary decisions, each at a node named by the bits before it (1 to 255). Every such
node has a tree of contexts, the bytes before, up to a depth. A context's own estimate is
Krichevsky-Trofimov's; weighting mixes, half and half, its estimate with the product of its
children's, at all depths. Block probabilities depend on counts alone, so the counts come from
one distributed aggregation.

Every context that occurs is kept, so the model grows with the corpus and is never in one place. Its nodes are dealt over
buckets by the three bytes before; a bucket holds whole subtrees, and only what their roots weigh, at most 256 * 256
contexts of two bytes with 255 decisions each, is gathered. Texts are cut into chunks: the distinct codes of a
chunk, a byte with the bytes before it, go to their buckets, and their log-probabilities come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_numpy, batches_or_none, shared_table, text_groups

# At most 7, as a code has eight bytes.
DEPTH = 5
# Levels of the tree that are gathered; deeper nodes lie in buckets of about so many codes.
TOP = 2
BUCKET_CODES = 500_000
# Characters of a chunk. A chunk asks once for each of its codes.
CHUNK_CHARS = 32_000_000
# Characters of the parts that a chunk is packed and worked on in.
PART_CHARS = 1_000_000
SMALL_COUNT = 64
# Codes or words of several parts that are held before their repeats go.
MOST_HELD = 1_000_000
# A byte that no UTF-8 text holds: it ends each text and stands before the next one's start.
END = 0xFF
CHARS_AT_ONCE = 500_000
# Words are counted over more text at once: a rare token then has fewer rows.
TOKEN_CHARS = 4_000_000

# The end of a text among the words: no word holds a blank.
END_TOKEN = " "
# Tokens with at least this share of all are looked up in a broadcast table of at most 1 / share rows.
HOT_SHARE = 1 / 65536
MOST_COUNTED = 400_000
# Counted codes that are put by bucket at once.
PACKED = 500_000


def padded(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes with ``depth`` end bytes before each; first positions, lengths with the end."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    gap = bytes([END]) * depth
    buffer = np.frombuffer(gap + b"".join(r + gap for r in raw), np.uint8) if raw else np.zeros(0, np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    firsts = depth + np.concatenate([[0], np.cumsum(lengths - 1 + depth)[:-1]]) if raw else lengths
    return buffer, firsts.astype(np.int64), lengths


def codes(buffer: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """A code per scored byte: the byte in the lowest eight bits, the bytes before it above, nearest lowest."""
    # The eight bytes up to each place, read as one number whose lowest byte is the last.
    behind = np.concatenate([np.zeros(7, np.uint8), buffer])
    code = np.ndarray(len(buffer), ">u8", behind, strides=(1,)).astype(np.uint64)
    code &= np.uint64((1 << 8 * (depth + 1)) - 1)
    # The end byte is scored once per text; the other bytes between texts are not.
    scored = np.ones(len(buffer), bool)
    scored[:depth] = False
    gaps = (firsts + lengths)[:, None] + np.arange(depth - 1)
    scored[gaps.ravel()] = False
    return code[scored]


def context_counts(docs: DataFrame, text: str, depth: int = DEPTH) -> DataFrame:
    """``code`` and ``n``: how often each byte follows each ``depth`` bytes, over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            keys, sums = (np.concatenate(x) for x in zip(*parts))
            # The parts are in order each, which makes a stable sort a merge.
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[firsts], np.add.reduceat(sums[order], firsts)

        def out() -> pa.RecordBatch:
            keys, sums = parts[0]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["code", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s, e in text_groups(texts, CHARS_AT_ONCE):
                found = counted(codes(*padded(texts[s:e], depth), depth))
                parts.append(found)
                held += len(found[0])
                if held > 2 * MOST_COUNTED:
                    parts = [combined()]
                    held = len(parts[0][0])
                    if held > MOST_COUNTED:
                        yield out()
                        parts, held = [], 0
        if parts:
            parts = [combined()]
            yield out()

    partial = docs.select(text).mapInArrow(count, "code long, n long")
    return partial.groupBy("code").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for positive numbers."""
    y = x + 10.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    for i in range(10):
        out -= np.log(x + i)
    return out


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of Krichevsky-Trofimov's block probability of so many zeros and ones."""
    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)

    # Most nodes have few counts, which are looked up.
    few = np.arange(SMALL_COUNT, dtype=float)
    table = of(few[:, None], few[None, :])
    table[0, 0] = 0.0
    small = (zeros < SMALL_COUNT) & (ones < SMALL_COUNT)
    out = np.empty(zeros.shape)
    out[small] = table[zeros[small].astype(np.int64), ones[small].astype(np.int64)]
    out[~small] = of(zeros[~small].astype(float), ones[~small].astype(float))
    return out


def decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes that lead to each code's byte and the bits taken there, a row per code."""
    byte = code & np.uint64(255)
    shifts = np.arange(8, 0, -1, dtype=np.uint64)
    nodes = (np.uint64(1) << (np.uint64(8) - shifts)) | (byte[:, None] >> shifts)
    return nodes, (byte[:, None] >> (shifts - np.uint64(1))) & np.uint64(1)


def node_keys(code: np.ndarray, nodes: np.ndarray, depth: int) -> np.ndarray:
    """The context of ``depth`` bytes before each code, then the node, as one number."""
    context = (code >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return (context[:, None] << np.uint64(8)) | nodes


def parent_keys(keys: np.ndarray, depth: int) -> np.ndarray:
    """The same nodes a level up, at contexts of ``depth`` bytes."""
    return ((keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | (keys & np.uint64(255))


@dataclass
class Level:
    """Nodes of all contexts of one length: counts, the log-probability of their weighted subtree, their own weight."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    weight: np.ndarray

    @classmethod
    def deepest(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> "Level":
        return cls(keys, zeros, ones, kt_block(zeros, ones), np.ones(len(keys)))

    @classmethod
    def above(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> "Level":
        """Half a context's own estimate, half the product of its children's."""
        own = kt_block(zeros, ones)
        weighted = np.logaddexp(own, below) + math.log(0.5)
        return cls(keys, zeros, ones, weighted, np.exp(own + math.log(0.5) - weighted))

    def up(self, depth: int) -> tuple[np.ndarray, ...]:
        """Sums over children: keys, zeros, ones and the log-probabilities of the level of ``depth`` bytes."""
        keys, at = grouped(parent_keys(self.keys, depth))
        return (keys, *(np.bincount(at, x, len(keys)) for x in (self.zeros, self.ones, self.weighted)))


def in_order(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    ordered = np.sort(values)
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    return ordered[begins], np.diff(np.append(begins, len(ordered)))


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    found = pa.array(values.view(np.int64)).dictionary_encode()
    distinct = as_numpy(found.dictionary).view(np.uint64)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[as_numpy(found.indices)]


def lower_levels(code: np.ndarray, n: np.ndarray, depth: int, low: int) -> list[Level]:
    """The levels from ``low`` to ``depth`` over the codes of a bucket and how often they occur."""
    order = np.argsort(code)
    code, times = code[order], n[order].astype(float)
    nodes, bits = decisions(code)
    every = node_keys(code, nodes, depth)
    parts = []
    for step in range(8):
        # Codes in order have the nodes of one step in order.
        begins = np.flatnonzero(np.concatenate([[True], every[1:, step] != every[:-1, step]]))
        parts.append((every[begins, step], np.add.reduceat(times, begins), np.add.reduceat(times * bits[:, step], begins)))
    keys, all_, ones = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    levels = [Level.deepest(keys[order], (all_ - ones)[order], ones[order])]
    for d in range(depth - 1, low - 1, -1):
        levels.append(Level.above(*levels[-1].up(d)))
    return levels[::-1]


def upper_levels(top: tuple[np.ndarray, ...], depth: int) -> list[Level]:
    """The levels from the root to ``depth``, from the summed children of the last."""
    levels = [Level.above(*top)]
    for d in range(depth - 1, -1, -1):
        levels.append(Level.above(*levels[-1].up(d)))
    return levels[::-1]


# Nodes of a level in order, the mixture on the way to each, and what is left for longer contexts.
Path = tuple[np.ndarray, np.ndarray, np.ndarray]


def paths_of(levels: list[Level], first: int, above: Path | None = None) -> list[Path]:
    """Mixtures from the root down to the nodes of each level, of which the first has contexts of ``first`` bytes."""
    out: list[Path] = []
    for d, level in enumerate(levels, first):
        path, left = np.zeros(len(level.keys)), np.ones(len(level.keys))
        if above is not None:
            at = np.searchsorted(above[0], parent_keys(level.keys, d - 1))
            path, left = above[1][at], above[2][at]
        kt = (level.ones + 0.5) / (level.zeros + level.ones + 1.0)
        above = (level.keys, path + left * level.weight * kt, left * (1 - level.weight))
        out.append(above)
    return out


def code_logs(code: np.ndarray, paths: list[Path]) -> np.ndarray:
    """log10 probability of each code's byte after the bytes before it; ``paths`` goes from the root to the full depth.

    The longest context that occurred at a node decides; what it leaves to longer ones has seen nothing and is a half.
    """
    nodes, bits = decisions(code)
    one, open_ = np.full(nodes.shape, 0.5), np.ones(nodes.shape, bool)
    for d in range(len(paths) - 1, -1, -1):
        keys, path, left = paths[d]
        row, column = np.nonzero(open_)
        if not len(keys) or not len(row):
            continue
        wanted = node_keys(code, nodes, d)[row, column]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        one[row[hit], column[hit]] = path[at[hit]] + 0.5 * left[at[hit]]
        open_[row[hit], column[hit]] = False
    return np.log10(np.where(bits == 1, one, 1 - one)).sum(axis=1)


def bucket_of(code, buckets: int):
    """The bucket of a code, as a Column or as numbers: by the three bytes before it."""
    if isinstance(code, Column):
        before = F.shiftright(code, 8).bitwiseAND(F.lit((1 << 8 * (TOP + 1)) - 1))
        return before * F.lit(40_503) % F.lit(1_048_573) % F.lit(buckets)
    before = (code >> np.uint64(8)) & np.uint64((1 << 8 * (TOP + 1)) - 1)
    return (before * np.uint64(40_503) % np.uint64(1_048_573) % np.uint64(buckets)).astype(np.int64)


@dataclass
class ContextTree:
    """Counts of all codes as a table (``bucket``, ``code``, ``n``), and the paths to the gathered levels."""

    depth: int
    buckets: int
    counts: DataFrame
    top: list[Path]


def train(docs: DataFrame, text: str, depth: int = DEPTH, bucket_codes: int = BUCKET_CODES) -> ContextTree:
    """The weighted tree of all whole texts; no texts give a tree that holds all bytes equally likely.

    Counts stay in the shared folder. The driver gets sums for the nodes of the first levels, whose number is
    bounded by 256 ** TOP contexts.
    """
    grams = shared_table(context_counts(docs, text, depth), "grams")
    buckets = max(16, -(-grams.count() // bucket_codes))
    counts = shared_table(grams.select(bucket_of(F.col("code"), buckets).alias("bucket"), "code", "n"), "buckets")
    top_depth = min(TOP, depth - 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, code, n in bucket_rows(batches):
            level = lower_levels(code, n, depth, top_depth + 1)[0]
            keys, zeros, ones, below = level.up(top_depth)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, (zeros, ones, below))],
                                             names=["key", "zeros", "ones", "below"])

    dealt = bucket_lists(counts).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(sums, "key long, zeros double, ones double, below double").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    ).orderBy("key").toArrow()
    top = tuple(as_numpy(found.column(c).combine_chunks()) for c in ("key", "zeros", "ones", "below"))
    levels = upper_levels((top[0].view(np.uint64), *top[1:]), top_depth)
    return ContextTree(depth, buckets, counts, paths_of(levels, 0))


def bucket_lists(counts: DataFrame) -> DataFrame:
    """``bucket`` with its ``codes`` and ``times`` as lists, a row for a bucket's share of some PACKED rows: few rows are dealt."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches_or_none(batches):
            if batch:
                held.append([as_numpy(batch.column(c)) for c in ("bucket", "code", "n")])
                size += batch.num_rows
            if size and (size >= PACKED or batch is None):
                bucket, code, n = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((code, bucket))
                bucket = bucket[order]
                begins, _ = runs(bucket)
                bounds = pa.array(np.array([*begins, len(bucket)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begins]), *(pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in (code, n))],
                    names=["bucket", "codes", "times"])
                held, size = [], 0

    return counts.select("bucket", "code", "n").mapInArrow(pack, "bucket long, codes array<long>, times array<long>")


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Codes and counts of each bucket, from rows sorted by bucket."""
    here, held = None, []
    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != here:
                if held:
                    yield here, *(np.concatenate(x) for x in zip(*held))
                here, held = bucket, []
            held.append((as_numpy(batch.column("codes")[i].values).view(np.uint64), as_numpy(batch.column("times")[i].values)))
    if held:
        yield here, *(np.concatenate(x) for x in zip(*held))


def runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return begins.tolist(), np.append(begins[1:], len(values)).tolist() if len(values) else []


def packed_chunk(texts: list[str], depth: int) -> tuple[bytes, int, np.ndarray]:
    """The padded bytes of some texts, compressed; their number; the length of each text with its end."""
    buffer, _, lengths = padded(texts, depth)
    return pa.compress(buffer.tobytes(), "zstd", asbytes=True), len(buffer), lengths


def raw_texts(blob: bytes, size: int, lengths: np.ndarray, depth: int) -> pa.Array:
    """The texts of a packed part of a chunk."""
    raw = pa.decompress(blob, size, "zstd", asbytes=True)
    begins = depth + np.concatenate([[0], np.cumsum(lengths - 1 + depth)[:-1]])
    return pa.array([raw[b: b + n - 1] for b, n in zip(begins.tolist(), lengths.tolist())], pa.binary()).cast(pa.string())


def unpacked(blob: bytes, size: int, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The codes of a packed part of a chunk, text after text."""
    buffer = np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.uint8)
    firsts = depth + np.concatenate([[0], np.cumsum(lengths - 1 + depth)[:-1]])
    return codes(buffer, firsts.astype(np.int64), lengths, depth)


def distinct_codes(parts: Iterator[np.ndarray]) -> np.ndarray:
    """The distinct codes of some parts, in order."""
    held, size = [np.zeros(0, np.uint64)], 0
    for part in parts:
        held.append(in_order(part))
        size += len(held[-1])
        if size > MOST_HELD:
            held, size = [in_order(np.concatenate(held))], 0
    return in_order(np.concatenate(held))


def in_buckets(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What puts ordered codes by bucket, then code, and the buckets in that order."""
    bucket = bucket_of(code, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def looked_up(code: np.ndarray, values: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The values of a part's codes, each distinct one sought once; ``code`` is in order and holds all of them."""
    own, at = grouped(part)
    return values[np.searchsorted(code, own)][at]


def encoded_words(parts: Iterator[pa.Array]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct words of some parts in the order in which they come; and per part the place of each of its words among
    them and the number of its text."""
    found, owners = [], []
    for texts in parts:
        words, owner = words_of(texts)
        found.append(words.dictionary_encode())
        owners.append(owner.astype(np.int32))
    every = pa.chunked_array(found).unify_dictionaries()
    return every.chunk(0).dictionary, [(as_numpy(x.indices), owner) for x, owner in zip(every.chunks, owners)]


def chunk_scores(chunks: DataFrame, tree: ContextTree, tokens: Tokens) -> DataFrame:
    """A row per text of ``chunks`` with its token sums from ``tokens`` and its log10 probability from ``tree``."""
    depth, buckets = tree.depth, tree.buckets
    top = chunks.sparkSession.sparkContext.broadcast(tree.top)
    first_low = len(tree.top)

    def held_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[np.ndarray], list[tuple]]]:
        """The parts of each chunk and the answers to it, from rows sorted by chunk; holds one chunk, compressed."""
        here, parts, logs, counts = None, [], [], []
        for batch in batches:
            for row in zip(*[batch.column(c) for c in HELD]):
                chunk, kind = row[0].as_py(), row[1].as_py()
                if chunk != here:
                    if parts:
                        yield here, parts, logs, counts
                    here, parts, logs, counts = chunk, [], [], []
                if kind == LOGS:
                    logs.append(as_numpy(row[2].values))
                elif kind == COUNTS:
                    counts.append((as_numpy(row[3].values), as_numpy(row[4].values)))
                else:
                    parts.append((row[5].as_py(), as_numpy(row[6].values), row[7].as_py(), row[8].values, row[9].values))
        if parts:
            yield here, parts, logs, counts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, parts, *_ in held_chunks(batches):
            yield questions(chunk, parts)
            pa.default_memory_pool().release_unused()

    def questions(chunk: int, parts: list[tuple]) -> pa.RecordBatch:
        code = distinct_codes(unpacked(b, z, n, depth) for z, n, b, *_ in parts)
        order, bucket = in_buckets(code, buckets)
        begins, _ = runs(bucket)
        bounds = pa.array(np.array([*begins, len(code)]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[begins]), pa.array(np.full(len(begins), chunk)),
             pa.ListArray.from_arrays(bounds, pa.array(code[order].view(np.int64)))], names=["bucket", "chunk", "codes"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket, counts before questions; a bucket's subtrees and the codes asked for are held."""
        here, code, n, paths = None, [], [], None
        known, known_logs = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            bucket, kind = as_numpy(batch.column("bucket")), as_numpy(batch.column("kind"))
            for begin, end in zip(*runs(bucket * 2 + kind)):
                part = batch.slice(begin, end - begin)
                if bucket[begin] != here:
                    here, code, n, paths = bucket[begin], [], [], None
                    known, known_logs = np.zeros(0, np.uint64), np.zeros(0)
                if kind[begin] == 0:
                    code.append(as_numpy(part.column("codes").flatten()).view(np.uint64))
                    n.append(as_numpy(part.column("times").flatten()))
                    continue
                if paths is None:
                    paths = list(top.value)
                    if code:
                        levels = lower_levels(np.concatenate(code), np.concatenate(n), depth, first_low)
                        paths += paths_of(levels, first_low, paths[-1])
                lists = part.column("codes")
                asked = as_numpy(lists.flatten()).view(np.uint64)
                at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
                new = in_order(asked[known[at] != asked] if len(known) else asked)
                if len(new):
                    both = np.concatenate([known, new])
                    order = np.argsort(both)
                    known, known_logs = both[order], np.concatenate([known_logs, code_logs(new, paths)])[order]
                logs = known_logs[np.searchsorted(known, asked)]
                bounds = pa.array(np.concatenate([[0], np.cumsum(as_numpy(lists.value_lengths()))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("chunk"), part.column("bucket"), pa.ListArray.from_arrays(bounds, pa.array(logs))],
                    names=["chunk", "bucket", "logs"])

    def ask_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = tokens.lookup()[0]
        for chunk, parts, *_ in held_chunks(batches):
            rare = rare_words((raw_texts(b, z, n, depth) for z, n, b, *_ in parts), common)
            for s in range(0, len(rare), MOST_COUNTED):
                part = rare.slice(s, MOST_COUNTED)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(np.arange(s, s + len(part))), part],
                                                 names=["chunk", "place", "token"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk as lists."""
        for batch in batches:
            begins, ends = runs(as_numpy(batch.column("chunk")))
            bounds = pa.array(np.array([*begins, batch.num_rows] if begins else [0]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk").take(pa.array(begins, pa.int64())),
                 *(pa.ListArray.from_arrays(bounds, batch.column(c)) for c in ("place", "c"))], names=["chunk", "places", "times"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = tokens.lookup()
        for _, parts, answers, counts in held_chunks(batches):
            # What a chunk needs goes with the call, before the next one is held.
            yield from chunk_rows(parts, answers, counts, *common)
            pa.default_memory_pool().release_unused()

    def chunk_rows(parts: list[tuple], answers: list[np.ndarray], counts: list[tuple], common: pa.Array, common_logs: np.ndarray,
                   end_log: float) -> Iterator[pa.RecordBatch]:
        by_token = token_columns(parts, counts, common, common_logs, end_log)
        # The codes are made again from each part: the places of all would take four bytes per character.
        code = distinct_codes(unpacked(b, z, n, depth) for z, n, b, *_ in parts)
        logs = np.empty(len(code))
        logs[in_buckets(code, buckets)[0]] = np.concatenate(answers)
        for columns, (size, lengths, blob, ids, held) in zip(by_token, parts):
            values = looked_up(code, logs, unpacked(blob, size, lengths, depth))
            ends = np.cumsum(lengths)
            # Sums of each text on its own, so that a text's score is the same in any company.
            sums = np.array([values[e - n: e].sum() for e, n in zip(ends.tolist(), lengths.tolist())])
            yield pa.RecordBatch.from_arrays([ids, held, *columns, pa.array(sums), pa.array(lengths.astype(np.int64) - 1)],
                                             names=SCORED)

    def token_columns(parts: list[tuple], counts: list[tuple], common: pa.Array, common_logs: np.ndarray,
                      end_log: float) -> list[list[pa.Array]]:
        """Per part, for each of its texts: all tokens, the known ones and the sum of their logarithms."""
        words, words_in = encoded_words(raw_texts(b, z, n, depth) for z, n, b, *_ in parts)
        at_common = pc.index_in(words, common)
        is_rare = as_numpy(pc.is_null(at_common))
        # The rare ones come in the order in which they were asked for.
        seen = np.zeros(int(is_rare.sum()), np.int64)
        for places, times in counts:
            seen[places] = times
        logs, is_known = np.empty(len(words)), np.ones(len(words), bool)
        logs[~is_rare] = common_logs[as_numpy(at_common.drop_null())]
        logs[is_rare], is_known[is_rare] = np.log10((seen + 1) / tokens.total), seen > 0
        out = []
        for (at, owner), (_, lengths, *_) in zip(words_in, parts):
            n = len(lengths)
            out.append([pa.array(np.bincount(owner, minlength=n) + 1),
                        pa.array(np.bincount(owner, is_known[at], minlength=n).astype(np.int64) + int(tokens.ends > 0)),
                        pa.array(np.bincount(owner, logs[at], minlength=n) + end_log)])
        return out

    blank = {c: F.lit(None).cast(t).alias(c) for c, t in HELD.items()}

    def rows(df: DataFrame, kind: int, *named: str) -> DataFrame:
        """Rows with all columns of HELD and the one they are sorted by."""
        order = F.col("bucket") if kind == LOGS else F.col("first") if kind == TEXTS else F.lit(0)
        cells = [F.lit(kind).alias("kind") if c == "kind" else F.col(c) if c in named else blank[c] for c in HELD]
        return df.select(*cells, order.cast("long").alias("order"))

    packed = rows(chunks, TEXTS, "chunk", "size", "lengths", "blob", "ids", "held")
    by_chunk = packed.repartition("chunk").sortWithinPartitions("chunk", "order")
    asked = by_chunk.mapInArrow(ask, "bucket long, chunk long, codes array<long>")
    together = bucket_lists(tree.counts).select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "codes",
                                                "times").unionByName(
        asked.select("bucket", F.lit(1).alias("kind"), "chunk", "codes", F.lit(None).cast("array<long>").alias("times")))
    logs = together.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(
        answer, "chunk long, bucket long, logs array<double>"
    )
    times = by_chunk.mapInArrow(ask_tokens, "chunk long, place long, token string").join(
        tokens.rare, "token"
    ).select("chunk", "place", "c").sortWithinPartitions("chunk").mapInArrow(
        listed, "chunk long, places array<long>, times array<long>"
    )
    everything = packed.unionByName(rows(logs, LOGS, "chunk", "logs")).unionByName(rows(times, COUNTS, "chunk", "places", "times"))
    return everything.repartition("chunk").sortWithinPartitions("chunk", "kind", "order").mapInArrow(score, SCORED_SCHEMA)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, A-Z lower-cased and split at blanks, and the number of each word's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), as_numpy(lists.value_lengths()))
    some = as_numpy(pc.binary_length(words)) > 0
    return words.filter(pa.array(some)), owner[some]


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """``token`` and ``c`` over all whole texts, combined in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = ends = 0

        def combined() -> pa.Table:
            table = pa.concat_tables(parts).group_by("token").aggregate([("c", "sum")])
            return table.select(["token", "c_sum"]).rename_columns(["token", "c"])

        for batch in batches:
            texts = batch.column(0)
            ends += len(texts)
            for s, e in text_groups(texts.to_pylist(), TOKEN_CHARS):
                found = words_of(texts.slice(s, e - s))[0].value_counts()
                parts.append(pa.table({"token": found.field("values"), "c": found.field("counts")}))
                held += len(found)
                if held > 2 * MOST_COUNTED:
                    parts = [combined()]
                    held = parts[0].num_rows
                    if held > MOST_COUNTED:
                        yield from parts[0].to_batches()
                        parts, held = [], 0
        if ends:
            parts.append(pa.table({"token": [END_TOKEN], "c": [ends]}))
            yield from combined().to_batches()

    return docs.select(text).mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Tokens:
    """Counts of the training tokens: the common ones sent to all tasks, the others as a table."""

    total: int
    ends: int
    common: object
    rare: DataFrame

    def lookup(self) -> tuple[pa.Array, np.ndarray, float]:
        """The common tokens, their log10 probabilities and that of a text's end."""
        known = dict(self.common.value)
        counts = np.fromiter(known.values(), np.float64, len(known))
        return pa.array(list(known), pa.string()), np.log10((counts + 1) / self.total), math.log10((self.ends + 1) / self.total)

    def __getstate__(self):
        # The table stays on the driver.
        return {**self.__dict__, "rare": None}


def rare_words(parts: Iterator[pa.Array], common: pa.Array) -> pa.Array:
    """The distinct words of some texts that are not common, in the order in which they come."""
    held, size = [pa.array([], pa.string())], 0
    for texts in parts:
        new = words_of(texts)[0].unique()
        held.append(new.filter(pc.invert(pc.is_in(new, common))))
        size += len(held[-1])
        if size > MOST_HELD:
            held, size = [pa.concat_arrays(held).unique()], 0
    return pa.concat_arrays(held).unique()


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
           depth: int = DEPTH, hot_share: float = HOT_SHARE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A row per document: the unigram base, the context tree's log10 probability and code length per byte.

    Documents for which ``held_out`` is true are not learned from; all are scored whole, a null text as
    empty. ``score`` covers the text's bytes and its end; ``bits_per_byte`` is null for an empty text.
    Rows with the same id, or with none, are scored one by one. Without any training text the base
    counts N and V are zero and the tree holds all bytes equally likely.
    """
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trusted = rows.where(~F.col("held_out"))
    spark = docs.sparkSession
    model = train(trusted, "text", depth)
    counts = shared_table(token_counts(trusted, "text"), "tokens")
    n_train, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total = n_train + n_distinct + 1
    # At most 1 / hot_share tokens hold that share of all; the end counts among them in any case.
    is_hot = (F.col("c") >= hot_share * n_train) | (F.col("token") == END_TOKEN)
    tokens = Tokens(total, 0, None, counts.where(~is_hot))
    known = dict(tuple(r) for r in counts.where(is_hot).select("token", "c").collect())
    tokens.ends = known.pop(END_TOKEN, 0)
    tokens.common = spark.sparkContext.broadcast(list(known.items()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, in_chunk, number = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in text_groups(texts, PART_CHARS):
                if in_chunk >= chunk_chars:
                    chunk, in_chunk = chunk + 1, 0
                in_chunk += sum(map(len, texts[s:e]))
                blob, size, lengths = packed_chunk(texts[s:e], depth)
                bounds = pa.array([0, e - s], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk]), pa.array([number]), pa.array([size]), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([blob], pa.binary()), pa.ListArray.from_arrays(bounds, batch.column("doc_id").slice(s, e - s)),
                    pa.ListArray.from_arrays(bounds, batch.column("held_out").slice(s, e - s)),
                ], names=["chunk", "first", "size", "lengths", "blob", "ids", "held"])
                number += 1

    chunks = shared_table(rows.mapInArrow(
        pack, "chunk long, first long, size long, lengths array<long>, blob binary, ids array<long>, held array<boolean>"
    ), "chunks")
    return chunk_scores(chunks, model, tokens).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score",
        "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("score") / F.col("n_bytes") / math.log10(2)).alias("bits_per_byte"),
    )


# Rows that the scores of a chunk are made of: answers to its codes, to its tokens, then its texts.
LOGS, COUNTS, TEXTS = 0, 1, 2
HELD = {"chunk": "long", "kind": "int", "logs": "array<double>", "places": "array<long>", "times": "array<long>", "size": "long",
        "lengths": "array<long>", "blob": "binary", "ids": "array<long>", "held": "array<boolean>"}
SCORED_SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
                 "n_bytes long")
SCORED = [field.split()[0] for field in SCORED_SCHEMA.split(", ")]
