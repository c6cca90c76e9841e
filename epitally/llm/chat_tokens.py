"""Conversations as token ids with a loss mask.

Texts are encoded piece by piece and joined as ids, never as one text: the marks of the template are reserved
ids above the vocabulary, which no content can produce. So that the formatted text can be read back too, a mark that stands in
a content is escaped: ``<|`` gets a backslash inside, ``<\\|``, and one more where there are some already, which
is undone by taking one away.

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

The loss counts for the tokens of the trained role's texts and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import BytePairs, PieceCache
from .common import as_numpy

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
TRAINED = "assistant"
# Characters of one conversation after which a row of output ends; a turn is never cut.
ROW_CHARS = 1 << 18

TURN_SCHEMA = "conv_id long, turn long, role string, text string"
PIECE_SCHEMA = "conv_id long, piece long, ids array<int>, loss_mask array<boolean>, turns int"
READ_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long")
MARKED, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return MARKED.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text``; a null role or text is empty."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                text("role"), text("text"))


def assembled(segments: list[np.ndarray], trained: Sequence[bool], reserved: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of turns, whose roles and texts alternate in ``segments``.

    Every turn takes the first mark, its role, the second, its text, the third. Offsets are prefix sums
    of the lengths, and the mask is the prefix sum of +1 where a trained text begins and -1 where it ends.
    """
    count = len(trained)
    lengths = np.fromiter(map(len, segments), np.int64, 2 * count).reshape(count, 2)
    sizes = np.empty((count, 5), np.int64)
    sizes[:, ::2], sizes[:, 1::2] = 1, lengths
    ends = np.cumsum(sizes.ravel()).reshape(count, 5)
    total = int(ends[-1, -1]) if count else 0
    begins = ends - sizes
    ids = np.empty(total, np.int32)
    for mark, column in zip(reserved, (0, 2, 4)):
        ids[begins[:, column]] = mark
    is_mark = np.zeros(total, bool)
    is_mark[begins[:, ::2].ravel()] = True
    if count:
        ids[~is_mark] = np.concatenate(segments)
    steps = np.zeros(total + 1, np.int32)
    which = np.asarray(trained, bool)
    # An empty text begins and ends at the same place.
    np.add.at(steps, begins[which, 3], 1)
    np.add.at(steps, ends[which, 3], -1)
    return ids, np.cumsum(steps)[:total] > 0


def formatted(conversations: DataFrame, pairs, trained: str = TRAINED) -> DataFrame:
    """``conv_id``, ``piece``, ``ids``, ``loss_mask`` and ``turns``: the conversations as rows of ids, by turn.

    A conversation is one row, or several in the order of ``piece`` where it has more than ``ROW_CHARS`` characters or an end of
    a range partition falls into it, so a conversation of any length is split over tasks and rows. Null
    ids form one conversation; turns with the same number follow by role and text, repeated ones stay; a null
    number comes first. Ids above the vocabulary are the marks, in the order of ``MARKS``. Other columns are not read.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = BytePairs(*pairs.value), PieceCache()
        reserved = range(first_reserved(table), first_reserved(table) + len(MARKS))

        def rows(held: list[list[tuple[str, str]]], convs: list) -> pa.RecordBatch:
            flat = [turn for conv in held for turn in conv]
            segments = list(table.encode_texts([escape(part) for turn in flat for part in turn], cache))
            ids, mask = assembled(segments, [role == trained for role, _ in flat], reserved)
            sizes = np.fromiter((len(a) + len(b) + 3 for a, b in zip(segments[::2], segments[1::2])), np.int64, len(flat))
            turn_ends = np.cumsum([0, *map(len, held)])
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)])[turn_ends], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array(convs, pa.int64()), pa.nulls(len(convs), pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(ids)),
                pa.ListArray.from_arrays(bounds, pa.array(mask)), pa.array(list(map(len, held)), pa.int32()),
            ], names=["conv_id", "piece", "ids", "loss_mask", "turns"])

        # Conversations wait until they have about ROW_CHARS characters; only one longer than that is cut.
        held, convs, size, own = [], [], 0, 0
        for batch in batches:
            for conv, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]):
                new = not convs or conv != convs[-1]
                if size >= ROW_CHARS if new else own >= ROW_CHARS:
                    yield rows(held, convs)
                    held, convs, size, new = [], [], 0, True
                if new:
                    held.append([])
                    convs.append(conv)
                    own = 0
                held[-1].append((role, text))
                size += len(role) + len(text)
                own += len(role) + len(text)
        if held:
            yield rows(held, convs)

    order = ["conv_id", "turn", "role", "text"]
    dealt = turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = dealt.mapInArrow(assemble, PIECE_SCHEMA)
    # Partitions follow in the order of their ranges.
    return pieces.withColumn("piece", F.monotonically_increasing_id())


def first_reserved(table: BytePairs) -> int:
    """The first id above the vocabulary."""
    return len(table.tokens)


def read_back(pieces: DataFrame, pairs) -> DataFrame:
    """What the rows of :func:`formatted` say: one row per conversation with digests of its turns and of its loss text.

    Everything comes from ids and masks alone. The turns are found by the marks; a run of the mask is one
    trained text. Rows of a conversation are streamed in order, and only the running digests are held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = BytePairs(*pairs.value)
        first = first_reserved(table)
        names = [n.split()[0] for n in READ_SCHEMA.split(", ")]
        state, done = None, []

        def text_of(ids: np.ndarray) -> str:
            return table.decode(ids).decode()

        def close() -> None:
            conv, count, told, chars, loss, total = state
            done.append((conv, count, told.hexdigest(), chars, loss.hexdigest(), total))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done.clear()
            return out

        for batch in batches:
            for i, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or conv != state[0]:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = as_numpy(batch.column(2)[i].values)
                mask = as_numpy(batch.column(3)[i].values)
                starts, seps, stops = (np.flatnonzero(ids == first + k) for k in range(len(MARKS)))
                for start, sep, stop in zip(starts.tolist(), seps.tolist(), stops.tolist()):
                    role, text = text_of(ids[start + 1: sep]), text_of(ids[sep + 1: stop])
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    state[5] += len(role) + len(text) + sum(map(len, MARKS))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    text = unescape(text_of(ids[begin:end]))
                    state[3] += len(text)
                    state[4].update(text.encode())
            if len(done) > 1000:
                yield flush()
        if state is not None:
            close()
            yield flush()

    dealt = pieces.select("conv_id", "piece", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.mapInArrow(read, READ_SCHEMA)
