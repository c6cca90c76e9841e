"""What each of five filters removes in every order in which they can run.

A document either passes or fails each filter, so everything about their interaction is in the number of documents
per part and pattern of failures: at most 32 rows a part, counted once for all 120 orders. Their counts form a
tensor with one axis per filter. A step of an order contracts it: along the axes of the filters before the step
only passing counts, along its own only failing, along the others both.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, text_or_empty

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SYMBOLS = r"[#$%&*|]"

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")

# What a contraction takes along an axis: the count that passes, the one that fails, or their sum.
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def text_failures(text: Column) -> list[Column]:
    """Whether a text is too short, repeats its words, has many capitals, holds symbols; an empty one is too short only."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    # What is left without capitals is shorter by their number.
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        n < MIN_WORDS,
        F.lit(100) * distinct.cast("long") < F.lit(MIN_DISTINCT_PERCENT) * n.cast("long"),
        F.lit(100) * capitals.cast("long") > F.lit(MAX_CAPITALS_PERCENT) * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id``, ``part`` and ``fails``, whose bits tell the filters that a document fails, the first filter's being 1.

    The last filter fails texts that a smaller id has too. Only the first id of each text passes it: the
    first ids are found with partial aggregates, and meet their rows by text and id, so copies of one text are spread.
    A row without an id is never a copy, and no other row is one of it.
    """
    text = text_or_empty(f"`{text_col}`")
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(text))]
    read = shared_table(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"), sum(bits[1:], bits[0]).alias("bits"),
    ), "audit-texts")
    firsts = read.where(F.col("id").isNotNull()).groupBy("same").agg(F.min("id").alias("id"))
    marked = read.join(firsts.withColumn("first", F.lit(True)), ["same", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return marked.select("id", "part", (F.col("bits") + F.when(copy, 1 << 4).otherwise(0)).alias("fails"))


def patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "lang") -> DataFrame:
    """Documents per ``part`` and ``fails``, and how many of them are labelled good or toxic.

    A document labelled more than once has the greatest of its labels.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")
    )
    found = failures(docs, id_col, text_col, part_col).join(marks, "id", "left")
    return found.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def contracted(counts: np.ndarray, along: list[np.ndarray]) -> np.ndarray:
    """The counts (measure, A, B, C, D, E) summed with one vector per filter."""
    return np.einsum("mabcde,a,b,c,d,e->m", counts, *along)


def orders_of(counts: np.ndarray) -> list[tuple]:
    """All rows of a part but its name, from counts of documents, good and toxic ones by failures."""
    letters = range(len(FILTERS))
    rows, shapley = [], np.zeros(len(FILTERS), np.int64)
    for order in itertools.permutations(letters):
        for step, own in enumerate(order):
            before = order[:step]
            taken = [PASS if f in before else FAIL if f == own else ALL for f in letters]
            removed, good, toxic = contracted(counts, taken).tolist()
            kept = contracted(counts, [PASS if f in before or f == own else ALL for f in letters])[0]
            failing = contracted(counts, [FAIL if f == own else ALL for f in letters])[0]
            alone = contracted(counts, [FAIL if f == own else PASS for f in letters])[0]
            shapley[own] += removed
            rows.append((order, step + 1, own, int(kept), removed, int(failing) - removed, int(alone), good, toxic))
    name = "".join
    return [(name(FILTERS[f] for f in order), step, *rest, int(shapley[own])) for order, step, own, *rest in rows]


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang") -> DataFrame:
    """One row per ``part``, ``filter_order`` and ``step``: documents of the part left after the step (``kept``), removed
    by it, failing its filter but removed before (``redundant``), failing its filter alone (``unique_fails``), removed
    though labelled good, removed and labelled toxic, and removed by its filter in all orders together (``shapley``).

    A null text is empty, a null part the empty text; no document, no row. Further columns are not read.
    """

    def audit(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, 1 << len(FILTERS)), np.int64)
        counts[:, part["fails"]] = part[["docs", "good", "toxic"]].to_numpy().T
        # The first filter's bit is the lowest, hence the last axis of the reshaped counts.
        tensor = counts.reshape(3, *[2] * len(FILTERS)).transpose(0, *range(len(FILTERS), 0, -1))
        rows = [(part["part"].iloc[0], *row) for row in orders_of(tensor)]
        return pd.DataFrame(rows, columns=["part", "filter_order", "step", *MEASURES, "shapley"])

    return patterns(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(audit, SCHEMA)
