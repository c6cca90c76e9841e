"""Quality by perplexity: an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

Counts are taken by Spark and the model's parts come from joins of sharded count tables: an n-gram's count with the
totals of its context. All texts it may learn from are counted whole, so the model grows with them. One of up to
MOST_GRAMS n-grams goes to every task. Of a larger one the most frequent n-grams do, with their finished probabilities;
a text's other n-grams are looked up by joins with the model's tables. All documents are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, key_columns, shared_table, text_groups
from .context_tree import codes, context_counts, padded

ORDER = 5
# N-grams of the highest order that are sent to the tasks.
MOST_GRAMS = 1 << 20
SYMBOLS = 256
CHARS_AT_ONCE = 500_000

SCORE = T.StructType([T.StructField("log10_prob", T.DoubleType()), T.StructField("n_symbols", T.LongType()),
                      T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

# Sorted codes and the log10 probabilities of their lowest bytes.
Logs = tuple[np.ndarray, np.ndarray]
# Per order, from one byte up: sorted n-grams, their shares, sorted contexts, their weights.
Levels = list[tuple[np.ndarray, ...]]


def training_texts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of all trusted documents that have a text, one per id (of several texts the least)."""
    ids = trusted.select(F.col(id_col).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("text").isNotNull() & F.col("doc_id").isNotNull()).withColumn("version", F.xxhash64("doc_id"))
    # Other texts are not moved, but for a few whose ids have the same bits.
    return texts.where(among(ids.select(F.xxhash64("doc_id").alias("version")), "version")).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min("text").alias("text"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts for counts of one, two, and three or more."""
    sums = [F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]
    n1, n2, n3, n4 = counts.agg(*[s.alias(f"n{k}") for k, s in enumerate(sums, 1)]).first()
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in ((d1, 1), (d2, 2), (d3, 3)))


def smoothed_level(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For one order: each n-gram's discounted share, and each context's weight for the order below."""
    d1, d2, d3 = discounts(counts)
    n = F.col("n")
    cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
    rows = counts.select("code", "n", F.shiftright("code", 8).alias("context"), cut.alias("cut"))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("free"))
    shares = rows.join(contexts, "context").select("code", ((n - F.col("cut")) / F.col("total")).alias("value"))
    return shares, contexts.select(F.col("context").alias("code"), (F.col("free") / F.col("total")).alias("value"))


def level_tables(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Shares and weights per order, from one byte up, out of the counts of the highest.

    The highest order uses counts, the lower ones the number of distinct bytes before an n-gram.
    """
    levels = []
    for length in range(order, 0, -1):
        levels.append(smoothed_level(counts))
        if length > 1:
            shorter = F.col("code").bitwiseAND((1 << 8 * (length - 1)) - 1).alias("code")
            counts = counts.groupBy(shorter).agg(F.count(F.lit(1)).alias("n"))
    return levels[::-1]


def _in_order(table: DataFrame) -> Logs:
    """``code`` and ``value`` as arrays, by code."""
    rows = table.select("code", "value").toArrow()
    code = rows["code"].to_numpy().view(np.uint64)
    at = np.argsort(code)
    return code[at], rows["value"].to_numpy()[at]


def gathered(tables: list[tuple[DataFrame, DataFrame]]) -> Levels:
    return [tuple(x for table in level for x in _in_order(table)) for level in tables]


def train(sample: DataFrame, text_col: str = "text", order: int = ORDER) -> Levels:
    """The whole model of some texts as arrays, for texts with few distinct n-grams."""
    return gathered(level_tables(shared_table(context_counts(sample, text_col, order - 1), "grams"), order))


def interpolated(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``code`` and ``value``, the log10 probability of the lowest byte of each distinct code after the bytes above it."""
    out = asked.select("code", F.lit(1 / SYMBOLS).alias("p"))
    for length, (shares, weights) in enumerate(tables, 1):
        gram = F.col("code").bitwiseAND((1 << 8 * length) - 1)
        out = (
            out.withColumns({"gram": gram, "context": F.shiftright(gram, 8)})
            .join(shares.select(F.col("code").alias("gram"), F.col("value").alias("share")), "gram", "left")
            .join(weights.select(F.col("code").alias("context"), F.col("value").alias("weight")), "context", "left")
            .select("code", (F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
        )
    return out.select("code", F.log10("p").alias("value"))


@dataclass
class Model:
    """Either all levels or, of a larger model, its tables and the probabilities of the most frequent codes."""

    order: int
    levels: Levels | None = None
    tables: list[tuple[DataFrame, DataFrame]] | None = None
    common: Logs | None = None


def trained(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    counts = shared_table(context_counts(texts, text_col, order - 1), "grams")
    tables, n = level_tables(counts, order), counts.count()
    if n <= MOST_GRAMS:
        return Model(order, levels=gathered(tables))
    tables = [tuple(shared_table(table, "level") for table in level) for level in tables]
    # As an estimate it moves the line between what is sent and what is asked for, no result.
    least = F.percentile_approx("n", 1 - MOST_GRAMS / n, 10_000)
    often = counts.join(F.broadcast(counts.agg(least.alias("least"))), F.col("n") > F.col("least"))
    return Model(order, tables=tables, common=_in_order(interpolated(often.select("code"), tables)))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def log_probs(levels: list[tuple[np.ndarray, ...]], code: np.ndarray) -> np.ndarray:
    """log10 probability of the lowest byte of each code after the bytes above it."""
    p = np.full(len(code), 1 / SYMBOLS)
    for length, (grams, shares, contexts, weights) in enumerate(levels, 1):
        gram = code & np.uint64((1 << 8 * length) - 1)
        p = _looked_up(grams, shares, gram, 0.0) + _looked_up(contexts, weights, gram >> np.uint64(8), 1.0) * p
    return np.log10(p)


def distinct_codes(texts: list[str], depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts, each with its distinct codes, the place of every byte's code among them and the texts' lengths."""
    for s, e in text_groups(texts, CHARS_AT_ONCE):
        buffer, firsts, lengths = padded(texts[s:e], depth)
        yield s, e, *np.unique(codes(buffer, firsts, lengths, depth), return_inverse=True), lengths


def sums_of(values: np.ndarray, lengths: np.ndarray) -> list[float]:
    """Sums of each text on its own, so that a text's score is the same in any company."""
    ends = np.cumsum(lengths)
    return [values[b: b + n].sum() for b, n in zip((ends - lengths).tolist(), lengths.tolist())]


def score_texts(levels: Levels, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each whole text with its end, and the number of its bytes with the end."""
    scores, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for s, e, distinct, place, lengths in distinct_codes(texts, len(levels) - 1):
        scores[s:e], sizes[s:e] = sums_of(log_probs(levels, distinct)[place], lengths), lengths
    return scores, sizes


def score_common(common: Logs, depth: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list, list]:
    """The same over the common codes only, and each text's other codes and how often it has them."""
    scores, sizes, others, times = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [], []
    for s, e, distinct, place, lengths in distinct_codes(texts, depth):
        logs = _looked_up(*common, distinct, np.nan)
        known = ~np.isnan(logs)
        scores[s:e], sizes[s:e] = sums_of(np.where(known, logs, 0.0)[place], lengths), lengths
        at = np.flatnonzero(~known[place])
        owner = np.searchsorted(np.cumsum(lengths), at, "right")
        pairs, n = np.unique(owner * len(distinct) + place[at], return_counts=True)
        bounds = np.searchsorted(pairs, np.arange(e - s + 1) * len(distinct))
        other = distinct[pairs % len(distinct)].view(np.int64)
        others += [other[b:c] for b, c in zip(bounds, bounds[1:])]
        times += [n[b:c] for b, c in zip(bounds, bounds[1:])]
    return scores, sizes, others, times


def with_asked(scanned: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The scores with those of each text's other codes, whose probabilities are looked up once each."""
    logs = shared_table(interpolated(scanned.select(F.explode("s.codes").alias("code")).distinct(), tables), "asked")
    each = scanned.select("row", F.explode(F.arrays_zip("s.codes", "s.times")).alias("x")).select(
        "row", F.col("x.codes").alias("code"), F.col("x.times").alias("n"))
    # Added up in the order of the codes, so that a run gives what another gave.
    values = F.array_sort(F.collect_list(F.struct("code", (F.col("n") * F.col("value")).alias("v"))))
    rest = each.join(logs, "code").groupBy("row").agg(
        F.aggregate(values, F.lit(0.0), lambda total, x: total + x["v"]).alias("rest"))
    return scanned.join(rest, "row", "left").withColumn(
        "log10_prob", F.col("s.log10_prob") + F.coalesce("rest", F.lit(0.0)))


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """``doc_id``, ``lang`` ('' if missing), ``n_symbols``, ``log10_prob`` and ``perplexity`` per byte."""
    sent, depth = docs.sparkSession.sparkContext.broadcast(model.levels or model.common), model.order - 1
    whole = model.tables is None

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if whole:
                found = *score_texts(sent.value, texts.tolist()), None, None
            else:
                found = score_common(sent.value, depth, texts.tolist())
            yield pd.DataFrame(dict(zip(SCORE.names, found)), index=range(len(texts)))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scanned = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.pandas_udf(score, SCORE)(text).alias("s"),
    )
    if whole:
        scored = scanned.withColumn("log10_prob", F.col("s.log10_prob"))
    else:
        scored = with_asked(shared_table(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned"), model.tables)
    return scored.select("doc_id", "version", "lang", "s.n_symbols", "log10_prob",
                         F.pow(10.0, -F.col("log10_prob") / F.col("s.n_symbols")).alias("perplexity"))


QUANTILE = 0.995
MIN_EXCESS = 2.0


def excess(perplexity: Column, n_symbols: Column, median: Column) -> Column:
    """How far a document's perplexity lies above its language's median, in logarithms per root of its length.

    The mean over n bytes varies as one over the root of n, so short texts are not rejected for chance alone.
    """
    return (F.log10(perplexity) - median) * F.sqrt(n_symbols)


def thresholds(scores: DataFrame, quantile: float, min_excess: float) -> DataFrame:
    """``lang``, ``median`` of log10 perplexity and ``threshold`` of the excess; `lang` null is over all."""
    level = F.percentile_approx(F.log10("perplexity"), 0.5, 10_000).alias("median")

    def of(rows: DataFrame, medians: DataFrame, by: list[str]) -> DataFrame:
        joined = rows.join(medians, by) if by else rows.crossJoin(F.broadcast(medians))
        cut = F.percentile_approx(excess(F.col("perplexity"), F.col("n_symbols"), F.col("median")), quantile, 10_000)
        return joined.groupBy(*by).agg(F.first("median").alias("median"), F.greatest(cut, F.lit(min_excess)).alias("threshold"))

    by_lang = of(scores, scores.groupBy("lang").agg(level), ["lang"])
    # One row, hence the product.
    overall = of(scores, scores.agg(level), []).select(F.lit(None).cast("string").alias("lang"), "median", "threshold")
    return by_lang.select("lang", "median", "threshold").union(overall)


def classified(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE,
               min_excess: float = MIN_EXCESS) -> DataFrame:
    """A row per document: ``doc_id``, ``version``, ``lang``, ``n_symbols``, ``perplexity``, ``threshold``, ``keep``.

    ``trusted`` holds the ids of trusted documents. Every other one, by hash, trains the model;
    all the rest set the thresholds: per language, the quantile of the excess, at least
    ``min_excess``; a language without trusted documents takes that of all, and without any trusted document
    everything is kept. A null text is empty; a missing language is one of its own; repeated rows get a row each.
    """
    ids = trusted.select(F.col(id_col).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    ids = shared_table(ids.withColumn("trains", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "trusted_ids")
    texts = training_texts(docs, ids.where("trains").select(F.col("doc_id").alias(id_col)), id_col, text_col)
    model = trained(texts, "text", order)
    scores = shared_table(perplexities(docs, model, id_col, text_col, lang_col), "perplexities")
    calibration = scores.join(ids.where("not trains").select("doc_id"), "doc_id", "left_semi")
    cuts = shared_table(thresholds(calibration, quantile, min_excess), "thresholds")
    own = cuts.where(F.col("lang").isNotNull())
    # One row at most, for languages without trusted documents.
    overall = cuts.where(F.col("lang").isNull()).select(
        F.col("median").alias("any_median"), F.col("threshold").alias("any_threshold"))
    joined = scores.join(own, "lang", "left").join(F.broadcast(overall), F.lit(True), "left")
    above = excess(F.col("perplexity"), F.col("n_symbols"), F.coalesce("median", "any_median"))
    cut = F.coalesce("threshold", "any_threshold")
    return joined.select("doc_id", "version", "lang", "n_symbols", "log10_prob", "perplexity", above.alias("excess"),
                         cut.alias("threshold"), F.coalesce(above <= cut, F.lit(True)).alias("keep"))


def kept(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that the classifier keeps, as they are."""
    bad = classified(docs, trusted, id_col, text_col, **options).where(~F.col("keep")).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), "version"
    ).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_columns(id_col, text_col))
    return rows.join(bad, ["doc", "no_id", "version"], "left_anti").select("row.*")
