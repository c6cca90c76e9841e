"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Everything on rows is a DataFrame expression. Patterns propose candidates; a regex, a gazetteer, a context, a
boundary and a variety labeler vote for, against, or not at all. The votes of all candidates are
counted by pattern of votes, of which there are at most 3 ^ 5 per kind, whatever the corpus; on this table
expectation-maximisation estimates how reliable each labeler is, and a logistic
classifier is trained on the estimated probabilities. Base spans, those that a fixed rule defines, always
stay; the classifier adds spans of further kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

BASE = ("email", "ip", "card", "phone")
# Kinds that the classifier may add.
MORE = ("masked_email", "local_phone", "national_id", "secret")
KINDS = BASE + MORE

# What base spans look like, and the lists that the labelers know. The repetitions give
# nothing back and a match starts where a run of its characters does, or where the match before
# ended: neither changes what matches, but long runs are read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,63}+ ?"
                    r"(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,24}+",
    "local_phone": r"(?<![0-9+.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}+(?![A-Za-z0-9])",
}
NEEDS = {"email": "@", "masked_email": "at", "phone": "+"}
CUES = {
    "email": "mail|contact|write|reach", "masked_email": "mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|login", "card": "card|visa|master|credit|pay",
    "phone": "phone|tel|call|mobile|fax", "local_phone": "phone|tel|call|mobile|fax",
    "national_id": "ssn|social|security|tax|passport", "secret": "token|key|secret|passw|auth|api",
}
AGAINST = r"(?:version|ver\.|release|page|chapter|isbn|doi|§|build|commit|sha|hash|checksum|digest)[\s:=#\"']*$"
TOP_DOMAINS = "com|net|org|edu|gov|info|biz|io|co|de|fr|es|it|uk|nl|eu|us|ch|at|be|pl|ru|br|in|jp|cn|au|ca|mx"
CARD_PREFIXES = "^(?:4|5[1-5]|2[2-7]|3[47]|36|38|6011|62|64|65|35)"
COUNTRY_CODES = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|127|255)\."
LABELERS = ("regex", "gazetteer", "context", "boundary", "variety")

BEFORE, AFTER = 32, 2
ROUNDS = 50


def matches(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping matches: the gap before each, its text, what stands before and after."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    found = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda value, i: F.struct(
            F.length(gaps[i]).alias("gap"), value.alias("value"),
            F.right(gaps[i], F.lit(BEFORE)).alias("before"), F.left(gaps[i + 1], F.lit(AFTER)).alias("after"),
        ),
    )
    needed = NEEDS.get(kind)
    present = F.instr(text, needed) > 0 if needed else text.rlike("[0-9]")
    return F.when(present & text.rlike(PATTERNS[kind]), found)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the check digit of a number's decimal digits is right."""
    def weighed(i: Column) -> Column:
        digit = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(F.transform(places, weighed), F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base kind is a base span; null for other kinds."""
    number = digits(value)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False))
        .when(kind == "phone", F.length(number).between(9, 15))
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per document (``row``, ``doc_id``), and one per candidate with its span in code points.

    The pass over the texts writes what matched; spans come from it by running sums within a
    document, over candidates only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scanned = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        *[matches(F.col("_text"), kind).alias(kind) for kind in KINDS],
    )
    scanned = shared_table(scanned, "matches")
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in KINDS]),
                     lambda x: x["found"].isNotNull())
    each = scanned.select("row", F.explode(kinds).alias("k")).select(
        "row", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("pos", "m")
    ).select("row", "kind", "pos", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    return scanned.select("row", "doc_id"), placed.withColumn("valid", valid(F.col("kind"), F.col("value")))


def votes(kind: Column, value: Column, before: Column, after: Column, is_valid: Column) -> list[Column]:
    """A vote of each labeler: 1, -1 or 0."""
    number, lower = digits(value), F.lower(value)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    mixed = value.rlike("[A-Fa-f]") & value.rlike("[0-9]")
    shape = F.when(is_valid.isNotNull(), is_valid).when(kind == "secret", mixed).when(
        kind == "national_id", ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    )
    known = (
        F.when(kind.isin("email", "masked_email"), lower.rlike(rf"\W ?(?:{TOP_DOMAINS})$"))
        .when(kind == "ip", ~value.rlike(RESERVED))
        .when(kind == "card", number.rlike(CARD_PREFIXES))
        .when(kind == "phone", number.rlike(COUNTRY_CODES))
        .when(kind == "local_phone", number.rlike("^[2-9][0-9]{2}[2-9]"))
    )
    cue = F.lit(False)
    for name, words in CUES.items():
        cue = F.when(kind == name, F.lower(before).rlike(words)).otherwise(cue)
    alone = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    different = F.size(F.array_distinct(F.split(number, "")))
    return [
        vote(F.coalesce(shape, F.lit(False)), F.coalesce(~shape, F.lit(False))),
        vote(F.coalesce(known, F.lit(False)), F.coalesce(~known, F.lit(False))),
        vote(cue, F.lower(before).rlike(AGAINST)),
        vote(alone, ~alone),
        F.when(kind.isin("email", "masked_email"), 0).when(different >= 5, 1).when(different <= 2, -1).otherwise(0),
    ]


Pattern = tuple[str, tuple[int, ...]]


def estimated(counts: dict[Pattern, int], rounds: int = ROUNDS) -> dict[Pattern, float]:
    """Expectation-maximisation over counted vote patterns: the probability of each that a span is personal.

    A labeler votes by its own odds given the truth, alike for all kinds; each kind has its own share
    of true spans. Starts from the majority of the votes. Odds are smoothed by one vote of each sort.
    """
    truth = {p: 1 / (1 + math.exp(-sum(p[1]))) for p in counts}
    for _ in range(rounds):
        share, odds = {}, []
        for kind in {k for k, _ in counts}:
            here = [(truth[p], n) for p, n in counts.items() if p[0] == kind]
            share[kind] = (1 + sum(t * n for t, n in here)) / (2 + sum(n for _, n in here))
        for j in range(len(LABELERS)):
            table = {(y, v): 1.0 for y in (0, 1) for v in (-1, 0, 1)}
            # A labeler is better than chance: one vote more where it belongs keeps the two classes from swapping.
            table[1, 1] += 1
            table[0, -1] += 1
            for p, n in counts.items():
                table[1, p[1][j]] += n * truth[p]
                table[0, p[1][j]] += n * (1 - truth[p])
            total = {y: sum(table[y, v] for v in (-1, 0, 1)) for y in (0, 1)}
            odds.append({key: c / total[key[0]] for key, c in table.items()})
        for kind, pattern in counts:
            log = math.log(share[kind] / (1 - share[kind]))
            log += sum(math.log(odds[j][1, v] / odds[j][0, v]) for j, v in enumerate(pattern))
            truth[kind, pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return truth


def features(kind: str, pattern: tuple[int, ...]) -> list[float]:
    """A one, one for each kind, and for each labeler whether it votes for and against."""
    out = [1.0] + [float(kind == k) for k in KINDS]
    for v in pattern:
        out += [float(v == 1), float(v == -1)]
    return out


def trained(counts: dict[Pattern, int], truth: dict[Pattern, float], steps: int = 300, penalty: float = 1e-3,
            ) -> list[float]:
    """Weights of the span classifier: logistic regression on the estimated probabilities, by gradient steps."""
    rows = [(features(*p), truth[p], n) for p, n in counts.items()]
    total = sum(n for _, _, n in rows)
    weights = [0.0] * len(features(KINDS[0], (0,) * len(LABELERS)))
    for _ in range(steps if total else 0):
        slope = [penalty * w for w in weights]
        for x, t, n in rows:
            z = sum(w * v for w, v in zip(weights, x) if v)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - t) * n / total
            for i, v in enumerate(x):
                if v:
                    slope[i] += error * v
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def accepted(weights: list[float], kind: Column, cast: list[Column]) -> Column:
    """Whether the classifier takes a candidate for personal data."""
    total = F.lit(weights[0])
    for w, k in zip(weights[1:], KINDS):
        total = total + F.when(kind == k, w).otherwise(0.0)
    for j, vote in enumerate(cast):
        yes, no = weights[1 + len(KINDS) + 2 * j: 3 + len(KINDS) + 2 * j]
        total = total + F.when(vote == 1, yes).when(vote == -1, no).otherwise(0.0)
    return total > 0


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (start, place of the kind, end, kind, base) by start, a row per document.

    Starts and ends count code points, ends are exclusive. A null text is empty and has no spans; rows with
    the same or no id are scanned one by one. An added span that touches a base span is left out.
    """
    rows, found = candidates(docs, id_col, text_col)
    columns = [F.col(c) for c in ("kind", "value", "before", "after", "valid")]
    voted = shared_table(found.select(
        "row", "kind", "start", "end", "valid", *[v.alias(n) for v, n in zip(votes(*columns), LABELERS)]
    ), "votes")
    counted = voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["kind"], tuple(r[n] for n in LABELERS)): r["n"] for r in counted}
    weights = trained(counts, estimated(counts))
    base = F.coalesce("valid", F.lit(False))
    more = F.col("kind").isin(*MORE) & accepted(weights, F.col("kind"), [F.col(n) for n in LABELERS])
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("place")
    span = F.struct("start", place, "end", "kind", base.alias("base"))
    grouped = voted.where(base | more).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))
    kept = grouped.withColumn("fixed", F.filter("all", lambda s: s["base"])).select("row", F.filter(
        "all", lambda s: s["base"] | ~F.exists(
            "fixed", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    ).alias("spans"))
    empty = F.array().cast(kept.schema["spans"].dataType)
    return rows.join(kept, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
