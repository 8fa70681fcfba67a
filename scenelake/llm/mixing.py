"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate (expected copies). Among all rates between 0 and 3
that meet the token target of its source, the ones nearest to 1 in relative
entropy are exponential in the size: rate = min(3, exp(lambda * size)), one
multiplier per source, the solution of the convex dual problem. A Newton step
needs two sums per source over the histogram of sizes, which is aggregated
once, so an iteration never touches documents again.

Rates become copies by thresholds: floor(rate) copies are certain, and one
more goes to the documents whose fraction exceeds their hash by most, until
the target is reached. The cut is found digit by digit from sums per digit; a
few single documents, largest fitting first, fill the remaining gap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scenelake.llm.common import materialise

MOST = 3  # copies of a document, and target over size of a source
WEIGHTS = 3  # sources weigh 1, 2, 3, 1, 2, ...
NEWTON_ROUNDS = 80
TOLERANCE = 1e-7  # of the targets, for the multipliers
DIGIT = 10  # bits of the cut found per round
DIGITS = 3
FILL_ROUNDS = 6
CLOSE = 0.001  # share of a target that may stay open
SOURCES_BROADCAST = 100_000  # rows of some 80 bytes

_SPACES = " \t\n\x0b\f\r"


def n_words(text: str = "text") -> Column:
    """Maximal runs without ASCII white space; null has none.

    Each run is replaced by one mark, then the marks are counted.
    """
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, _SPACES, "")), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """A key that joins null with null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def targets(units: DataFrame) -> DataFrame:
    """(key, source_size, target, mean, least): one row per source of ``units(key, source, size, n)``.

    Sources share all words by weight; what exceeds three times a source's size
    is shared among the others by weight. Filled up in order of size over
    weight, the level of the first source that stays below its limit holds for
    all later ones.
    """
    words = F.col("size") * F.col("n")
    sources = materialise(units.groupBy("key").agg(
        F.first("source").alias("source"), F.sum(words).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("documents"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")))
    # One row per source from here on.
    ranked = sources.withColumn("weight", (
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1).cast("double"))
    limit = F.col("source_size") * float(MOST)
    ranked = ranked.withColumn("ratio", limit / F.col("weight"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("level", level)
    ordered = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", F.first(
        F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(ordered))
    target = F.least(limit, F.coalesce(F.col("weight") * F.col("level"), limit))
    return ranked.select("key", "source_size", target.alias("target"),
                         F.coalesce(F.col("source_size") / F.col("documents"), F.lit(1.0)).alias("mean"),
                         F.coalesce("least", F.lit(1)).alias("least"))


def _with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join on the source; its table is broadcast when its counted rows are few."""
    return rows.join(F.broadcast(sources) if n_sources <= SOURCES_BROADCAST else sources, "key")


def _rate() -> Column:
    return F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(math.log(MOST))))


def balance(units: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Adds ``multiplier``: Newton iterations on the dual, inside a bracket that always holds the root."""
    histogram = materialise(units.where(F.col("size") > 0).groupBy("key", "size").agg(F.sum("n").alias("n")))
    # All rates at most target / size at one end, all at the limit at the other.
    shallow = F.col("mean") / F.col("least")
    share = F.log(F.try_divide("target", "source_size"))
    state = sources.withColumns({
        "low": F.coalesce(F.least(share * shallow, F.lit(0.0)), F.lit(0.0)),
        "high": F.when(F.col("target") > F.col("source_size"), shallow * math.log(MOST)).otherwise(0.0),
        "multiplier": F.lit(0.0), "open": F.lit(1.0)})
    rate = _rate()
    words = F.col("n") * F.col("size")
    for _ in range(NEWTON_ROUNDS):
        sums = _with_sources(histogram, state.select("key", "mean", "multiplier"), n_sources).groupBy("key").agg(
            F.sum(words * rate).alias("reached"),
            F.sum(F.when(rate < MOST, words * rate * F.col("size") / F.col("mean"))).alias("slope"))
        gap = F.coalesce("reached", F.lit(0.0)) - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - F.try_divide(gap, F.col("slope"))
        moved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        gone = F.abs(gap) <= F.col("target") * TOLERANCE
        state = materialise(state.join(sums, "key", "left").select(
            "key", "source_size", "target", "mean", "least", low.alias("low"), high.alias("high"),
            F.when(gone, F.col("multiplier")).otherwise(F.coalesce(moved, F.col("multiplier"))).alias("multiplier"),
            F.when(gone, 0.0).otherwise(1.0).alias("open")))
        if not state.agg(F.sum("open")).first()[0]:
            break
    return state.drop("low", "high", "open", "least")


def _order(doc_id: str = "doc_id") -> Column:
    """Place of a document in the queue for one more copy, 0 to 2**30 - 1: fraction of its rate less its hash."""
    chance = F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1 << 40)) / float(1 << 40)
    late = (1 - (_rate() - F.floor(_rate())) + chance) / 2
    return F.least(F.floor(late * (1 << DIGIT * DIGITS)), F.lit((1 << DIGIT * DIGITS) - 1)).cast("long")


def _certain() -> Column:
    return F.floor(_rate() + 1e-9).cast("long")


def _thresholds(units: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Adds ``cut``: documents before that place get one more copy; and ``gap``, the words still missing."""
    words = F.col("size") * F.col("n")
    sure = _with_sources(units, sources, n_sources).groupBy("key").agg(F.sum(words * _certain()).alias("sure"))
    state = materialise(sources.join(sure, "key", "left").withColumn(
        "gap", F.col("target") - F.coalesce("sure", F.lit(0))).drop("sure").withColumn("cut", F.lit(0).cast("long")))
    for level in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - level)
        place = _order()
        queue = _with_sources(units.where(F.col("size") > 0), state, n_sources).where(_certain() < MOST)
        inside = queue.where(F.shiftright(place, shift + DIGIT) == F.shiftright(F.col("cut"), shift + DIGIT))
        digits = inside.groupBy("key", F.shiftright(place, shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(
            F.sum(words).alias("words"), F.first("gap").alias("gap"))
        # At most 1,024 rows per source.
        upto = Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        full = digits.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") <= F.col("gap")).groupBy(
            "key").agg(F.max("digit").alias("digit"), F.max("upto").alias("upto"))
        # The first digit that no longer fits is opened in the next round.
        state = materialise(state.join(full, "key", "left").select(
            *[c for c in state.columns if c not in ("gap", "cut")],
            (F.col("gap") - F.coalesce("upto", F.lit(0))).alias("gap"),
            (F.col("cut") + F.shiftleft(F.least(F.coalesce(F.col("digit") + 1, F.lit(0)), F.lit((1 << DIGIT) - 1)).cast("long"), shift)).alias("cut")))
    return state


def _fill(units: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Single documents, largest fitting first, that close the gaps: a few rows per source."""
    state = sources.select("key", "target", "gap", "cut", "mean", "multiplier", F.lit(float("inf")).alias("last"))
    words = F.col("size") * F.col("n")
    extras = None
    for _ in range(FILL_ROUNDS):
        fits = _with_sources(units.where(F.col("size") > 0), state, n_sources).where(
            (F.col("gap") > F.col("target") * CLOSE) & (words <= F.col("gap")) & (words < F.col("last"))
            & (_copies() < MOST))
        best = fits.groupBy("key").agg(F.max(F.struct(words.alias("words"), "doc_id", "size")).alias("best"))
        state = materialise(state.join(best, "key", "left"))
        picked = state.where(F.col("best").isNotNull()).select("key", "best.doc_id", "best.size")
        extras = picked if extras is None else extras.unionByName(picked)
        state = state.select("key", "target", (F.col("gap") - F.coalesce("best.words", F.lit(0))).alias("gap"), "cut", "mean",
                             "multiplier", F.coalesce("best.words", F.lit(-1.0)).cast("double").alias("last"))
        if not state.where((F.col("last") > 0) & (F.col("gap") > F.col("target") * CLOSE)).limit(1).count():
            break
    return materialise(extras)


def _copies() -> Column:
    more = (_certain() < MOST) & (F.col("size") > 0) & (_order() < F.col("cut"))
    return _certain() + F.when(more, 1).otherwise(0)


@dataclass
class Mix:
    """What decides the copies: one row per source, and the few documents that fill gaps."""

    sources: DataFrame
    extras: DataFrame
    n_sources: int

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows(doc_id, key, size, ...)`` with source_size, target and copies."""
        found = _with_sources(rows, self.sources, self.n_sources)
        extra = self.extras.select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"), F.col("size").alias("_s"),
                                   F.lit(1).alias("_extra"))
        if self.n_sources * FILL_ROUNDS <= SOURCES_BROADCAST:
            extra = F.broadcast(extra)
        return found.join(extra, (found["key"] == extra["_k"]) & found["doc_id"].eqNullSafe(extra["_d"])
                          & (found["size"] == extra["_s"]), "left").withColumn(
            "copies", _copies() + F.coalesce("_extra", F.lit(0)))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size), written once; the only pass over texts."""
    return materialise(docs.select("doc_id", "source", source_key().alias("key"), n_words().alias("size")))


def fit(rows: DataFrame) -> Mix:
    """Solve the mix of ``rows`` of ``sized``."""
    units = materialise(rows.groupBy("key", "source", "doc_id", "size").agg(F.count("*").alias("n")))
    sources = materialise(targets(units))
    n_sources = sources.count()
    state = _thresholds(units, balance(units, sources, n_sources), n_sources)
    extras = _fill(units, state, n_sources)
    return Mix(state.select("key", "source_size", "target", "mean", "multiplier", "cut"), extras, n_sources)


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and stay once (their words do not count);
    null sources form one source, ordered last. Repeated rows (same id, source
    and size) get equal copies. An empty table gives an empty result; further
    columns are ignored.
    """
    rows = sized(docs)
    return fit(rows).copies(rows).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns kept."""
    plan = fit(sized(docs))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id",
                       source_key().alias("key"), n_words().alias("size"))
    return plan.copies(rows).where(F.col("copies") > 0).select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
