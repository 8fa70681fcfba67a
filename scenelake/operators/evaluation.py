"""Metrics, class weights, splits, contract checks and a fitted threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.functions.mathx import round_to, safe_ratio
from scenelake.operators.components import spread_lookup
from scenelake.operators.ranks import lowest_n


def seg_metrics(df: DataFrame, pred: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Precision (1 without positives), recall, F1, IoU and false-positive rate in one pass, rounded to 4."""
    counts = df.select(*keys, pred.alias("_p"), truth.alias("_g")).groupBy(*keys).agg(
        F.count_if(F.col("_p") & F.col("_g")).alias("tp"), F.count_if(F.col("_p") & ~F.col("_g")).alias("fp"),
        F.count_if(~F.col("_p") & F.col("_g")).alias("fn"), F.count_if(~F.col("_p") & ~F.col("_g")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = counts.withColumn("_pr", safe_ratio(tp, tp + fp, 1.0)).withColumn("_re", safe_ratio(tp, tp + fn))
    p, r = F.col("_pr"), F.col("_re")
    return counts.select(
        *keys, "tp", "fp", "fn", "tn", round_to(p, 4).alias("precision"), round_to(r, 4).alias("recall"),
        round_to(safe_ratio(p * 2.0 * r, p + r), 4).alias("f1"),
        round_to(safe_ratio(tp, tp + fp + fn), 4).alias("iou"), round_to(safe_ratio(fp, fp + tn), 4).alias("fpr"))


def label_accuracy(df: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """Share of equal labels; 1 for an empty table."""
    return df.agg(round_to(F.coalesce(F.avg((pred == truth).cast("double")), F.lit(1.0)), 4).alias("accuracy"))


def per_class_accuracy(df: DataFrame, cls: str, pred: Column, truth: Column) -> DataFrame:
    """Accuracy and F1 per class, with the macro F1 on every row."""
    per = seg_metrics(df, pred, truth, [cls])
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    per = per.withColumn("share", (F.col("tp") + F.col("tn")) / total).select(cls, round_to(F.col("share"), 4).alias("accuracy"), "f1")
    macro = per.agg(F.avg("f1").alias("macro_f1")).scalar()
    return per.withColumn("macro", macro).withColumn("macro_f1", round_to(F.col("macro"), 4)).drop("macro")


def class_weights(df: DataFrame, cls: str, num_classes: int = 5) -> DataFrame:
    """Inverse-frequency weight of each sample; all weights sum to 1.

    Present classes share the total equally, so the normaliser is
    total / num_classes * present classes and needs only the class counts.
    """
    counts = df.groupBy(cls).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").cast("double").alias("t")).scalar()
    weights = counts.withColumn("_w", total / (F.col("_c") * num_classes))
    whole = weights.agg(F.sum(F.col("_w") * F.col("_c")).alias("s")).scalar()
    return spread_lookup(df, weights.select(cls, (F.col("_w") / whole).alias("weight")), [cls])


def split_holdout(df: DataFrame, ident: str, ratio: float = 0.20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, held out): exactly round(n * ratio) ids, at least one, none of a single id.

    The order is the SHA-256 of seed and id, so the split does not depend on partitioning.
    """
    ids = df.select(ident).distinct().withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256))
    n = F.when(F.col("_total") > 1, F.greatest(F.lit(1), F.bround(F.col("_total") * F.lit(ratio)).cast("bigint"))).otherwise(0)
    held = lowest_n(ids, ident, n, "_hash").select(ident)
    return df.join(held, ident, "left_anti"), df.join(held, ident, "left_semi")


def check_contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``, the names of the rules a row breaks (a NULL verdict breaks too)."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.filter(F.array(*broken), lambda v: v.isNotNull()))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)."""
    return (checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0))


def between(c: Column, lo: float, hi: float) -> Column:
    return (c >= lo) & (c <= hi)


def is_event_rules(kinds: Sequence[str], morphs: Sequence[str]) -> dict[str, Column]:
    """Rules of the change event contract over flat columns."""
    return {
        "change_type": F.col("change_type").isin(list(kinds)),
        "change_morphology": F.col("change_morphology").isin(list(morphs)),
        "confidence": between(F.col("confidence"), 0.0, 1.0),
        "raw_change_prob": between(F.col("raw_change_prob"), 0.0, 1.0),
        "qa_coverage": between(F.col("qa_coverage"), 0.0, 1.0),
        "sar_agreement": F.col("sar_agreement").isNull() | between(F.col("sar_agreement"), 0.0, 1.0),
        "bbox_wgs84": F.size("bbox_wgs84") == 4,
        "weights_sha256": F.col("weights_sha256").rlike("^[a-fA-F0-9]{64}$"),
    }


def fit_change_threshold(pixels: DataFrame, score: str, label: str, max_iter: int = 50):
    """Fit change probability on the normalised difference; returns (model, scored pixels).

    ``prob`` is the probability of change and ``pred`` is prob > 0.55.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=[score], outputCol="_x").transform(
        pixels.withColumn("_y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_prob", maxIter=max_iter).fit(data)
    prob = vector_to_array("_prob")[1]
    scored = model.transform(data).withColumn("prob", prob).withColumn("pred", F.col("prob") > 0.55)
    return model, scored.drop("_x", "_y", "_prob", "rawPrediction", "prediction")
