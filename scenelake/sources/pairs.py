"""Index and labels of paired change-detection datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scenelake.lookups import MORPHOLOGY_CLASSES, TYPE_CLASSES

# FIXED VALUES: folder layout of each dataset as (role pattern with groups
# split/role/name, {folder: role}).
LAYOUTS = {
    "levir": (r"([^/]+)/(A|B|label)/([^/]+\.png)$", {"A": "t1", "B": "t2", "label": "mask"}),
    "s2looking": (r"([^/]+)/(Image1|Image2|label)/([^/]+\.png)$", {"Image1": "t1", "Image2": "t2", "label": "mask"}),
    "second": (r"([^/]+)/(im1|im2|label1|label2)/([^/]+\.png)$",
               {"im1": "t1", "im2": "t2", "label1": "mask1", "label2": "mask2"}),
    "sen1floods": (r"(HandLabeled)/(S2Hand|S1Hand|LabelHand)/([^/]+\.tif)$",
                   {"S2Hand": "t2", "S1Hand": "sar", "LabelHand": "mask"}),
}


def index_pairs(files: DataFrame, layout: str) -> DataFrame:
    """One row per sample with a path column per role; both images are required, labels are not.

    ``files(path)`` is a listing. City folders (``oscd``) give one row per city and band.
    """
    if layout == "oscd":
        image = r"([^/]+)/imgs_([12])_rect/([^/]+)\.tif$"
        city = F.regexp_extract("path", r"([^/]+)/(?:imgs_[12]_rect|cm)/[^/]+$", 1)
        rows = files.select("path", city.alias("sample"), F.regexp_extract("path", image, 2).alias("date"),
                            F.regexp_extract("path", image, 3).alias("band"),
                            F.col("path").rlike(r"/cm/cm\.png$").alias("is_mask")).where(F.col("sample") != "")
        bands = rows.where(F.col("date") != "").groupBy("sample", "band").agg(
            F.max(F.when(F.col("date") == "1", F.col("path"))).alias("t1"),
            F.max(F.when(F.col("date") == "2", F.col("path"))).alias("t2"))
        masks = rows.where("is_mask").groupBy("sample").agg(F.max("path").alias("mask"))
        return bands.where("t1 is not null and t2 is not null").join(masks, "sample", "left")
    pattern, roles = LAYOUTS[layout]
    part = {n: F.regexp_extract("path", pattern, i) for i, n in enumerate(("split", "folder", "name"), 1)}
    rows = files.select("path", *[c.alias(n) for n, c in part.items()]).where(F.col("folder") != "")
    name = F.col("name")
    if layout == "sen1floods":
        name = F.regexp_replace(name, "S1Hand|LabelHand", "S2Hand")
    wide = rows.groupBy("split", name.alias("sample")).agg(*[
        F.max(F.when(F.col("folder") == folder, F.col("path"))).alias(role) for folder, role in roles.items()])
    needed = [r for r in ("t1", "t2") if r in wide.columns]
    return wide.where(" and ".join(f"{r} is not null" for r in needed))


def change_mask(layout: str, label: Column, label2: Column | None = None) -> Column:
    """Per-pixel change from raw labels."""
    if layout == "second":
        return label != label2
    if layout == "sen1floods":
        return label == 1
    return label > 0


def sample_labels(pixels: DataFrame, key: str, layout: str, mask: str = "mask", label2: str | None = None
                  ) -> DataFrame:
    """Class names of each sample from whether anything changed, in the shared vocabularies.

    Datasets number their classes differently; names are used so that they agree.
    """
    any_change = F.bool_or(F.col(mask))
    kinds = {"sen1floods": "water_extent"}
    kind = F.when(any_change, kinds.get(layout, "construction")).otherwise(TYPE_CLASSES[-1])
    if layout == "second" and label2:
        kind = F.when(F.bool_or(F.col(label2) == 5), "clearance").otherwise("construction")
    return pixels.groupBy(key).agg(
        F.count_if(mask).alias("n_changed"), kind.alias("change_type"),
        F.when(any_change, MORPHOLOGY_CLASSES[0]).otherwise(MORPHOLOGY_CLASSES[-1]).alias("change_morphology"))
