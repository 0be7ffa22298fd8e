"""Reading step tables, checkpoints and images."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STEPS


def read_split(spark: SparkSession, root: str, split: str = "train", schema: str = STEPS) -> DataFrame:
    """All ``data/<split>*.parquet`` files under a root, as one table.

    The explicit schema gives missing optional columns as nulls and lets pruning
    skip page and screenshot columns.  No such file is an AnalysisException.
    """
    return spark.read.schema(schema).parquet(f"{root}/data/{split}*.parquet")


def read_file(spark: SparkSession, root: str, name: str, fallback: DataFrame | None = None, schema: str = STEPS) -> DataFrame:
    """The files whose name ends with ``name``; if there are none, the fallback table."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/data/*{name.rpartition('/')[2]}")
    except AnalysisException:
        if fallback is None:
            raise
        return fallback


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Tables below each other; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a checkpoint, distinct, without null and empty ones.

    Reads both an append-only Parquet table and a JSON list of strings; a missing
    or unreadable file is an empty checkpoint.
    """
    empty = spark.createDataFrame([], "annotation_id string")
    try:
        if not path.endswith(".json"):
            ids = spark.read.schema("annotation_id string").parquet(path)
        else:
            whole = spark.read.text(path, wholetext=True)
            ids = whole.select(F.explode(F.from_json("value", "array<string>")).alias("annotation_id"))
        return ids.where(F.coalesce("annotation_id", F.lit("")) != "").distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files by path relative to a root, for steps that name a path only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = urlsplit(root).path.rstrip("/") + "/"
    after = F.instr("path", folder) + len(folder)
    return files.select(F.col("path").substr(after, F.length("path")).alias("path"), F.col("content").alias("bytes"))


def with_images(steps: DataFrame, images: DataFrame) -> DataFrame:
    """``steps`` with ``image``: the screenshot's bytes, else those of its path; else null."""
    joined = steps.join(images.select(F.col("path").alias("__path"), F.col("bytes").alias("__bytes")), F.col("screenshot.path") == F.col("__path"), "left")
    return joined.withColumn("image", F.coalesce("screenshot.bytes", "__bytes")).drop("__path", "__bytes")


def with_default(df: DataFrame, column: str, kind: str, default: object = None) -> DataFrame:
    """A missing column as a constant; nulls of one that is there stay."""
    return df if column in df.columns else df.withColumn(column, F.lit(default).cast(kind))


def candidates(c: Column, scale_x: Column | None = None, scale_y: Column | None = None) -> Column:
    """One candidate (JSON text) as tag, corner box (scaled, if scales are given), flags, node id and raw text."""
    from ..functions.geometry import box_corners
    from ..functions.jsonfn import field, load_or_raw

    attributes = F.get_json_object(c, "$.attributes")  # an object, or a string that holds one
    box = F.coalesce(field(attributes, "bounding_box_rect", "bounding_box"), field(c, "bounding_box_rect", "bounding_box"))
    corners = box_corners(box)
    if scale_x is not None or scale_y is not None:
        scales = [F.lit(1.0) if s is None else s for s in (scale_x, scale_y)]
        corners = F.zip_with(corners, F.array(*scales, *scales), lambda v, s: v * s)
    flag = lambda k: F.coalesce(F.get_json_object(c, f"$.{k}").try_cast("boolean"), F.lit(False)).alias(k)
    return F.struct(field(c, "tag").alias("tag"), corners.alias("bbox_xyxy"), flag("is_original_target"), flag("is_top_level_target"), F.coalesce(field(c, "backend_node_id"), field(attributes, "backend_node_id")).alias("backend_node_id"), load_or_raw(c).alias("raw"))


def with_page(df: DataFrame, html: str = "cleaned_html", candidate_list: str = "pos_candidates") -> DataFrame:
    """``df`` with ``dom_elements`` of its page, normalised ``candidates`` and empty ``ocr_tokens``.

    Missing pages and lists give empty ones; text in images isn't read.
    """
    from ..functions.html import dom_summary

    listed = F.coalesce(F.col(candidate_list), F.array().cast("array<string>"))
    return df.withColumns({
        "dom_elements": dom_summary(html),
        "candidates": F.transform(listed, lambda c: candidates(c)),
        "ocr_tokens": F.array().cast("array<string>"),
    })
