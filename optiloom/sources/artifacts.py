"""Directories of artifacts: file listing by category and previews of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories by file extension.
CATEGORIES = {"image": ("bmp", "gif", "jpeg", "jpg", "png", "svg", "webp"), "table": ("csv", "tsv"), "text": ("json", "log", "md", "txt", "yaml", "yml"), "audio": ("mp3", "ogg", "wav"), "video": ("mov", "mp4", "webm"), "model": ("gltf", "obj", "onnx", "stl")}
PREVIEW_ROWS = 20
PAGE = 48


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, size, extension, category of every file that is not empty; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    ext = F.lower(F.substring_index(F.substring_index("path", "/", -1), ".", -1))
    kind = F.lit("other")
    for name, endings in CATEGORIES.items():
        kind = F.when(ext.isin(*endings), name).otherwise(kind)
    return files.select("path", "size", ext.alias("extension"), kind.alias("category"))


def preview_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path).limit(PREVIEW_ROWS)


def gallery_page(artifacts: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    return artifacts.orderBy("path").offset(page * size).limit(size)
