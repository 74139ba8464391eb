"""What input files are, and which of them cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest file that is read if nothing else is said.
MOST_BYTES = 50 * 1024 * 1024
#: Kinds of files by their extension.
KINDS = {"csv": "csv", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "webp": "image", "bmp": "image"}


def kind_of(path: Column) -> Column:
    """csv, pdf or image by a path's extension, null for any other."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), extension)


def plain(path: Column) -> Column:
    """A path with one slash behind its scheme, as listings and scans write it differently."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/*(?=/)", "$1:")


def inspect(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(path, length, kind, problem) of all files of a path, from their listing alone; problem is null where a file can be read. Spark's scan passes empty files over, its listing does not."""
    held = spark.read.format("binaryFile").load(path)
    most = MOST_BYTES if most_bytes is None else most_bytes
    listed = spark.createDataFrame([(x,) for x in held.inputFiles()], "path string").select(plain(F.col("path")).alias("path"))
    sized = held.select(plain(F.col("_metadata.file_path")).alias("path"), "length")
    files = listed.join(sized, "path", "left").na.fill({"length": 0}).withColumn("kind", kind_of(F.col("path")))
    megabytes = F.format_number(F.col("length") / 1048576, 1)
    problem = (
        F.when(F.col("length") > most, F.concat(F.lit("File too large ("), megabytes, F.lit(f" MB). Maximum is {most >> 20}MB.")))
        .when(F.col("length") == 0, "File is empty.").when(F.col("kind").isNull(), "Unsupported file type.")
    )
    return files.withColumn("problem", problem)


def refuse_bad(spark: SparkSession, path: str, kind: str, most_bytes: int | None = None) -> None:
    """Raise if any file of a path cannot be read or is of another kind, naming the first of them."""
    bad = inspect(spark, path, most_bytes).withColumn("problem", F.coalesce("problem", F.when(F.col("kind") != kind, F.concat(F.lit(f"Not a {kind} file but: "), "kind")))).where("problem IS NOT NULL")
    named = bad.orderBy("path").select("path", "problem").limit(5).collect()
    if named:
        raise ValueError(f"{bad.count()} files cannot be read: " + "; ".join(f"{r.path}: {r.problem}" for r in named))
