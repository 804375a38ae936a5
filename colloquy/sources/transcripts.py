"""Transcript files as tables of lines.

A file is read whole, one row each, because physical line numbers must be known; ``.gz`` files are unpacked by name.
"""

from __future__ import annotations

import gzip
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFAULT_HARNESS, OTHER_HARNESS, PROBED_LINES

#: Fixed values of the second format: its line types.
LINE_TYPES = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")

LINE_END = "\r?\n"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there; asks the file system that each names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        if target.getFileSystem(conf).exists(target):
            there.append(p)
    return there


def file_path() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def listed(spark: SparkSession, folders: list[str], pattern: str) -> DataFrame:
    """path, mtime_ms of the files below the folders, which aren't read."""
    folders = existing(spark, folders)
    if not folders:
        return spark.createDataFrame([], "path string, mtime_ms long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folders)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"))


def read_files(spark: SparkSession, folders: list[str], pattern: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """path, mtime_ms, text for all transcripts below the folders; folders that aren't there give nothing.

    A file is one row, so it is below 2 GB."""
    folders = existing(spark, folders)
    kind = "path string, mtime_ms long, text string"
    if not folders:
        return spark.createDataFrame([], kind)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    found = reader.text(folders, wholetext=True)
    return found.select(
        file_path().alias("path"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
        F.col("value").alias("text"),
    )


def lines_of(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line: every physical line, blank and broken ones too."""
    return files.select("path", F.posexplode(F.split("text", LINE_END)).alias("_at", "line")).select("path", (F.col("_at") + 1).cast("long").alias("line_no"), "line")


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``v``, the line as a variant, null where it is blank or no JSON."""
    return lines.withColumn("v", F.try_parse_json("line"))


def get(path: str, kind: str = "string", v: Column | str = "v") -> Column:
    return F.try_variant_get(v if isinstance(v, Column) else F.col(v), f"$.{path}", kind)


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def text_at(path: str) -> Column:
    """A string in the line, null where what stands there is none."""
    at = get(path, "variant")
    return F.when(at.isNotNull() & is_text(at), get(path))


def is_other() -> Column:
    """Whether the line is one of the second format."""
    there = get("payload", "variant")
    falsy = F.coalesce(F.to_json(there).isin("null", "false", "0", '""'), F.lit(True))
    return F.coalesce(text_at("type").isin(*LINE_TYPES) & ~falsy, F.lit(False))


def harness_of(other: Column) -> Column:
    return F.when(F.coalesce(other, F.lit(False)), F.lit(OTHER_HARNESS)).otherwise(F.lit(DEFAULT_HARNESS)).alias("harness")


def detect_formats(lines: DataFrame) -> DataFrame:
    """path, harness: by the first line that is JSON; files without one are of the first format."""
    found = parsed(lines).groupBy("path").agg(F.min_by(F.when(F.col("v").isNotNull(), is_other()), F.when(F.col("v").isNotNull(), F.col("line_no"))).alias("_other"))
    return found.select("path", harness_of(F.col("_other")))


def lines_by_format(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of the files of each format, which a file's own row tells as ``detect_formats`` does: no line is shuffled."""
    first = F.aggregate(
        F.split("text", LINE_END), F.lit(None).cast("string"), lambda known, line: F.when(known.isNotNull(), known).otherwise(F.when(F.try_parse_json(line).isNotNull(), line))
    )
    known = files.select("path", "text", F.try_parse_json(first).alias("v")).select("path", "text", harness_of(is_other()))
    return lines_of(known.filter(F.col("harness") == DEFAULT_HARNESS)), lines_of(known.filter(F.col("harness") == OTHER_HARNESS))


def recorded_cwd(lines: DataFrame) -> DataFrame:
    """path, cwd: the first working directory among a file's first 50 lines."""
    cwd = F.coalesce(F.nullif(text_at("cwd"), F.lit("")), F.nullif(text_at("payload.cwd"), F.lit("")))
    probed = parsed(lines.filter(F.col("line_no") <= PROBED_LINES)).withColumn("_cwd", cwd).filter("_cwd is not null")
    return probed.groupBy("path").agg(F.min_by("_cwd", "line_no").alias("cwd"))


def text_between(lines: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """path, text: the lines ``start`` to ``end`` (from 1, both included) of each path, as they stand in it."""
    some = lines.filter(F.col("line_no").between(max(1, start or 1), end if end is not None else (1 << 62)))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return some.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def read_range(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> str:
    """Lines ``start`` to ``end`` of one transcript; the driver returns a single file to a caller."""
    if not existing(spark, [path]):
        raise FileNotFoundError(path)
    files = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    row = text_between(lines_of(files), start, end).first()
    return row.text if row else ""


def project_of_path(path: Column) -> Column:
    """The name of the folder that a transcript is in."""
    return F.coalesce(F.nullif(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")), F.lit("unknown"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def write_gzip(source: str, target: str) -> None:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(source, "rb") as i, gzip.open(target + ".part", "wb") as o:
        while data := i.read(1 << 20):
            o.write(data)
    stat = os.stat(source)
    os.utime(target + ".part", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    os.replace(target + ".part", target)
