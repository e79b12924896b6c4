"""Scans: CSV, JSON and trial text, annotations in several formats, file listings."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from echotrail.functions.text import not_blank, path_labels, speaker_from_name
from echotrail.operators.columns import guess_columns

# Column names an annotation table may use, in order of preference (fixed values).
ANNOTATION_COLUMNS = {
    "audio_path": ["audio_path", "output_file", "file_path", "filename"],
    "file_id": ["file_id", "id"],
    "start": ["fabricated_start_sec", "suspicious_start_sec", "insert_start_sec", "start_sec"],
    "end": ["fabricated_end_sec", "suspicious_end_sec", "insert_end_sec", "end_sec"],
    "label": ["label", "annotation_label", "true_segment_label", "segment_ground_truth_label"],
}


def _csv(spark: SparkSession, multi_line: bool):
    """A strict reader: headers are compared with the schema file by file, broken records fail."""
    return (spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
            .option("mode", "FAILFAST").option("multiLine", multi_line))


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV with a declared schema. Every file's header must name its columns in order; `multi_line` admits line breaks
    inside quoted fields (such files are not split)."""
    return _csv(spark, multi_line).schema(schema).csv(path)


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False, keep_blank: bool = False) -> DataFrame:
    """CSV with every column as text; blank means missing, unless quoted blanks are kept apart from nulls."""
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path).limit(0).columns
    schema = StructType([StructField(n, StringType()) for n in names])
    # a null mark that is not blank keeps quoted blanks apart from missing fields
    reader = _csv(spark, multi_line).option("nullValue", "\x00") if keep_blank else _csv(spark, multi_line)
    raw = reader.schema(schema).csv(path)
    return raw if keep_blank else raw.select(*[not_blank(F.col(f"`{n}`")).alias(n) for n in names])


def csv_layouts(spark: SparkSession, path: str, multi_line: bool = False, keep_blank: bool = False) -> list[DataFrame]:
    """The CSV files of a folder as text, one strict read for each distinct header, in order of the headers.

    A job finds the first line of every file (only blocks at a file's start are looked at); files are grouped by it.
    Names are trimmed. Files without a line have no rows; a folder without any header is an error.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    layouts = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    if not layouts:
        raise ValueError(f"no CSV header below {path}")
    out = []
    for r in layouts:
        names = [n.strip() for n in next(csv.reader([r["header"]]))]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"repeated column in header {r['header']!r}")
        reader = _csv(spark, multi_line).option("ignoreLeadingWhiteSpace", False)
        reader = reader.option("nullValue", "\x00") if keep_blank else reader
        raw = reader.schema(StructType([StructField(n, StringType()) for n in names])).csv([unquote(f) for f in r["files"]])
        out.append(raw if keep_blank else raw.select(*[not_blank(F.col(f"`{n}`")).alias(n) for n in names]))
    return out


def read_csv_folder(spark: SparkSession, path: str, multi_line: bool = False, keep_blank: bool = False) -> DataFrame:
    """CSV files whose headers differ in order or columns, as one table of text; a column that a file lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), csv_layouts(spark, path, multi_line, keep_blank))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def explode_list(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per struct of an array column, its fields as columns."""
    return df.select(*keep, F.inline(column))


def map_annotations(df: DataFrame, source: str) -> DataFrame:
    """An annotation table in the common layout, whatever its column names."""
    found = guess_columns(df.columns, ANNOTATION_COLUMNS)
    col = lambda role: F.col(f"`{found[role]}`").cast("string") if found[role] else F.lit(None).cast("string")
    return df.select(F.lit(source).alias("source_annotation_file"), *[col(r).alias(r) for r in ANNOTATION_COLUMNS])


def read_annotations(spark: SparkSession, paths: Sequence[str], json_schema: str) -> DataFrame:
    """Annotation files of several formats, chosen by suffix, in one table."""
    out = None
    for p in paths:
        low = p.lower().rstrip("/")
        if low.endswith((".json", ".jsonl")):
            t = map_annotations(read_json(spark, p, json_schema, low.endswith(".jsonl")), p)
        elif low.endswith(".csv"):
            # each layout finds its own columns, so files of one folder may name them differently
            t = reduce(DataFrame.unionByName, [map_annotations(part, p) for part in csv_layouts(spark, p)])
        else:
            raise ValueError(f"no reader for {p}")
        out = t if out is None else out.unionByName(t)
    return out


def first_present(df: DataFrame, candidates: Sequence[str]):
    """Row-wise first non-blank value over the candidate columns the table has."""
    have = [not_blank(F.col(c).cast("string")) for c in candidates if c in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def read_trials(spark: SparkSession, path: str, dataset: str, spoof_attack: str) -> DataFrame:
    """Whitespace-delimited trial lines: fields 0, 1, 5 are speaker, file and label."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 6)
    real = F.col("p")[5] == "bonafide"
    return lines.select(
        F.col("p")[0].alias("speaker_id"), F.col("p")[1].alias("file_id"),
        F.when(real, "bonafide").otherwise("spoof").alias("label"), F.lit(dataset).alias("dataset"),
        F.when(real, "bonafide").otherwise(spoof_attack).alias("attack_type"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with size and time; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(path)
            .select("path", F.col("length").alias("size_bytes"), "modificationTime"))


def manifest_from_listing(files: DataFrame) -> DataFrame:
    """Manifest rows inferred from paths."""
    labels = path_labels(F.col("path"))
    return files.select(F.col("path").alias("filepath"), "size_bytes", *[v.alias(k) for k, v in labels.items()],
                        speaker_from_name(F.col("path")).alias("speaker_id"))


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file below a folder."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(path)
            .select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")))


def check_registry(spec: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Expected assets against the hashed listing: present, missing or warned."""
    j = spec.join(files, key, "left")
    return j.withColumn("action", F.when(F.col("sha256").isNotNull(), "present").otherwise("missing")).withColumn(
        "severity", F.when(F.col("sha256").isNotNull(), "none").when(F.col("required"), "error").otherwise("warning"))
