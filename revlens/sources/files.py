"""File sources and sinks.

CSV files are read with every column as STRING - coercion is the cleaning
step's job - so the scan is splittable and schema-stable. The delimiter
comes from the first records, the encoding of each file from all of its bytes
(one distributed pass that returns a row per file).
"""

from __future__ import annotations

import csv
import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.materialize import materialize

# Delimiter candidates, encodings tried in order.
DELIMITERS = (",", ";", "\t", "|")
ENCODINGS = ("UTF-8", "ISO-8859-1")
#: Lines that the delimiter is sought in; bytes of a file that are hashed at once.
SNIFFED_LINES, HASHED_BYTES = 200, 4 << 20


class SourceError(ValueError):
    pass


def resolve_source(spark: SparkSession, source) -> str:
    """A path, directory or glob (any Hadoop file system). Missing local
    paths raise FileNotFoundError; DataFrames and other objects are rejected
    with TypeError (bytes would have to travel through the driver)."""
    if isinstance(source, (str, os.PathLike)):
        path = os.fspath(source)
        has_scheme = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", path) is not None
        if not has_scheme and not any(ch in path for ch in "*?[") and not os.path.exists(path):
            raise FileNotFoundError(path)
        return path
    raise TypeError(f"unsupported source type {type(source).__name__}; pass a path or glob")


def first_lines(spark: SparkSession, path: str, most: int = SNIFFED_LINES) -> list[str]:
    """The first lines of the input's first file; only these reach the driver."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).limit(most).collect()
    if not rows:
        raise SourceError(f"{path} is empty")
    return [r["value"] for r in rows if r["file"] == rows[0]["file"]]


def sniff_delimiter(lines: str | list[str]) -> str:
    """The delimiter that splits the first records most evenly: of the
    candidates, and of other marks in the header, the one by which the largest
    share of records has the header's number of fields, then the one that gives
    more fields, then the earlier candidate. Quoted fields are read whole, so a
    delimiter within quotes doesn't count."""
    lines = [lines] if isinstance(lines, str) else lines
    bare = re.sub(r'"(?:[^"]|"")*"', "", lines[0])
    others = [c for c in dict.fromkeys(bare) if not (c.isalnum() or c.isspace() or c in "\"'_-.()/\\#%$&+")]
    best, found = (0.0, 1), DELIMITERS[0]
    for d in dict.fromkeys([*DELIMITERS, *others]):
        widths = [len(r) for r in csv.reader(lines, delimiter=d, quotechar='"') if r]
        if widths and widths[0] > 1:
            even = sum(w == widths[0] for w in widths) / len(widths)
            if (even, widths[0]) > best:
                best, found = (even, widths[0]), d
    return found


def file_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Encoding -> files. A file is UTF-8 if every line of it is valid UTF-8,
    else ISO-8859-1: one distributed pass over all bytes, one row per file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.is_valid_utf8("value").alias("ok"))
    out: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.bool_and("ok").alias("ok")).orderBy("file").collect():
        out.setdefault(ENCODINGS[0 if r["ok"] else 1], []).append(r["file"])
    return out


def sniff(spark: SparkSession, path: str) -> tuple[str, dict[str, list[str]]]:
    """(delimiter of the first records, files of each encoding)."""
    return sniff_delimiter(first_lines(spark, path)), file_encodings(spark, path)


def read_csv(spark: SparkSession, source, sep: str | None = None, encoding: str | None = None,
             multiline: bool = False) -> DataFrame:
    """Header row, auto-detected delimiter/encoding, all columns STRING.
    Files of different encodings are read each in its own and unioned by
    column name."""
    path = resolve_source(spark, source)
    sep = sep or sniff_delimiter(first_lines(spark, path))
    groups = {encoding: [path]} if encoding else file_encodings(spark, path)

    def load(enc: str, paths: list[str]) -> DataFrame:
        return (spark.read.option("header", True).option("sep", sep).option("encoding", enc)
                .option("inferSchema", False).option("multiLine", multiline).option("escape", "\"")
                .option("mode", "PERMISSIVE").csv(paths))

    try:
        parts = [load(enc, paths) for enc, paths in sorted(groups.items(), reverse=True)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    except Exception as exc:  # noqa: BLE001 - surface as a validation error
        raise SourceError(f"could not parse {path}: {exc}") from exc


def content_fingerprint(spark: SparkSession, source) -> DataFrame:
    """S3: one row per file: path, length and key ``sha256:<hex>``. Files are
    hashed in parallel; a task streams its file through the digest in pieces of
    ``HASHED_BYTES``, so a file's size doesn't matter. Where a task can't open
    the paths itself (a file system that only Spark reads), files are read
    whole, each as one binary value of at most 2 GB. Spark lists no empty files."""
    path = resolve_source(spark, source)
    files = spark.read.format("binaryFile").load(path)
    size = HASHED_BYTES

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array([file_digest(p, size) for p in batch.column("path").to_pylist()], type=pa.string())],
                                             names=["path", "length", "digest"])

    # path and length alone: no content is read here
    streamed = materialize(files.select("path", "length").mapInArrow(run, "path string, length long, digest string"), "digests")
    if not streamed.where(F.col("digest").isNull()).isEmpty():
        return files.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("file_hash"))
    return streamed.select("path", "length", F.concat(F.lit("sha256:"), F.col("digest")).alias("file_hash"))


def file_digest(path: str, size: int = HASHED_BYTES) -> str | None:
    """SHA-256 of a file's bytes, ``size`` at a time; None if it can't be opened."""
    from pyarrow import fs

    digest = hashlib.sha256()
    try:
        if path.startswith("file:"):
            system, name = fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
        else:
            system, name = fs.FileSystem.from_uri(path)
        with system.open_input_stream(name) as stream:
            while piece := stream.read(size):
                digest.update(piece)
    except (OSError, pa.ArrowException):
        return None
    return digest.hexdigest()


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header + RFC 4180 quoting (fields containing quote, delimiter or
    line breaks are quoted, quotes doubled); one file per partition, each
    with its header, written in parallel."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def csv_field(c) -> Column:
    """The export escape rule as a Column: NULL -> empty; a value containing
    '"', ',', LF or CR is wrapped in quotes with inner quotes doubled."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    needs = v.rlike('["\\,\\n\\r]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(df: DataFrame) -> DataFrame:
    """One ``line`` column per row in the quoted form; write it with
    ``.write.option("lineSep", "\\r\\n").text(path)`` for CRLF files."""
    return df.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in df.columns]).alias("line"))


def export_csv_crlf(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CRLF variant of S6: every file has the header line first and then its
    quoted rows, and files are written in parallel (one per partition). An empty
    table gives one file with the header."""
    names = [F.lit(c) for c in df.columns]
    header = F.concat_ws(",", *[csv_field(n) for n in names])
    if df.isEmpty():
        df.sparkSession.range(1).coalesce(1).select(header.alias("line")).write.mode(mode).option("lineSep", "\r\n").text(path)
        return
    rows = csv_lines(df).withColumn("nth", F.monotonically_increasing_id())
    # a partition's first row has a number whose low 33 bits are 0
    first = F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)) == 0
    both = rows.select(F.when(first, F.concat(header, F.lit("\r\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))
    both.write.mode(mode).option("lineSep", "\r\n").text(path)
