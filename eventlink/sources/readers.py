"""Read CSV extracts by a declared specification.

Every column is read as text and converted by its declared kind, so no inference pass touches the data
and codes keep their leading zeros. Only the declared columns are kept.
"""

from __future__ import annotations

import csv
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlink.functions import codes, times
from eventlink.session import durable


@dataclass(frozen=True)
class Field:
    """A column of an extract: its name there, its name here, and how to convert it.

    Kinds: text, long, double, number (whole, with thousands separators), date, datetime (bad text
    becomes null), strict (bad text is an error), day_first, logger.
    """

    source: str
    name: str
    kind: str = "text"
    optional: bool = False


@dataclass(frozen=True)
class Joined:
    """A timestamp from a date column and a time column."""

    date: str
    time: str
    name: str


@dataclass(frozen=True)
class Spec:
    name: str
    fields: tuple[Field, ...]
    joined: tuple[Joined, ...] = ()
    sentinels: tuple[str, ...] = ()
    encoding: str = "ISO-8859-1"
    options: dict = field(default_factory=dict)


_CONVERSIONS = {
    "text": lambda c: c,
    "long": lambda c: F.trim(c).try_cast("bigint"),
    "double": lambda c: codes.as_number(c, "double"),
    "number": lambda c: codes.as_number(c, "bigint"),
    "date": times.parse_day,
    "datetime": times.parse,
    "strict": times.parse_strict,
    "day_first": times.parse_day_first,
    "logger": lambda c: times.parse(c, times.LOGGER_FORMAT),
}

_TYPES = {
    "text": "string",
    "long": "bigint",
    "double": "double",
    "number": "bigint",
    "date": "date",
}


@dataclass(frozen=True)
class Sheet:
    """Where the table lies in a file: rows above its header, and its first and last column by their letters."""

    preamble: int = 0
    first: str | None = None
    last: str | None = None

    def columns(self) -> slice:
        return slice(_place(self.first) if self.first else 0, _place(self.last) + 1 if self.last else None)


def _place(letters: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    n = 0
    for letter in letters.upper():
        n = n * 26 + ord(letter) - ord("A") + 1
    return n - 1


@dataclass(frozen=True)
class Scan:
    """Rows of all files under the names here, and what was left out: ``path``, ``line`` (null: the file), ``reason``."""

    rows: DataFrame
    quarantine: DataFrame


#: Different headers among the files of one scan at most.
LAYOUTS = 200
# Cells beyond the header's columns, and the file; these names cannot be in a header, which is one line.
_BEYOND, _PATH = "\nbeyond", "\npath"


def _lines(spark: SparkSession, paths: str | list[str], spec: Spec, skip_unreadable: bool) -> DataFrame:
    """path, the block's first byte, a number that grows within a block, and the line."""
    text = spark.read.option("ignoreCorruptFiles", skip_unreadable).text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.decode(F.col("value").cast("binary"), spec.encoding).alias("line"),
    )


def numbered_lines(spark: SparkSession, paths: str | list[str], spec: Spec, skip_unreadable: bool = False) -> DataFrame:
    """(path, number from 1, line). Lines are numbered within their blocks; blocks begin where those before them end."""
    lying = durable(_lines(spark, paths, spec, skip_unreadable))
    runs = lying.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lying.join(runs, ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("number"), "line")


def _plain(path: str) -> str:
    """One spelling of a file's address; listings and metadata write local ones differently."""
    return unquote(path).replace("file:///", "file:/")


def _column_names(header: str, spec: Spec) -> list[str]:
    """Names as the header gives them; blank ones are ``Unnamed: k``, repeated ones get a number."""
    options = {"delimiter": spec.options.get("sep", spec.options.get("delimiter", ",")), "quotechar": spec.options.get("quote", '"')}
    cells = next(csv.reader([header.removeprefix("\ufeff").removeprefix("ï»¿").rstrip("\r")], **options), [])
    names, seen = [], {"source_file"}
    for k, cell in enumerate(cells):
        name = given = cell or f"Unnamed: {k}"
        again = 0
        while name.lower() in seen:
            again += 1
            name = f"{given}.{again}"
        seen.add(name.lower())
        names.append(name)
    return names


def _missing(names: list[str], spec: Spec) -> list[str]:
    missing = [f.source for f in spec.fields if f.source not in names and not f.optional]
    return missing + [c for j in spec.joined for c in (j.date, j.time) if c not in names]


def _read_layouts(
    spark: SparkSession, paths: str | list[str], spec: Spec, sheet: Sheet, skip_unreadable: bool
) -> tuple[list[DataFrame], list[tuple[str, None, str]]]:
    """Per header the cells as text with path and source_file, and the files left out."""
    lines = numbered_lines(spark, paths, spec, skip_unreadable) if sheet.preamble or sheet.first or sheet.last else None
    if lines is None:
        first = _lines(spark, paths, spec, skip_unreadable).where("block = 0")
        first = first.groupBy("path").agg(F.min_by("line", "at").alias("header"))
    else:
        first = lines.where(F.col("number") == sheet.preamble + 1).select("path", F.col("line").alias("header"))
    # The driver lists every file anyway; of the headers it sees the different ones. Empty files have no lines.
    grouped = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files"))
    found = sorted(grouped.collect(), key=lambda r: r["files"])
    known = {_plain(path) for r in found for path in r["files"]}
    unseen = [path for path in map(_plain, spark.read.text(paths).inputFiles()) if path not in known]
    if len(found) > LAYOUTS:
        raise ValueError(f"{spec.name}: more than {LAYOUTS} different headers")
    parts, left_out = [], [(path, None, "no header could be read") for path in sorted(unseen)]
    for header, files in found:
        names = _column_names(header or "", spec)
        missing = _missing(names[sheet.columns()], spec)
        if not names:
            left_out += [(path, None, "no header could be read") for path in files]
        elif missing:
            left_out += [(path, None, f"columns not found: {', '.join(missing)}") for path in files]
        elif lines is None:
            parts.append(_cells(spark, files, names, spec, skip_unreadable))
        else:
            inside = lines.where(F.col("path").isin(files) & (F.col("number") > sheet.preamble + 1) & (F.trim("line") != ""))
            parts.append(_sheet_cells(inside, names, spec, sheet))
    return parts, left_out


def _cells(spark: SparkSession, files: list[str], names: list[str], spec: Spec, skip_unreadable: bool) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BEYOND]])
    reader = spark.read.schema(schema).options(**_options(spec)).option("header", True)
    reader = reader.option("encoding", spec.encoding).option("ignoreCorruptFiles", skip_unreadable)
    source = [F.col("_metadata.file_path").alias(_PATH), F.col("_metadata.file_name").alias("source_file")]
    return reader.csv(files).select("*", *source)


def _sheet_cells(lines: DataFrame, names: list[str], spec: Spec, sheet: Sheet) -> DataFrame:
    schema = ", ".join(f"c{k} string" for k in range(len(names) + 1))
    parsed = lines.select("path", F.from_csv("line", schema, _options(spec)).alias("cells"))
    places = [*range(len(names))[sheet.columns()], len(names)]
    cells = [F.col(f"cells.c{k}").alias([*names, _BEYOND][k]) for k in places]
    return parsed.select(*cells, F.col("path").alias(_PATH), F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("source_file"))


def _options(spec: Spec) -> dict:
    return {"quote": '"', "escape": '"', "mode": "PERMISSIVE", **spec.options}


def _united(spark: SparkSession, parts: list[DataFrame], spec: Spec) -> DataFrame:
    if not parts:
        names = [*(f.source for f in spec.fields), *(c for j in spec.joined for c in (j.date, j.time)), "source_file"]
        parts = [spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)]))]
    return reduce(lambda a, b: a.unionByName(b), [convert(part, spec) for part in parts])


def scan(
    spark: SparkSession, paths: str | list[str], spec: Spec, sheet: Sheet = Sheet(), skip_unreadable: bool = False
) -> Scan:
    """Files and folders whose headers may differ, united by column name.

    A first pass takes the files' first lines and groups the files by them; every group is then read with a
    schema of its own. Files without the declared columns, empty ones and (``skip_unreadable``) those that cannot be read go to
    the quarantine, as do rows with more cells than their header. Short rows end in nulls. A compressed
    file that breaks off gives the lines before the break. Quotes are doubled inside quoted text, which ends with its line.

    A ``sheet`` with rows above its header, or other columns around its own, is read by line numbers.
    """
    parts, left_out = _read_layouts(spark, paths, spec, sheet, skip_unreadable)
    beyond = _named(_BEYOND)
    quarantine = spark.createDataFrame(left_out, "path string, line string, reason string")
    for part in parts:
        cells = F.concat_ws(",", *[_named(c) for c in part.columns if c not in (_PATH, "source_file")])
        long = part.where(beyond.isNotNull()).select(_named(_PATH).alias("path"), cells.alias("line"), F.lit("more cells than the header").alias("reason"))
        quarantine = quarantine.unionByName(long)
    return Scan(_united(spark, [part.where(beyond.isNull()) for part in parts], spec), quarantine)


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def convert(raw: DataFrame, spec: Spec) -> DataFrame:
    """Declared columns under their names here, sentinels turned to null, converted by kind."""
    missing = _missing(raw.columns, spec)
    if missing:
        raise ValueError(f"{spec.name}: columns not found: {', '.join(missing)}")

    def text(name: str) -> Column:
        column = _named(name)
        return codes.null_if_listed(column, spec.sentinels) if spec.sentinels else column

    columns = []
    for f in spec.fields:
        if f.source in raw.columns:
            columns.append(_CONVERSIONS[f.kind](text(f.source)).alias(f.name))
        else:
            columns.append(F.lit(None).cast(_TYPES.get(f.kind, "timestamp_ntz")).alias(f.name))
    columns += [times.parse_joined(text(j.date), text(j.time)).alias(j.name) for j in spec.joined]
    return raw.select(*columns, "source_file")


def read(spark: SparkSession, paths: str | list[str], spec: Spec, skip_unreadable: bool = False) -> DataFrame:
    """Files or folders as one table, by column name.

    What :func:`scan` leaves out is an error here; with ``skip_unreadable`` it is left out here as well.
    """
    if skip_unreadable:
        return scan(spark, paths, spec, skip_unreadable=True).rows
    parts, left_out = _read_layouts(spark, paths, spec, Sheet(), False)
    if left_out:
        raise ValueError(f"{spec.name}: {left_out[0][2]} ({left_out[0][0]})")
    told = F.raise_error(F.concat(F.lit(f"{spec.name}: more cells than the header in "), _named(_PATH))).cast("boolean")
    fits = F.when(_named(_BEYOND).isNotNull(), told).otherwise(F.lit(True))
    return _united(spark, [part.where(fits) for part in parts], spec)


def read_alike(spark: SparkSession, paths: list[str], spec: Spec) -> list[DataFrame]:
    """One table per file or folder."""
    return [read(spark, path, spec) for path in paths]


def snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage as Parquet and go on from the written files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def fingerprint(spark: SparkSession, paths: str | list[str]) -> str:
    """A digest of the names, sizes and times of all files there; nothing of their contents is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    rows = files.select("path", "length", F.unix_micros("modificationTime").alias("at")).collect()
    return hashlib.sha256(json.dumps(sorted(map(tuple, rows))).encode()).hexdigest()


def kept_snapshot(
    spark: SparkSession,
    path: str,
    inputs: list[str],
    build: Callable[[], DataFrame],
    parameters: str = "",
    partition_by: list[str] | None = None,
) -> DataFrame:
    """The stage that ``build`` gives, written once and read again as long as it is that of its inputs.

    Beside the data, in ``<path>.about``, lie the schema and the digests of the input files, the parameters and the written
    files. It is written last; a snapshot whose inputs or parameters changed, or that was left half written, is built anew.
    """
    given = {"inputs": fingerprint(spark, inputs), "parameters": parameters}
    try:
        about = json.loads(spark.read.text(f"{path}.about", wholetext=True).first()[0])
        if {k: about[k] for k in given} == given and about["files"] == fingerprint(spark, path):
            return spark.read.schema(T.StructType.fromJson(about["schema"])).parquet(path)
    except (AnalysisException, TypeError):
        pass  # nothing there yet
    written = snapshot(build(), path, partition_by)
    about = {**given, "schema": json.loads(written.schema.json()), "files": fingerprint(spark, path)}
    line = spark.createDataFrame([(json.dumps(about),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}.about")
    return written


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
