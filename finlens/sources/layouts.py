"""Layout index of CSV files: which header each file of a source has.

The files of a source may differ in the order of their columns, lack some or
have more.  One distributed read brings the first line of every file, files
with equal headers form a layout, and every layout is one scan with its own
column names.  Only (file, header) rows reach the driver, as many as the scan
has to list anyway.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finlens.operators.conform import clean_column_names

_HEADER = "file string, header array<string>"


@dataclass(frozen=True)
class Layout:
    """Files, in order of their paths, that share a header."""

    header: tuple[str, ...]
    files: tuple[str, ...]


def parse_header(text: str) -> list[str]:
    """Cells of a header line as it stands (blanks and repeats included)."""
    return next(csv.reader([text.lstrip("﻿")], escapechar="\\"), [])


def _open_quote(text: str) -> bool:
    return text.replace('\\"', "").count('"') % 2 == 1


def _first_lines(whole_split: int, multi_line: bool):
    """Per file that starts in this task: its first line that is not blank
    (or, where cells may hold line breaks, its first record).

    A split of ``whole_split`` bytes is alone in its task, so the task ends
    after its first rows; smaller ones may be followed by other files and are
    read to their end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        begun: dict[str, list[str]] = {}
        for batch in batches:
            found = []
            spans = batch.column("file").dictionary_encode().indices.to_numpy()
            starts = [0, *((spans[1:] != spans[:-1]).nonzero()[0] + 1).tolist()]
            stops = [*starts[1:], batch.num_rows]
            ended = False
            for a, b in zip(starts, stops, strict=True):
                file, block, length = (batch.column(c)[a].as_py() for c in ("file", "block", "length"))
                if block == 0 and file not in done:
                    for i in range(a, b):
                        line = batch.column("value")[i].as_py()
                        lines = begun.setdefault(file, [])
                        if not lines and not line.strip("﻿ \t"):
                            continue
                        lines.append(line)
                        record = "\n".join(lines)
                        if multi_line and _open_quote(record):
                            continue
                        found.append((file, parse_header(record)))
                        done.add(file)
                        break
                ended = length >= whole_split and (block > 0 or file in done)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, _ in found]), pa.array([h for _, h in found], pa.list_(pa.string()))],
                    names=["file", "header"])
            if ended:
                return

    return run


def _size(text: str) -> int:
    """Bytes of a size setting such as 128MB or 134217728b."""
    t = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(t[-1:], 0)
    return int(t[:-1] if unit else t) << unit


def file_headers(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, header) of every file under ``path`` that has a line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.when(F.col("_metadata.file_block_start") == 0, F.col("value")).alias("value"))
    return lines.mapInArrow(_first_lines(_size(spark.conf.get("spark.sql.files.maxPartitionBytes")), multi_line), _HEADER)


def layouts(spark: SparkSession, path: str, multi_line: bool = False) -> list[Layout]:
    """The layouts of the files under ``path``, by their first file's path."""
    files: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(file_headers(spark, path, multi_line).collect()):
        files.setdefault(tuple(r["header"]), []).append(unquote(r["file"]))
    return [Layout(header, tuple(paths)) for header, paths in files.items()]


def read_layout(spark: SparkSession, layout: Layout, multi_line: bool = False) -> DataFrame:
    """One scan over the files of a layout: all-text columns under the names
    of the header, and ``row_ord``, a (file, block, position) struct that
    orders rows as the files do: by path, then by where the split starts, then
    by the row's place in its split (a split is read by one task, in order)."""
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(layout.header))])
    rows = (spark.read.schema(cells).option("header", "true").option("multiLine", str(multi_line).lower())
            .option("mode", "PERMISSIVE").csv(list(layout.files)))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )
    return rows.select("*", place.alias("row_ord")).toDF(*layout.header, "row_ord")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all layouts under the cleaned names of any; a column that a
    layout lacks is null there.  Columns come in the order of the layouts."""
    out = clean_column_names(frames[0])
    for frame in frames[1:]:
        out = out.unionByName(clean_column_names(frame), allowMissingColumns=True)
    data = [c for c in out.columns if c != "row_ord"]
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in data], "row_ord")
