"""Files of unknown shape to clean all-text tables."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from casegrain.sources import clean

# Delimiters tried in this order, lines looked at, file kinds that are ingested.
DELIMITERS = [",", ";", "\t", "|", " "]
SNIFF_LINES = 10
SUPPORTED = [".csv", ".txt", ".json", ".jsonl"]
CORRUPT = "_corrupt_record"
QUOTED = re.compile(r'"(?:[^"]|"")*"')


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    header: bool
    columns: int


def _is_number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return False
    return True


def best_delimiter(lines: Sequence[str]) -> str:
    """The delimiter giving most columns: its count where all lines agree, else its mean count."""
    best, most = ",", 0
    for delimiter in DELIMITERS:
        counts = [QUOTED.sub("", line).count(delimiter) for line in lines]
        columns = counts[0] if len(set(counts)) == 1 else sum(counts) // len(counts)
        if columns > most:
            best, most = delimiter, columns
    return best


def looks_like_header(first: Sequence[str], second: Sequence[str]) -> bool:
    """Names only (no number, address or long text) above a line with a number, or a short first name."""
    names = [c.strip() for c in first if c.strip()]
    if any(_is_number(c) or len(c) > 50 or "@" in c or "://" in c for c in names):
        return False
    return any(_is_number(c.strip()) for c in second if c.strip()) or len(first[0]) < 30


def sniff(spark: SparkSession, path: str, encoding: str = "UTF-8") -> Dialect:
    """Dialect from the first lines of a file (at most ten reach the caller)."""
    head = (spark.read.option("encoding", encoding).text(path)
            .where(F.col("_metadata.file_block_start") == 0).limit(SNIFF_LINES))
    lines = [r["value"] for r in head.select("value").collect()]
    if not lines:
        return Dialect(",", False, 1)
    delimiter = best_delimiter(lines)
    rows = list(csv.reader(lines[:2], delimiter=delimiter))
    return Dialect(delimiter, len(rows) == 2 and looks_like_header(*rows), len(rows[0]))


def has_open_quotes(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether a line of the files has an odd number of quotes, as records that go on in the next line have."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.option("encoding", encoding).text(path).where(quotes % 2 == 1).head(1))


def read_delimited(spark: SparkSession, path: str, dialect: Dialect, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text plus ``_corrupt_record``, which holds lines of another width.

    Doubled quotes stand for one. Files with quoted line breaks are read whole, one task each; others in splits.
    """
    settings = {"sep": dialect.delimiter, "encoding": encoding, "quote": '"', "escape": '"',
                "multiLine": has_open_quotes(spark, path, encoding)}
    reader = (spark.read.options(**settings).option("mode", "PERMISSIVE")
              .option("ignoreLeadingWhiteSpace", True).option("columnPruning", False))
    if dialect.header:
        names = spark.read.options(**settings).option("header", True).csv(path).columns
    else:
        names = [f"column_{i}" for i in range(dialect.columns)]
    fields = [T.StructField(n, T.StringType()) for n in [*clean.clean_columns(names), CORRUPT]]
    return (reader.option("header", dialect.header).option("enforceSchema", True)
            .option("columnNameOfCorruptRecord", CORRUPT).schema(T.StructType(fields)).csv(path))


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantine(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows that loaded, (raw line, what could be parsed, reason, file) of those that did not)."""
    cells = F.to_json(F.struct(*[c for c in df.columns if c != CORRUPT]))
    bad = df.where(F.col(CORRUPT).isNotNull())
    return good_rows(df), bad.select(F.col(CORRUPT).alias("raw"), cells.alias("parsed"), F.lit(reason).alias("reason"),
                                     F.col("_metadata.file_path").alias("file"))


def csv_ingest(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text of unknown dialect: lines of another width skipped, empty and repeated rows and empty columns dropped.

    Which columns are empty is decided before repeats are dropped: that pass reads the file but shuffles nothing.
    """
    rows = clean.drop_empty_rows(good_rows(read_delimited(spark, path, sniff(spark, path, encoding), encoding)))
    return clean.dedup_rows(rows).drop(*clean.empty_columns(rows))


def _tidy_json(df: DataFrame) -> DataFrame:
    flat = clean.flatten_json(df)
    ordered = flat.select(*[F.col(f"`{c}`").cast("string") for c in sorted(flat.columns)])
    return clean.drop_empty_columns(clean.drop_empty_rows(clean.rename_clean(ordered)))


def json_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON array or object each. A file is one unit of work, so prefer many files or JSON lines."""
    return _tidy_json(spark.read.option("multiLine", True).option("primitivesAsString", True).option("mode", "FAILFAST").json(path))


def jsonl_ingest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; other lines are skipped."""
    return _tidy_json(spark.read.option("primitivesAsString", True).option("mode", "DROPMALFORMED").json(path))


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """Supported files below the folder. Only names are read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder if recursive else f"{folder}/*.*")
             .select("path").where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in SUPPORTED) + ")$")))
    return sorted(r["path"] for r in found.collect())


def ingest_file(spark: SparkSession, path: str) -> DataFrame:
    extension = path[path.rfind("."):].lower()
    readers = {".csv": csv_ingest, ".txt": csv_ingest, ".json": json_ingest, ".jsonl": jsonl_ingest}
    return readers[extension](spark, path)


def ingest_folder(spark: SparkSession, folder: str, target: str, recursive: bool = True, at_once: int = 4) -> DataFrame:
    """Load every supported file into its own table under ``target`` and report (file, table, status, rows, error).

    Every file becomes a table of its own, so each is its own Spark job, ``at_once`` of them side by side;
    a file that fails is reported and the rest go on. Tables are named by their path below the folder with its extension;
    where that is the same for two files, they are numbered.
    """
    def load(named: tuple[str, str]) -> tuple:
        path, name = named
        try:
            ingest_file(spark, path).write.mode("overwrite").parquet(f"{target}/{name}")
            return path, name, "ok", spark.read.parquet(f"{target}/{name}").count(), None
        except Exception as err:  # noqa: BLE001 - whatever a file does, the others are still loaded
            return path, name, "failed", 0, type(err).__name__

    files = list_files(spark, folder, recursive)
    below = [path[path.find(folder.split(":")[-1]) + len(folder.split(":")[-1]):] for path in files]
    names = clean.numbered([f"table_{n}" if n[0].isdigit() else n for n in ("_".join(re.findall(r"[a-z0-9]+", p.lower())) for p in below)])
    with ThreadPoolExecutor(at_once) as pool:
        report = list(pool.map(load, zip(files, names)))
    return spark.createDataFrame(report, "file string, table_name string, status string, rows bigint, error string")
