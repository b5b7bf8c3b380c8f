"""Files and their quirks: header rows among others, long column names, universe tables in html."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Mapping
from functools import cache
from typing import NamedTuple

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .html import table_values
from .workbooks import read_workbooks, with_header

#: Tickers that price vendors spell otherwise.
TICKER_SPELLING = {"BRK.B": "BRK-B", "BF.B": "BF-B", "-": "USD"}


@cache
def _local_folder() -> str:
    """One temporary folder for a process on a local master; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the cluster's executors share files. Where none is set: a temporary one on a
    local master, as in tests; on a cluster, whose executors could not see that, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or _local_folder()
    return f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: read again, also after executors were lost, and not cached.
    discard() deletes it; what a caller's result is made of stays."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the cluster's storage gives them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file of given content, such as a workbook."""
    found, store = hadoop_path(spark, path)
    out = store.create(found, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored(), once nothing reads them any more."""
    for df in tables:
        path, store = hadoop_path(df.sparkSession, df.stored_path)
        store.delete(path, True)


def read_csv(spark: SparkSession, path: str, schema: str, on_bad: str = "raise") -> DataFrame:
    """A csv file with a header, typed strictly: a cell that does not read as its column's type, such as a letter
    code among returns, or a row of another length, is an error when it is read. on_bad='null' makes
    such cells null; read_csv_checked() keeps their rows apart."""
    if on_bad not in ("raise", "null"):
        raise ValueError(f"on_bad is raise or null, not {on_bad!r}")
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST" if on_bad == "raise" else "PERMISSIVE")


class Checked(NamedTuple):
    """rows: typed, all cells good. rejected: the other rows as text, with bad_columns, the names of the
    columns whose cell does not read as their type, and record, the whole line where its length is wrong."""

    rows: DataFrame
    rejected: DataFrame


def read_csv_checked(spark: SparkSession, path: str, schema: str) -> Checked:
    """A csv file with a header: good rows and rejected ones. Every row is in one of them; empty cells are null
    and good. Both are lazy, and each reads the file once."""
    typed = spark.createDataFrame([], schema).schema
    raw = spark.read.schema(", ".join([*(f"`{f.name}` string" for f in typed), "record string"])).option("columnNameOfCorruptRecord", "record")
    rows = raw.csv(path, header=True, mode="PERMISSIVE")
    bad = [F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), F.lit(f.name)) for f in typed]
    rows = rows.withColumn("bad_columns", F.array_compact(F.array(*bad)))
    good = (F.size("bad_columns") == 0) & F.col("record").isNull()
    return Checked(rows.where(good).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in typed]), rows.where(~good))


def number_or_code(value: Column) -> tuple[Column, Column]:
    """A text's number, null if it is none, and its code, the text where it is not a number."""
    number = stripped(value).try_cast("double")
    return number, F.when(number.isNull(), F.nullif(stripped(value), F.lit("")))


def strict_number(value: Column) -> Column:
    """A text's number; a text that is none is an error, whatever the session's ANSI mode."""
    number, code = number_or_code(value)
    return F.when(code.isNotNull(), F.raise_error(F.concat(F.lit("not a number: "), code)).cast("double")).otherwise(number)


def read_by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    if suffix in ("xlsx", "xls"):
        return with_header(read_workbooks(spark, path))
    raise TypeError(f"unsupported file type: {suffix}")


def holdings_sheet(spark: SparkSession, path: str, key: str = "Ticker", value: str = "Weight", on_error: str = "raise") -> DataFrame:
    """rid, ticker, weight from a workbook whose header is somewhere below its first row. No such header
    or file: an error, or with on_error='empty' no rows."""
    try:
        rows = read_workbooks(spark, path).select("rid", "cells")
        if not rows.where(F.array_contains("cells", key)).isEmpty():
            return table_below_header(rows, key, value)
    except (AnalysisException, PythonException):
        if on_error != "empty":
            raise
    if on_error != "empty":
        raise ValueError(f"no row of {path} has a cell {key!r}")
    return spark.createDataFrame([], "rid long, ticker string, weight double")


def stripped(value: Column) -> Column:
    return F.btrim(value.cast("string"), F.lit(" \t\r\n\f\v"))


def stripped_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: stripped(F.col(c)) for c in columns if c in df.columns})


def short_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``(short) Description`` renamed to short, with the description as their comment; and
    short -> description. Other names stay. A description ends at a second closing bracket."""
    named = {c: re.match(r"\(([^)]*)\)([^)]*)", c) for c in df.columns}
    new = {c: (m[1].strip(), m[2].strip()) for c, m in named.items() if m}
    columns = [F.col(f"`{c}`").alias(new[c][0], metadata={"comment": new[c][1]}) if c in new else F.col(f"`{c}`") for c in df.columns]
    return df.select(*columns), dict(new.values())


def respelt(df: DataFrame, column: str = "ticker", spelling: Mapping[str, str] = TICKER_SPELLING) -> DataFrame:
    """Whole values replaced."""
    return df.replace(dict(spelling), subset=[column])


def table_below_header(rows: DataFrame, key: str = "Ticker", value: str = "Weight", percent: bool = True) -> DataFrame:
    """rid, ticker, weight of rows (rid long, cells array<string>) below the first that has a cell
    ``key``; rows after the last ticker are cut, and weights in percent become fractions.

    Bounds are aggregates of the sheet, so no row is moved to find them."""
    header = rows.where(F.array_contains("cells", key)).agg(F.min(F.struct("rid", "cells")).alias("h")).scalar()
    at = lambda name: F.get(F.col("cells"), (F.array_position(F.col("h.cells"), name) - 1).cast("int"))
    below = rows.withColumn("h", header).where(F.col("rid") > F.col("h.rid")).select("rid", stripped(at(key)).alias("ticker"), at(value).try_cast("double").alias("weight"))
    below = below.withColumn("ticker", F.nullif("ticker", F.lit("")))
    last = below.where(F.col("ticker").isNotNull()).agg(F.max("rid")).scalar()
    return below.where(F.col("rid") <= last).withColumn("weight", F.col("weight") / (100 if percent else 1))


def universe(pages: DataFrame, benchmark: str = "SPY", html: str = "html", column: str | None = None) -> DataFrame:
    """ticker, with ``.`` as ``-``: the named column of the pages' tables (html.table_values), or else the first
    cells of all table rows; and the benchmark if absent."""
    first = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<td[^>]*>\s*(?:<a[^>]*>)?\s*([A-Z][A-Z.]*)\s*(?:</a>)?\s*</td>"), F.lit(1))
    cells = pages.select(F.explode(first).alias("value")) if column is None else table_values(pages, column, html)
    found = cells.select(F.replace("value", F.lit("."), F.lit("-")).alias("ticker")).distinct()
    own = pages.sparkSession.createDataFrame([(benchmark,)], "ticker string")
    return found.unionByName(own.join(found, "ticker", "left_anti"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rid from 1 in the given order; a sheet's rows, not a corpus: they are ordered in one task."""
    return rows.withColumn("rid", F.row_number().over(Window.orderBy(*order)).cast("long"))
