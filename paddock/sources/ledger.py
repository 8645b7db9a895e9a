"""Reading feeds with an account of what could not be read.

A reader here returns all records: typed columns, the file a record came from, and the
reason why it is bad (null for a good one). The good rows and the ledger (rows, bad rows
and reasons of every file) come from that one scan.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, ERROR, CORRUPT = "_file", "_error", "_corrupt_record"
FILE_OF = "_metadata.file_path"


def as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(CORRUPT, T.StringType())])


def checked(raw: DataFrame, schema: T.StructType, required: tuple[str, ...], corrupt: Column | None = None) -> DataFrame:
    """Text columns as the types of ``schema``. A record is bad when it can't be parsed, when a
    required value is missing, or when a value is there but not of its type; in this order."""
    text = lambda f: F.nullif(F.trim(F.col(f.name)), F.lit(""))
    typed = {f.name: text(f).try_cast(f.dataType) for f in schema}
    reason = F.when(corrupt if corrupt is not None else F.col(CORRUPT).isNotNull(), "unreadable record")
    for f in schema:
        if f.name in required:
            reason = reason.when(text(f).isNull(), f"no {f.name}")
    for f in schema:
        reason = reason.when(text(f).isNotNull() & typed[f.name].isNull(), f"bad {f.name}")
    return raw.select(*[typed[f.name].alias(f.name) for f in schema], FILE, reason.alias(ERROR))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV files with a header; a line with too few or too many fields is unreadable."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(as_text(schema)).csv(path)
    return checked(raw.withColumn(FILE, F.col(FILE_OF)), schema, required)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object per line."""
    lines = spark.read.text(path).select(F.col(FILE_OF).alias(FILE), "value").where(F.trim("value") != "")
    parsed = F.from_json("value", as_text(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return checked(lines.select(FILE, parsed.alias("r")).select(FILE, "r.*"), schema, required)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """Elements named ``row_tag`` whose children are the columns."""
    raw = (
        spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(as_text(schema)).load(path)
    )
    return checked(raw.withColumn(FILE, F.col(FILE_OF)), schema, required)


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                    out = [(path, n, z.read(n).decode("utf-8", "replace"), None) for n in names] or [(path, None, None, "empty archive")]
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError) as e:
                out = [(path, None, None, f"unreadable archive: {type(e).__name__}")]
            yield pd.DataFrame(out, columns=[FILE, "member", "text", ERROR])


def read_zips(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """Members of ZIP files as text; an archive that can't be read is one bad record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(_unzip, f"{FILE} string, member string, text string, {ERROR} string")


def good(records: DataFrame) -> DataFrame:
    return records.where(F.col(ERROR).isNull()).drop(FILE, ERROR)


def ledger(records: DataFrame, *by: Column) -> DataFrame:
    """One row per file (or other grouping): rows, bad rows, and the reasons with their counts, commonest first.

    Counts are taken per (file, reason) before the shuffle; a file has few reasons.
    """
    keys = by or (F.col(FILE),)
    names = [f"_k{i}" for i in range(len(keys))]
    n = records.groupBy(*[k.alias(a) for k, a in zip(keys, names)], ERROR).agg(F.count(F.lit(1)).alias("n"))
    bad = F.when(F.col(ERROR).isNotNull(), F.struct((-F.col("n")).alias("minus"), F.col(ERROR).alias("reason")))
    listed = F.transform(F.array_sort(F.collect_list(bad)), lambda x: F.concat(x["reason"], F.lit(": "), (-x["minus"]).cast("string")))
    out = n.groupBy(*names).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col(ERROR).isNotNull(), F.col("n"))), F.lit(0)).alias("n_bad"), F.array_join(listed, "; ").alias("reasons"))
    return out.withColumnRenamed("_k0", "file") if not by else out
