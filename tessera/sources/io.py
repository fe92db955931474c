"""Reading and writing labelled rows.

Text sources carry the file's name and the line's ordinal, because order
decides which of two rows wins and which line an error message names.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import strict_json
from tessera.operators.layout import lookup

BOM = "﻿"


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, line_no, line): every line of every file, blank ones counted.

    Files are read in splits.  The lines of a split are counted first; a line's
    number is its place in its split and the lines of the file's splits before.
    Line breaks are \\n, \\r\\n or \\r.
    """
    split = ["file", "split"]
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    counted = lines.groupBy(*split).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.select(*split, (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("__add"))
    out = lines.join(lookup(placed), split).select("file", (F.col("at") + F.col("__add")).alias("line_no"), "line")
    return out.withColumn("line", F.when(F.col("line_no") == 1, F.regexp_replace("line", f"^{BOM}", "")).otherwise(F.col("line")))


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], mode: str = "failfast") -> DataFrame:
    """(file, line_no, row variant) of the lines that aren't blank.

    S1, S3 ``failfast``: a bad line ends the query with file and line number.
    S2 ``permissive``: bad lines have a null row.
    S4 ``resume``: a bad last line of a file is dropped, any other bad line ends the query.
    S5 ``marker``: a file with a bad line has one row {"id": "__LOAD_ERROR__"} instead of its rows.
    """
    rows = numbered_lines(spark, paths).filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    rows = rows.withColumn("row", strict_json(F.col("line")))
    where = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"))
    if mode == "failfast":
        rows = rows.withColumn("row", F.when(F.col("row").isNull(), F.raise_error(F.concat(F.lit("bad JSON at "), where)).cast("variant")).otherwise(F.col("row")))
    elif mode == "resume":
        last = rows.groupBy(F.col("file").alias("f")).agg(F.max("line_no").alias("last"))
        rows = rows.join(lookup(last), F.col("file") == F.col("f")).filter(F.col("row").isNotNull() | (F.col("line_no") < F.col("last")))
        rows = rows.withColumn("row", F.when(F.col("row").isNull(), F.raise_error(F.concat(F.lit("bad JSON before the last line, at "), where)).cast("variant")).otherwise(F.col("row")))
    elif mode == "marker":
        bad = rows.filter("row is null").groupBy(F.col("file").alias("f")).agg(F.min("line_no").alias("bad"))
        rows = rows.join(bad, F.col("file") == F.col("f"), "left")
        marker = F.parse_json(F.lit('{"id":"__LOAD_ERROR__"}'))
        rows = rows.filter("bad is null or line_no = bad").withColumn("row", F.when(F.col("bad").isNotNull(), marker).otherwise(F.col("row")))
    elif mode != "permissive":
        raise ValueError(mode)
    return rows.select("file", "line_no", "row")


def import_rows(existing: DataFrame, incoming: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to add, counts): malformed rows and known or repeated ids are skipped, the first of an id stays."""
    from tessera.operators.validate import duplicates

    named = incoming.withColumn("__key", F.try_variant_get("row", f"$.{key}", "string"))
    first = duplicates(named.filter("__key is not null"), ["__key"], ["file", "line_no"]).filter("not is_duplicate").drop("occurrence", "is_duplicate")
    new = first.join(existing.select(F.col(key).alias("__key")), "__key", "left_anti")
    counts = named.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("__key").isNull()).alias("malformed"))
    return new.drop("__key"), counts


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON value in a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_glob(spark: SparkSession, pattern: str, without: Sequence[str] = ()) -> list[str]:
    """The files of a glob in order of depth and name, those named left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted((s.getPath().toString() for s in found), key=lambda p: (p.count("/"), p))
    return [n for n in names if n.rsplit("/", 1)[-1] not in set(without)]


def locate(spark: SparkSession, root: str, name: str) -> list[str]:
    """The files of that name anywhere below ``root``, the least deep first, then by path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        p = files.next().getPath()
        if p.getName() == name:
            found.append(p.toString())
    return sorted(found, key=lambda p: (p.count("/"), p))


def read_union(spark: SparkSession, pattern: str, without: Sequence[str] = (), mode: str = "failfast") -> DataFrame:
    """The rows of all files of a glob but those named."""
    names = read_glob(spark, pattern, without)
    if not names:
        raise FileNotFoundError(pattern)
    return read_jsonl(spark, names, mode)


#: S12. Fixed formats: the lines a device writes for each run.
RESULT_LINE = r"BENCH_RESULT run=(\d+) ttft_ms=(-?\d+) tps=(-?[\d.]+) tool=(\S+) ok=(true|false)"
MEMORY_LINE = r"BENCH_RAM run=(\d+) used_mb=(\d+)"


def parse_results(lines: DataFrame, line: str = "line") -> DataFrame:
    """(run, ttft_ms, tps, tool, ok) of the result lines."""
    part = lambda i: F.regexp_extract(F.col(line), RESULT_LINE, i)
    return lines.filter(F.col(line).rlike(RESULT_LINE)).select(
        part(1).try_cast("bigint").alias("run"), part(2).try_cast("bigint").alias("ttft_ms"), part(3).try_cast("double").alias("tps"), F.nullif(part(4), F.lit("null")).alias("tool"), (part(5) == "true").alias("ok")
    )


def parse_memory(lines: DataFrame, line: str = "line") -> DataFrame:
    part = lambda i: F.regexp_extract(F.col(line), MEMORY_LINE, i).try_cast("bigint")
    return lines.filter(F.col(line).rlike(MEMORY_LINE)).select(part(1).alias("run"), part(2).alias("used_mb"))


def content_hash(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """K8: (path, sha256 in upper case)."""
    return spark.read.format("binaryFile").load(paths).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))


def require_hash(spark: SparkSession, path: str, sha256: str) -> None:
    """K8: raises unless the file's content is as frozen."""
    found = content_hash(spark, path).first()
    if found is None or found.sha256 != sha256.upper():
        raise ValueError(f"{path}: content isn't the frozen one ({found.sha256 if found else 'missing'})")


def write_jsonl(rows: DataFrame, path: str, single: bool = False, append: bool = False) -> None:
    """K1, K2, K9: JSON lines in the order of the columns; ``single``: one file, for small results only."""
    (rows.coalesce(1) if single else rows).write.mode("append" if append else "errorifexists").option("ignoreNullFields", False).json(path)


def _whole(rows: DataFrame, most: int) -> list:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows; a report is written whole or not at all")
    return found


def write_report(report: DataFrame, path: str, most: int = 10_000) -> None:
    """K3: a small aggregate as one indented JSON document; an error beyond ``most`` rows."""
    text = json.dumps([r.asDict(recursive=True) for r in _whole(report, most)], ensure_ascii=False, indent=2, default=str)
    report.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def ledger_columns(rows: DataFrame, lists: Sequence[str] = (), objects: Sequence[str] = ()) -> DataFrame:
    """K4: lists joined by |, objects as JSON text, booleans as True and False."""
    out = rows
    for c in lists:
        out = out.withColumn(c, F.array_join(c, "|"))
    for c in objects:
        out = out.withColumn(c, F.to_json(c))
    for name, kind in rows.dtypes:
        if kind == "boolean":
            out = out.withColumn(name, F.initcap(F.col(name).cast("string")))
    return out


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """K4, K5: with a header; ``bom`` puts a byte order mark before the first column's name."""
    if bom:
        rows = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    rows.write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger by its schema; quotes inside quotes are doubled."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def markdown(table: DataFrame, title: str, columns: Sequence[str] | None = None, most: int = 1000) -> str:
    """K6: a small table as Markdown, bars escaped; an error beyond ``most`` rows."""
    columns = list(columns or table.columns)
    rows = _whole(table.select(*columns), most)
    if not rows:
        return f"## {title}\n\nNo rows.\n"
    cell = lambda v: ("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])


def replace_with_backup(rows: DataFrame, path: str, backup: str) -> None:
    """K7: what lies at ``path`` is moved to ``backup`` before the new rows are written."""
    jvm = rows.sparkSession._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(backup)
    fs = old.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(new):
            raise FileExistsError(backup)
        fs.rename(old, new)
    rows.write.parquet(path)


def canonical_pairs(value: Column) -> Column:
    """An object variant's keys and JSON values, sorted by key."""
    given = F.try_variant_get(value, "$", "map<string,variant>")
    return F.transform(F.array_sort(F.map_keys(given)), lambda k: F.struct(k.alias("key"), F.to_json(F.element_at(given, k)).alias("value")))
