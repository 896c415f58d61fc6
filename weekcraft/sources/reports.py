"""Wide report files (SRC-1, SRC-3, SCH-1..4, SCH-9) and file sinks (SNK-1, SNK-2, SNK-5).

A weekly report is read with every column as text (no inference); header names are
normalised and classified on the driver (O(columns)); rows are never brought to the
driver. ``to_cells`` melts the day columns into the cell form the ingest jobs consume.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcraft.functions import clean as C

# Required and optional normalised headers of the weekly report.
REQUIRED_MATRIX = ["empresa", "establecimiento", "concepto", "a_total"]
REQUIRED_LOAD = ["empresa_cod", "establecimiento", "categoria", "concepto"]
WEEK_HEADERS = ["n_semana", "semana", "n°_semana"]


# SCH-1 in one translation: spaces become '_', dots, NBSP and BOM go away.
_HEADER_CHARS = str.maketrans({" ": "_", ".": None, "\u00a0": None, "\ufeff": None})


def normalize_col(col) -> str:
    """SCH-1: lower-case header without outer blanks, NBSP, BOM and dots; spaces as '_', pairs of '_' as one."""
    trimmed = str(col).strip(" \t\r\n\u00a0\ufeff")
    return re.sub("__", "_", trimmed.lower().translate(_HEADER_CHARS))


def date_columns(columns: list[str]) -> list[str]:
    """SCH-2: headers shaped like d-m-yyyy."""
    return [c for c in columns if C.is_date_header(c)]


def validate(df: DataFrame, required: list[str]) -> list[str]:
    """SCH-3 / QLT-1: structural errors (missing columns, no date column, no rows)."""
    errors = [f"missing column: {c}" for c in required if c not in df.columns]
    if not date_columns(df.columns):
        errors.append("no date column (d-m-yyyy)")
    if df.isEmpty():
        errors.append("empty report")
    return errors


def read_week_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC-1: CSV report(s) with one header, all text, headers normalised (date headers kept as written)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = [c if C.is_date_header(c.strip()) else normalize_col(c) for c in df.columns]
    names = [c.strip() for c in names]
    df = df.toDF(*names)
    # SCH-4: optional columns
    if "empresa_cod" not in df.columns and "empresa" in df.columns:
        df = df.withColumn("empresa_cod", F.col("empresa"))
    week_col = next((c for c in WEEK_HEADERS if c in df.columns), None)
    if week_col and week_col != "semana":
        df = df.withColumnRenamed(week_col, "semana")
    return df.withColumn("row_no", F.monotonically_increasing_id())


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 over a folder whose files may differ in their headers: the cells of all reports.

    The header line of each file groups the files (one row per file); each group is read with its own
    columns and melted, and the cells are joined by name. ``report_row`` is a row of one file.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()
    cells = None
    for i, g in enumerate(groups):
        part = to_cells(read_week_report(spark, list(g["files"]))).withColumn("report_row", F.concat_ws(":", F.lit(str(i)), F.col("row_no").cast("string")))
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        raise ValueError(f"no report below {path}")
    return cells


def to_cells(report: DataFrame) -> DataFrame:
    """Melt a wide report into the cell form used by ``plans.report`` (RSH-2, DT-3, RSH-5).

    Week and ISO year come from the ``semana`` column when present, else from the
    earliest parseable date header of the report.
    """
    days = date_columns(report.columns)
    ids = [c for c in ["empresa", "empresa_cod", "establecimiento", "categoria", "concepto", "a_total", "semana",
                       "row_no"] if c in report.columns]
    # One array of cells per row, exploded: the generated code of an unpivot with the parsing that follows does not compile.
    long = report.select(*ids, F.inline(F.array(*[F.struct(F.lit(d).alias("day_text"), F.col(f"`{d}`").cast("string").alias("cell_text")) for d in days])))
    parsed = [C.parse_day(F.lit(d)) for d in days]
    first_day = F.least(*parsed) if len(parsed) > 1 else parsed[0]
    total = F.col("a_total") if "a_total" in report.columns else F.lit(None).cast("string")
    week = C.safe_int(F.col("semana")) if "semana" in report.columns else C.iso_week(first_day)
    return long.select(
        F.col("empresa").alias("company") if "empresa" in ids else F.lit(None).cast("string").alias("company"),
        F.col("empresa_cod").alias("company_code_raw") if "empresa_cod" in ids else F.lit(None).cast("string")
        .alias("company_code_raw"),
        F.col("establecimiento").alias("site_raw"),
        F.col("categoria").alias("category") if "categoria" in ids else F.lit(None).cast("string").alias("category"),
        F.col("concepto").alias("concept_raw"),
        C.iso_year(first_day).cast("int").alias("year"), week.try_cast("int").alias("week"),
        "day_text", "cell_text", total.alias("total_text"), "row_no", F.col("row_no").alias("report_row"))


def read_typed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """SRC-3: typed read with an explicit schema (no inference)."""
    r = spark.read.schema(schema)
    return r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)


def write_matrix(matrix: DataFrame, path: str, by: str = "margin", ascending: bool = False, files: int | None = None) -> None:
    """SNK-1: matrix export in several files whose names keep the order: body by ``by``, nulls last, then the total row.

    A range partition holds the rows between two sort keys and is one file; files are named by their partition, so reading
    them in the order of their names gives the sorted matrix without one task that holds all of it.
    """
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    order = [F.col("is_total").asc(), key, F.col("site").asc()]
    files = files or int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    matrix.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def read_versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SCH-9: a folder of Parquet files written under several versions of a table, read as its present schema.

    Files are grouped by their own schema (read from the footers, some at a time); each group is read with it and conformed: a
    column that it lacks is null, a narrower number is widened, and one that would have to be narrowed is refused.
    """
    from concurrent.futures import ThreadPoolExecutor
    from functools import reduce

    from weekcraft.operators.reshape import conform
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    with ThreadPoolExecutor(16) as pool:
        own = list(pool.map(lambda f: spark.read.parquet(f).schema, files))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for f, s in zip(files, own, strict=True):
        groups.setdefault(s.json(), (s, []))[1].append(f)
    return reduce(DataFrame.unionByName, [conform(spark.read.schema(s).parquet(*fs), schema) for s, fs in groups.values()])


def write_daily_by_site(detail: DataFrame, path: str, site_col: str = "site") -> None:
    """SNK-2: one folder per site, all sites in one job."""
    detail.write.mode("overwrite").partitionBy(site_col).option("header", True).csv(path)


def append_log(spark: SparkSession, path: str, record: dict) -> None:
    """SNK-5: append one audit record of a load."""
    spark.createDataFrame([record]).write.mode("append").parquet(path)

