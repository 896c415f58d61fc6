"""Upserts, deletes and moves as keyed rewrites (MRG-1..6, DEL-1..4, UPD-1..2, JOIN-7, JOIN-8).

Plain Spark has no ``MERGE INTO`` for parquet tables, so an upsert is:

1. dedupe the incoming batch per key (last write wins, WIN-7);
2. split the target into untouched rows (partition value absent from the batch: passed
   through) and touched rows, by joins with the batch's distinct partition values;
3. full outer join touched rows with the batch on the key and apply the column rules;
4. (``write_table``) publish: dynamic partition overwrite of the touched partitions, or a
   staged full rewrite under the shared checkpoint folder.

The functions return the table after the change, lazily.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcraft.operators.windows import last_write_wins


def _touched_split(target: DataFrame, incoming: DataFrame, partition_col: str | None):
    """Untouched / touched target rows by the batch's partition values, null being a value like others.

    A semi and an anti join on the batch's distinct values; nothing is collected, and AQE
    broadcasts the values where they are measured small.
    """
    if partition_col is None:
        return None, target
    parts = incoming.select(F.col(partition_col).alias("_part")).distinct()
    same = F.col(partition_col).eqNullSafe(F.col("_part"))
    return target.join(parts, same, "left_anti"), target.join(parts, same, "left_semi")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str],
           order_col: str | None = None, partition_col: str | None = None,
           changed_col: str | None = None) -> DataFrame:
    """Keyed upsert with a rule per non-key column.

    rules: ``"new"`` — the batch value replaces the stored one (nulls included, MRG-3);
    ``"coalesce"`` — only non-null batch values replace (measures present in the load, MRG-2);
    ``"keep"`` — the stored value stays on conflict, the batch value is used for inserts
    (e.g. category in MRG-1). ``changed_col`` adds a flag true where a stored row changed
    or a row was inserted (UPD-2 ``updated_at`` stamping uses it).
    """
    cols = list(rules)
    batch = incoming.select(*keys, *cols, *([order_col] if order_col else []))
    inc = last_write_wins(batch, keys, order_col).drop(order_col) if order_col else batch
    untouched, touched = _touched_split(target.select(*keys, *cols), batch, partition_col)
    o = touched.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_o"))
    n = inc.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_n"))
    j = o.join(n, keys, "full_outer")
    has_new = F.col("_n").isNotNull()
    out_cols = []
    for c in cols:
        old, new = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        rule = rules[c]
        if rule == "new":
            e = F.when(has_new, new).otherwise(old)
        elif rule == "coalesce":
            e = F.when(has_new & new.isNotNull(), new).otherwise(old)
        elif rule == "keep":
            e = F.when(F.col("_o").isNotNull(), old).otherwise(new)
        else:
            raise ValueError(rule)
        out_cols.append(e.alias(c))
    res = j.select(*keys, *out_cols, *[F.col(f"_o_{c}") for c in cols], F.col("_o"))
    if changed_col:
        diff = F.lit(False)
        for c in cols:
            diff = diff | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        res = res.withColumn(changed_col, F.col("_o").isNull() | diff)
    res = res.drop(*[f"_o_{c}" for c in cols], "_o")
    if untouched is not None:
        if changed_col:
            untouched = untouched.withColumn(changed_col, F.lit(False))
        res = res.unionByName(untouched)
    return res


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``INSERT ... ON CONFLICT DO NOTHING`` (MRG-5 variant, MRG-6): anti join + union."""
    new = incoming.select(*target.columns).dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new)


def delete_where(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Delete rows whose key appears in ``doomed`` (DEL-1..3): a left-anti join."""
    return target.join(doomed.select(*keys).distinct(), keys, "left_anti")


def move(target: DataFrame, moves: DataFrame, key: str, col: str, new_col: str = "new_value") -> DataFrame:
    """UPD-1: ``col := coalesce(moves.new_value, col)`` joined on ``key``."""
    m = moves.select(F.col(key).alias("_mk"), F.col(new_col).alias("_mv"))
    return (target.join(m, F.col(key) == F.col("_mk"), "left")
                  .withColumn(col, F.coalesce(F.col("_mv"), F.col(col)).cast(target.schema[col].dataType))
                  .drop("_mk", "_mv"))


def assign_ids(new_members: DataFrame, order_cols: list[str], start: int, id_col: str) -> DataFrame:
    """Dense, deterministic ids ``start, start+1, ...`` in key order (JOIN-7).

    The members are range-partitioned and sorted, and written with their partition and their
    place in it. Row counts per partition (one row each) give every partition its offset.
    """
    from weekcraft.session import materialize
    parts = int(new_members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = materialize(new_members.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_at", F.monotonically_increasing_id()), "new-members")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return (placed.withColumn("_part", part).join(offsets, "_part")
            .withColumn(id_col, (F.lit(start) + F.col("_offset") + place).cast("long")).drop("_at", "_part", "_offset"))


def get_or_create(dim: DataFrame, incoming_keys: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """JOIN-7: the dimension with members for every incoming key (existing ones kept).

    New keys = distinct incoming keys anti-joined with the dimension; their ids continue
    after ``max(id)`` (one scalar fetched from the dimension).
    """
    new = incoming_keys.select(*keys).distinct().join(dim.select(*keys), keys, "left_anti")
    start = dim.agg(F.max(id_col)).first()[0]
    start = 1 if start is None else int(start) + 1
    created = assign_ids(new, keys, start, id_col)
    return dim.select(*keys, F.col(id_col).cast("long").alias(id_col)).unionByName(created)


def load_sites(dim: DataFrame, incoming: DataFrame, companies: DataFrame) -> DataFrame:
    """MRG-6: (company_id, name, site_id) with the absent sites of ``incoming`` (code, name) inserted.

    A code without a company inserts nothing, as the lookup finds no id.
    """
    known = incoming.join(companies.select("code", "company_id"), "code").select(F.col("company_id").cast(dim.schema["company_id"].dataType), "name")
    return get_or_create(dim, known, ["company_id", "name"], "site_id")


def first_per_group(df: DataFrame, group: Column, order_col: str, out_cols: list[str]) -> DataFrame:
    """JOIN-8: the first row (lowest ``order_col``) per group, via ``min_by`` (no window,
    partial aggregation map-side)."""
    packed = F.struct(*[F.col(c) for c in out_cols])
    return (df.groupBy(group.alias("_g")).agg(F.min_by(packed, F.col(order_col)).alias("_r"))
              .select("_g", *[F.col(f"_r.{c}").alias(c) for c in out_cols]))


def write_table(df: DataFrame, path: str, partition_cols: list[str] | None = None,
                staging: str | None = None, emptied: DataFrame | None = None) -> str:
    """Publish a rewritten table with the public writer API.

    With ``partition_cols``: ``df`` holds the touched partitions only and is written with
    dynamic partition overwrite, so only those partitions of the table are replaced. A partition that
    a delete has emptied has no row to replace it: ``emptied`` (distinct partition values) names
    the touched ones, and those without a row in ``df`` are removed. Without ``partition_cols``: the
    full result is first written to ``staging`` (it was computed from the old files), then
    copied over ``path``; a failure after the first write leaves a complete copy to re-publish from.
    """
    from weekcraft.session import remove_path, scratch_path
    spark = df.sparkSession
    if partition_cols:
        gone = []
        if emptied is not None:
            present = df.select(*[F.col(c).alias(f"_p_{c}") for c in partition_cols]).distinct()
            same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in partition_cols]
            gone = emptied.select(*[F.col(c) for c in partition_cols]).distinct().join(present, same, "left_anti").select(
                *[F.col(c).cast("string").alias(c) for c in partition_cols]).collect()
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*partition_cols).parquet(path))
        for r in gone:
            values = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else r[c]}" for c in partition_cols)
            remove_path(spark, f"{path.rstrip('/')}/{values}")
        return path
    if staging is None:
        staging = scratch_path(spark, "publish")
    df.write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").parquet(path)
    return path


def truncate(df: DataFrame) -> DataFrame:
    """DEL-4: an empty frame with the table's schema (publish it with ``write_table``)."""
    return df.sparkSession.createDataFrame([], df.schema)


def stamp_updated(df: DataFrame, changed_col: str, updated_col: str, now) -> DataFrame:
    """UPD-2: ``updated_at`` set to ``now`` only on rows the upsert changed or inserted."""
    keep = F.col(updated_col) if updated_col in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn(updated_col, F.when(F.col(changed_col), F.lit(now)).otherwise(keep)).drop(changed_col)


def delete_period_facts(weekly: DataFrame, daily: DataFrame, period_start, period_end,
                        all_days: bool = False) -> tuple[DataFrame, DataFrame]:
    """DEL-1: remove the weekly rows of one period and the daily rows of that period's sites
    whose day lies inside the period. ``all_days=True`` is the reference's wider form (every
    daily row of those sites). Returns (weekly, daily) after the delete."""
    in_period = F.col("period_start").eqNullSafe(F.lit(period_start).cast("date")) & \
                F.col("period_end").eqNullSafe(F.lit(period_end).cast("date"))
    doomed_sites = weekly.filter(in_period).select("site_id").distinct()
    kept_weekly = weekly.filter(~in_period)
    hit = daily.join(doomed_sites, "site_id", "left_semi")
    if not all_days:
        hit = hit.filter(F.col("day").between(F.lit(period_start).cast("date"), F.lit(period_end).cast("date")))
    keys = ["site_id", "day", "concept"]
    return kept_weekly, daily.join(hit.select(*keys), keys, "left_anti")
