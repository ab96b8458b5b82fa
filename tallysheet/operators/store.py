"""Writes as functions of old and new rows, and the writers that apply them: upserts, replacement, transfer between stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _null_safe(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in key:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every key of either; new rows replace old ones whole. Keys may be null and then equal null. The last of repeated new keys isn't defined: give them an order before."""
    o, n = old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"))
    return o.unionByName(n, allowMissingColumns=True).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(*old.columns)


def upsert_keep(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """As upsert, but a null in a new row never overwrites a value. Keys that are null match."""
    o, n = old.alias("o"), new.alias("n")
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns]
    return o.join(n, cond, "full_outer").select(*pick)


def upsert_in_state(old: DataFrame, new: DataFrame, key: Sequence[str], state: str) -> DataFrame:
    """old without the rows that new replaces, and new. A row is replaced by one of the same key (nulls are equal) and state; a row without a state by one of any state."""
    n = new.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(state).alias("_new_state"))
    same = old[state].isNull() | (old[state] == n["_new_state"])
    for k in key:
        same = old[k].eqNullSafe(n[f"_{k}"]) & same
    return old.join(n, same, "left_anti").unionByName(new)


def replace_by_parent(old: DataFrame, new: DataFrame, parents: DataFrame, key: Sequence[str]) -> DataFrame:
    """old without the rows of the given parents, and new. A parent without new rows loses its rows."""
    return old.join(parents.select(*key).distinct(), list(key), "left_anti").unionByName(new.select(*old.columns))


def shifted(rows: DataFrame, offset: int, keys: dict[str, int]) -> DataFrame:
    """rows with id and each foreign key moved by its parent's offset; null links stay null."""
    return rows.withColumns({"id": F.col("id") + offset} | {k: F.col(k) + v for k, v in keys.items()})


def max_id(rows: DataFrame, id_col: str = "id") -> int:
    return rows.agg(F.max(id_col)).first()[0] or 0


def scoped(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]], root: str, roots: DataFrame) -> dict[str, DataFrame]:
    """Tables cut to what hangs on the given roots by links (child, its column, parent, its column), in order: a chain of semi-joins."""
    out = {root: roots}
    for child, column, parent, parent_column in links:
        p = out[parent].select(F.col(parent_column).alias(column)).distinct()
        out[child] = tables[child].join(p, column, "left_semi").select(*tables[child].columns)
    return out


def backfill(stored: DataFrame, parsed: DataFrame, key: Sequence[str], total: str, values: Sequence[str]) -> DataFrame:
    """stored with the parsed values where both totals agree, and backfill: updated, mismatched, or null where nothing was parsed. Parsed rows that aren't stored are missing."""
    p = parsed.select(*key, F.col(total).alias("_total"), *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_there"))
    s = stored.withColumn("_stored", F.lit(True))
    j = s.join(p, list(key), "full_outer")
    status = F.when(F.col("_stored").isNull(), "missing").when(F.col("_there").isNull(), None).when(F.col(total).eqNullSafe(F.col("_total")), "updated").otherwise("mismatched")
    j = j.withColumn("backfill", status)
    return j.select(*key, *[F.when(F.col("backfill") == "updated", F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns if c not in key], "backfill")


def copy_tables(spark: SparkSession, names: Sequence[str], source: str, target: str, replace: bool = False) -> DataFrame:
    """Copies Parquet tables in order; refuses a target that exists unless replace. Gives (table, rows)."""
    counts = []
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("overwrite" if replace else "errorifexists").parquet(f"{target}/{name}.parquet")
        counts.append(spark.read.parquet(f"{target}/{name}.parquet").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def overwrite_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces only the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def with_missing_columns(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Additive migration: columns of the schema that rows lacks are added as nulls, none is changed or dropped."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in rows.columns})
