"""Ordered change operators shared by the dialects: islands, joins of chunks, prefix differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def started_groups(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """rows with island: how many starts there are up to a row."""
    return rows.withColumn("island", F.sum(starts.cast("long")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with island: a number for each run of equal values."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    marked = rows.withColumn("_new", ~before.eqNullSafe(F.col(value)))
    return started_groups(marked, keys, order, F.col("_new")).drop("_new")


def joined(value: str, order: str, between: str = "") -> Column:
    """Aggregate: the values in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), between)


def mutation(old: DataFrame, new: DataFrame) -> DataFrame:
    """One splice per session (session_id, place from 0, key) that turns old into new: after the common prefix all goes, and what is new comes.

    Sessions without a difference have no row.
    """
    both = old.withColumnRenamed("key", "_old").join(new.withColumnRenamed("key", "_new"), ["session_id", "place"], "full")
    differs = ~F.col("_old").eqNullSafe(F.col("_new"))
    found = both.groupBy("session_id").agg(F.min(F.when(differs, F.col("place"))).alias("index"), F.count("_old").alias("_n_old"), F.count("_new").alias("_n_new"), F.array_sort(F.collect_list(F.when(F.col("_old").isNotNull(), F.struct("place", "_old")))).alias("_keys"))
    gone = F.transform(F.filter("_keys", lambda x: x["place"] >= F.col("index")), lambda x: x["_old"])
    return found.filter("index is not null").select("session_id", F.col("index").cast("long").alias("index"), (F.col("_n_old") - F.col("index")).cast("long").alias("delete_count"), (F.col("_n_new") - F.col("index")).cast("long").alias("insert_count"), gone.alias("removed_keys"))


def block_changes(old: DataFrame, new: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a splice does to blocks: the columns of ``blocks`` with op and change_ord, deletes of removed keys first, then upserts of what comes.

    old, new: (session_id, place from 0, key) as for ``mutation``; blocks: (session_id, key,
    part, ...), a row for each block of a key. A key that moved is deleted and comes again.
    """
    splice = mutation(old, new)
    gone = splice.select("session_id", F.lit("delete").alias("op"), F.posexplode("removed_keys").alias("_at", "key"))
    come = new.join(splice.select("session_id", "index"), "session_id").filter("place >= index").select("session_id", F.lit("upsert").alias("op"), F.col("place").alias("_at"), "key")
    order = F.struct(F.col("op") == "upsert", F.col("_at").cast("long"), "part")
    told = gone.unionByName(come).join(blocks, ["session_id", "key"])
    return told.withColumn("change_ord", F.row_number().over(Window.partitionBy("session_id").orderBy(order))).select(*blocks.columns, "op", "change_ord")
