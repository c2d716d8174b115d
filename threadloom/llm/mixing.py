"""Operator 3, mixing sources to target weights: weighted fair queueing, DataFrame functions only.

Each source's documents are shuffled by a hash and queued up to ``repeats`` times over. A
copy's virtual finish time is its source's cumulative words divided by the source's
target. All copies are sorted by it globally and cut off at the total budget. A copy that
would only start after its source has its target is left out, so that no source makes up
for what another's long documents leave open.

No step needs a whole source, or the whole queue, in one task: cumulative sums are taken
within ranges of the shuffle hash (source, range) and of the finish time, and the totals
of the ranges before are added. One task sorts only the range in which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import NO_ID, WORD, numbered, partitions, stored, table, with_key

WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """A row per source with its target; needs _key, source, source_size.

    Sources share the total by weight; none gets over ``repeats`` times its own size, and the
    excess is shared again. In the order of size over weight, the shares that result if the
    sources before are capped rise while sources are capped and then fall, so that the
    largest of them is the final one.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * repeats
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weights_left = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    shared = sources.withColumn("_weight", weight).withColumn("_cap", cap).withColumn("_share", left.cast("double") / weights_left.cast("double"))
    target = F.least(F.col("_cap").cast("double"), F.max("_share").over(whole) * F.col("_weight"))
    return shared.select("_key", "source_size", target.alias("target"))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken.

    Whole documents are taken, ``repeats`` times at most; the words taken of a source miss its
    target by less than one document. A null text has size 0 and nothing is
    taken of it. Null sources form one source, after all others. Rows equal in id, source and
    size can't be told apart and may swap places, which changes no result. Rows with null ids
    keep an order by size. Other columns are ignored; an empty table gives no rows.
    """
    queue = _mixed(df, weights, repeats, id_col, text_col, source_col)
    return queue.select("doc_id", "size", "source_size", "target", "taken")


def repeated(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows and columns, each row as often as the mix takes it; rows like ``mix``.

    Rows that are equal in id, text and source share what the mix takes of them, in the
    order of their other columns; each stays a row of its own.
    """
    taken = _mixed(df, weights, repeats, id_col, text_col, source_col).groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "_hash", "_key")
    of_times = [F.count_if(F.col("_times") >= k).alias(f"_times_{k}") for k in range(1, repeats + 1)]
    times = stored(taken.agg(F.count(F.lit(1)).alias("_rows"), *of_times), "times")
    docs = with_key(df, id_col, text_col).withColumn("_key", _source_key(F.col("row").getField(source_col))).join(times.hint("shuffle_hash"), ["_id", "_hash", "_key"])
    several = times.filter("_rows > 1").agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    if several:
        others = F.to_json(F.struct(*(F.col("row")[c] for c in df.columns if c != text_col))).alias("_others")
        ranked = numbered(docs.filter("_rows > 1").select("*", others), ["_id", "_hash", "_key"], ["_others"], "_rank", several).drop("_others")
        docs = docs.filter("_rows = 1").withColumn("_rank", F.lit(0).cast("long")).unionByName(ranked)
    else:
        docs = docs.withColumn("_rank", F.lit(0).cast("long"))
    copies = sum((F.when(F.col("_rank") < F.col(f"_times_{k}"), 1).otherwise(0) for k in range(1, repeats + 1)), F.lit(0))
    return docs.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def _mixed(df: DataFrame, weights: tuple[int, ...], repeats: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = _source_key(F.col(source_col))
    no_id = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))  # spreads rows without an id
    hashed = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), no_id)))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    docs = stored(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(source_col).alias("source"), size.alias("size"), key.alias("_key"), hashed.alias("_order")), "sizes")
    rows, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(partitions(df.sparkSession), rows // 50_000)

    dealt = docs.withColumn("_range", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("int"))
    sums = dealt.groupBy("_key", "_range").agg(F.first("source").alias("source"), F.sum("size").alias("_sum"))
    targets = source_targets(sums.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")), weights, repeats)
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(targets, "_key").select("_key", "_range", "source_size", "target", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_key", "_range").orderBy("_order", "doc_id", "size", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    queue = dealt.withColumn("_cum", F.sum("size").over(within)).join(starts, ["_key", "_range"])
    queue = stored(queue.select("doc_id", "_hash", "_key", "size", "source_size", "target", (F.col("_start") + F.col("_cum")).alias("_cum")), "queue")

    def finish(r):
        """A copy's virtual finish time; null if it would only start after its source has its target."""
        done = F.lit(r).cast("long") * F.col("source_size") + F.col("_cum")
        return F.when(done - F.col("size") < F.col("target"), done.cast("double") / F.col("target"))

    def slot(at):
        return F.floor(F.least(at, F.lit(4.0)) * ranges)

    live = (F.col("target") > 0) & (F.col("size") > 0)
    copies = queue.filter(live).select("size", F.explode(F.array(*map(finish, range(repeats)))).alias("_finish")).filter("_finish is not null").withColumn("_slot", slot(F.col("_finish")))
    slots = copies.groupBy("_slot").agg(F.sum("size").alias("_sum"))  # 4 x ranges rows at most
    running = slots.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)))
    over = running.filter(F.col("_upto") > total).orderBy("_slot").select("_slot", (F.col("_upto") - F.col("_sum")).alias("_before")).first()
    if over is None:
        admitted = lambda at: at.isNotNull()
    else:
        sorted_part = copies.filter(F.col("_slot") == over["_slot"]).withColumn("_upto", F.sum("size").over(Window.partitionBy("_slot").orderBy("_finish")))
        last = sorted_part.filter(F.col("_upto") + over["_before"] <= total).agg(F.max("_finish")).first()[0]
        admitted = lambda at: (slot(at) < over["_slot"]) | (at <= F.lit(-1.0 if last is None else last))
    times = sum((F.when(admitted(finish(r)), 1).otherwise(0) for r in range(repeats)), F.lit(0))
    taken = F.when(live, times).otherwise(0)
    return queue.withColumns({"_times": taken, "taken": (F.col("size") * taken).cast("long")})


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same rows by DuckDB, from a table or subquery of documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))))) AS h
  FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
q AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE)
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS share
      FROM w WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(share) OVER () * weight) AS target FROM q),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
             row_number() OVER () AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT k, size, CAST(r * source_size + cum AS DOUBLE) / target AS finish FROM c, (VALUES (0), (1), (2)) v(r) WHERE target > 0 AND size > 0 AND r * source_size + cum - size < target),
u AS (SELECT *, sum(size) OVER (ORDER BY finish) AS upto FROM f),
n AS (SELECT k, count(*) AS times FROM u WHERE upto <= (SELECT sum(size) FROM d) GROUP BY k)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken FROM c LEFT JOIN n USING (k)
"""
