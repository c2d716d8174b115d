"""Operator 11, source divergence audit: which sources of a language use its words unlike the others.

Plain relational. Texts are split at what is no letter, and the terms are exploded and
counted by (lang, source, term), together with the documents that hold them; a window over
(term, lang) keeps the terms of enough documents. Every group is crossed, within its language, with the kept
vocabulary, so that zeros count; the dense table joins itself on language and term, and
the divergences of two groups are summed. Windows rank.

The dense table has a row for each kept term and source of its language, and the join one
for each two sources: they grow with the vocabulary, not with the text, and with the
square of the number of sources of a language, as the result does. A language or a source
may hold any share of all rows: everything is dealt by term, and sums are combined in the
tasks before they are shuffled. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import stored, table

#: What stands between terms: a run of ASCII characters that are no letters. A term is a run of any others.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: Counts below this one keep SCALE * (count + 1) within 64 bits.
PLAIN = 9_000_000_000
#: Parts of a group whose terms are ranked side by side first.
SALTS = 64


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased; a text of ASCII characters alone takes the quicker way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def share(count: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (whole + terms)), exact for any counts; 1 where there are no terms."""
    of = F.greatest(whole + terms, F.lit(1))
    plain = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), of)
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), of.cast("decimal(20,0)"))
    return F.when(count < PLAIN, plain).otherwise(wide) + 1


def surprise(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def counted(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count, docs): occurrences, and rows that hold the term."""
    empty = F.lit("")
    found = df.select(F.coalesce(lang_col, empty).alias("lang"), F.coalesce(source_col, empty).alias("source"), F.split(ascii_lower(F.coalesce(text_col, empty)), BETWEEN).alias("_terms"))
    # each occurrence, and behind them each distinct term once more; no array is empty, and without
    # "outer" Spark would add a filter on the array's size that splits each text a second time
    each = found.select("lang", "source", F.size("_terms").alias("_n"), F.posexplode_outer(F.concat("_terms", F.array_distinct("_terms"))).alias("_at", "term"))
    return each.filter("term <> ''").groupBy("lang", "source", "term").agg(F.count_if(F.col("_at") < F.col("_n")).alias("count"), F.count_if(F.col("_at") >= F.col("_n")).alias("docs"))


def divergence(df: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by their distance, and the group's own terms.

    Null texts, languages and sources are empty ones. Rows count as documents: repeated rows
    count each, whatever their ids. A group without kept terms still has a row, of value 0,
    for each other source of its language; a lone source has no ``pair`` row. Ties go by the
    item's bytes. A text of any length is searched whole. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    # by the term first: sorts go by a key's first bytes, which a language's rows share
    of_term = Window.partitionBy("term", "lang")
    terms = counted(df, text_col, lang_col, source_col)
    kept = terms.withColumns({"_docs": F.sum("docs").over(of_term), "_lang_count": F.sum("count").over(of_term), "_first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = stored(kept.filter(F.col("_docs") >= least_docs).select("lang", "source", "term", "count", "_lang_count", "_first"), "kept-terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("_group"), F.count_if("_first").alias("_v"))
    groups = df.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source")).distinct().join(sums, ["lang", "source"], "left").na.fill(0)
    of_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "_group", F.sum("_group").over(of_lang).alias("_whole"), F.sum("_v").over(of_lang).alias("_terms"))
    # a row and a number for each source of a language; as it is stored, the number stays
    groups = stored(groups.withColumn("_g", F.monotonically_increasing_id()), "groups")

    one = kept.filter("_first").select("lang", "term").join(groups.select("lang", "_g"), "lang").select("lang", "term", "_g", F.lit(0).cast("long").alias("count"))
    seen = kept.join(groups.select("lang", "source", "_g"), ["lang", "source"]).select("lang", "term", "_g", "count")
    dense = one.unionByName(seen).repartition("term", "lang").groupBy("term", "lang", "_g").agg(F.sum("count").alias("count"))
    dense = dense.join(groups.select("_g", "_group", "_terms"), "_g").select("term", "lang", "_g", share(F.col("count"), F.col("_group"), F.col("_terms")).alias("_p"))
    other = dense.select("term", "lang", F.col("_g").alias("_o"), F.col("_p").alias("_q"))
    apart = dense.join(other, ["term", "lang"]).filter("_g != _o").groupBy("_g", "_o").agg(F.sum(surprise(F.col("_p"), F.col("_q"))).alias("value"))
    named = groups.select("lang", "source", "_g")
    pairs = named.join(named.select("lang", F.col("source").alias("item"), F.col("_g").alias("_o")), "lang").filter("_g != _o").join(apart, ["_g", "_o"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    order = [F.desc("value"), F.asc("item")]
    own = kept.join(groups, ["lang", "source"]).select("_g", F.col("term").alias("item"), share(F.col("count"), F.col("_group"), F.col("_terms")).alias("_p"), share(F.col("_lang_count"), F.col("_whole"), F.col("_terms")).alias("_q")).filter("_p > _q")
    own = own.select("_g", "item", surprise(F.col("_p"), F.col("_q")).alias("value"))
    salted = own.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("_rank", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*order)))
    best = salted.filter(F.col("_rank") <= top).join(named, "_g").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    of_group = Window.partitionBy("lang", "source").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(of_group)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(of_group)).unionByName(best)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: The same rows by DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS m
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT r, lang, source, unnest(m) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM e GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
w AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM v GROUP BY lang),
x AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS whole
      FROM g JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT lang, source, sum(n) AS n FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + 1000000000 * CAST(x.n + 1 AS HUGEINT) // (s.n + w.v) AS p, 1 + 1000000000 * CAST(x.whole + 1 AS HUGEINT) // (w.n + w.v) AS q
      FROM x JOIN s USING (lang, source) JOIN w USING (lang)),
a AS (SELECT l.lang, l.source, r.source AS item, sum((l.p - r.p) * (l.p - r.p) // r.p) AS value
      FROM p l JOIN p r ON l.lang = r.lang AND l.term = r.term AND l.source <> r.source GROUP BY ALL),
o AS (SELECT l.lang, l.source, 'pair' AS part, r.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value
      FROM g l JOIN g r ON l.lang = r.lang AND l.source <> r.source LEFT JOIN a ON a.lang = l.lang AND a.source = l.source AND a.item = r.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o
QUALIFY part = 'pair' OR rank <= 200
"""
