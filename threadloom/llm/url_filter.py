"""Operator 13, URL filters: rules for hosts and paths first, a tree of path templates for all other URLs.

A rule fits its host, all subdomains, and paths that start with its own; the longest wins.
URLs that rules judge are the labelled ones. All paths of a host form a tree, a segment a
level, digits within a segment being one sign from the start. Level by level, segments that
are rare below their parent become one wildcard, and branches whose labelled shares do not
differ significantly are merged. A template is rejected if it has labelled URLs and its
purity, the share of allowed ones smoothed towards its host's and all hosts' share, is low.

The tree grows over distinct (host, path shape) pairs, which are grouped with partial sums;
a host, or a template, may hold any share of them: what a level decides is a table of at
most ``1 / rare`` branches a parent, and shapes are joined to it, never gathered by host.
Only rejected shapes are joined to the URLs that no rule fits. There is no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import stored, table

#: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Segments of a template; a longer path's other segments are one.
LEVELS = 8
#: A segment with fewer URLs than this share of its parent's, or than this number, becomes a wildcard.
RARE, LEAST = 0.02, 5
#: Two branches differ if their shares are so many standard errors apart.
APART = 1.96
#: URLs that the smoothing counts as, and the least purity.
WEIGHT, PURITY = 5.0, 0.5
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path without query and fragment; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that wins and its verdict, or nulls; of rules of one length, the longer host, then block, wins.

    ``rules`` is a short list: each is an expression.
    """
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in best]
    first = lambda of: reduce(lambda when, i: when.when(fits[i], F.lit(of(best[i]))), range(1, len(best)), F.when(fits[0], F.lit(of(best[0]))))
    return first(lambda r: r[0] + r[1]), first(lambda r: r[2])


def shapes(judged: DataFrame) -> DataFrame:
    """(host, shape, at, urls, labelled, blocked) of (host, path, rule, verdict): distinct paths but for digits; at: their segments."""
    shape = F.regexp_replace(F.substring("path", 2, F.length("path")), r"[0-9]+", "#")
    counts = judged.select("host", shape.alias("shape"), "verdict").groupBy("host", "shape")
    counts = counts.agg(F.count(F.lit(1)).alias("urls"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    return counts.withColumn("at", F.split("shape", "/", LEVELS))


def branches(level: DataFrame, rare: float = RARE, least: int = LEAST, apart: float = APART) -> DataFrame:
    """(host, template, seg, branch) for the segments that stay, of (host, template, seg, urls, labelled, blocked).

    Segments of one branch are next to each other in the order of their blocked shares, and
    none differs significantly from the next.
    """
    children = level.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")))
    parents = level.groupBy("host", "template").agg(F.sum("urls").alias("_all"))
    kept = children.filter(F.col("urls") >= least).join(parents, ["host", "template"]).filter(F.col("urls") >= rare * F.col("_all"))
    ordered = Window.partitionBy("host", "template", F.col("labelled") > 0).orderBy(F.col("blocked") / F.greatest("labelled", F.lit(1)), "seg")
    n, b = F.col("labelled"), F.col("blocked")
    n_before, b_before = F.lag("labelled").over(ordered), F.lag("blocked").over(ordered)
    pooled = (b + b_before) / F.greatest(n + n_before, F.lit(1))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(n_before, F.lit(1))))
    differs = F.abs(b / F.greatest(n, F.lit(1)) - b_before / F.greatest(n_before, F.lit(1))) > apart * error
    starts = F.coalesce((n == 0) | differs, F.lit(True)).cast("int")
    told = kept.withColumn("_starts", starts).withColumn("_branch", F.sum("_starts").over(ordered))
    of_branch = Window.partitionBy("host", "template", F.col("labelled") > 0, "_branch")
    return told.select("host", "template", "seg", F.concat_ws("|", F.array_sort(F.collect_list("seg").over(of_branch))).alias("branch"))


def templates(shaped: DataFrame, rare: float = RARE, least: int = LEAST, apart: float = APART) -> DataFrame:
    """(host, shape, template, urls, labelled, blocked) of ``shapes``: the host's tree, a level after the other."""
    deepest = shaped.agg(F.coalesce(F.max(F.size("at")), F.lit(0))).first()[0]
    tree = shaped.withColumn("template", F.lit(""))
    for k in range(deepest):
        level = tree.filter(F.size("at") > k).select("*", F.col("at")[k].alias("seg"))
        stay = branches(level, rare, least, apart)
        grown = level.join(stay, ["host", "template", "seg"], "left").withColumn("template", F.concat_ws("/", "template", F.coalesce("branch", F.lit(WILD)))).drop("seg", "branch")
        tree = stored(tree.filter(F.size("at") <= k).unionByName(grown), "templates")
    return tree.drop("at")


def purity(tree: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """(host, template, labelled, blocked, purity) of ``templates``: the share allowed, smoothed towards the host's, and that towards the share of all."""
    counts = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    each = stored(tree.groupBy("host", "template").agg(*counts), "template-counts")
    n, b = each.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    hosts = each.groupBy("host").agg(((F.sum("blocked") + weight * (b / n if n else 0.0)) / (F.sum("labelled") + weight)).alias("_host"))
    share = (F.col("blocked") + weight * F.col("_host")) / (F.col("labelled") + weight)
    return each.join(hosts, "host").select("host", "template", "labelled", "blocked", (1 - share).alias("purity"))


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, least_purity: float = PURITY, rare: float = RARE, least: int = LEAST, apart: float = APART, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, a row per row of df.

    A URL that is null or has no ``://`` has an empty host and path, like others of that kind;
    without labelled URLs a template is allowed. Ids may be null or repeated: only URLs count,
    and repeated URLs count each. A URL of any length is read whole; beyond ``LEVELS`` segments
    the rest is one segment of the template. Other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    host, path = host_and_path(F.coalesce(url_col, F.lit("")))
    parsed = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = stored(parsed.select("*", rule.alias("rule"), verdict.alias("verdict")), "urls")
    shape = F.regexp_replace(F.substring("path", 2, F.length("path")), r"[0-9]+", "#")
    tree = templates(shapes(judged), rare, least, apart)
    low = purity(tree).filter((F.col("labelled") > 0) & (F.col("purity") < least_purity)).select("host", "template")
    rejected = tree.filter("urls > labelled").join(low, ["host", "template"], "left_semi").select("host", "shape", F.lit("block").alias("_found"))
    ruled, others = judged.filter("verdict is not null"), judged.filter("verdict is null").withColumn("shape", shape)
    found = others.join(rejected, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("_found", F.lit("allow")).alias("verdict"))
    return ruled.unionByName(found)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
