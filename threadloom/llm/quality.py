"""Operator 5, quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A document's own evidence is a logistic regression on words and shapes that differ
between the labelled classes. Sites add theirs: a host's (source's) rate is shrunk toward
the global rate, a path's (source and language's) toward its host's, each with a strength
that the spread between sites sets (method of moments). A document's posterior joins its
evidence with its path's odds, itself left out of its site's counts.

Fitting uses at most ``sample`` labelled rows (20,000), chosen by a hash of their ids;
everything else covers all documents. Two such models run at once: quality and toxicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import NO_ID, key, stored, table, worker_cache

TARGETS = ("quality", "toxic")
SPACES = {c: " " for c in (9, 10, 11, 12, 13)}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lengths of the word beginnings that count as features, for inflected words.
BEGINNINGS = (4, 5, 6)


def features(text: str) -> set[str]:
    """The distinct words of a whole text, in lower case and without outer punctuation, their beginnings, and what it looks like."""
    words = text.encode().lower().decode().translate(SPACES).split(" ")
    words = [w for w in words if w]
    n = len(words)
    if not n:
        return {" empty"}
    bare = [w.strip(PUNCTUATION) for w in words]
    found = set(bare)
    found.discard("")
    noisy = sum(len(w) - len(b) >= 3 for w, b in zip(words, bare, strict=True))
    lines = text.split("\n")
    shares = {"noisy": noisy, "marks": bare.count(""), "repeated": sum(map(str.__eq__, words, words[1:])), "distinct": len(found), "digits": sum(map(str.isdigit, bare))}
    look = [f" {name} {min(9, 10 * k // n)}" for name, k in shares.items()]
    look += [f" lines {10 * (len(lines) - len(set(lines))) // len(lines)}", f" length {n.bit_length()}"]
    for k in BEGINNINGS:
        look += {w[:k] + "~" for w in found if len(w) > k}
    found.update(look)
    return found


def choose(counts: list[tuple[str, int, int, int]], n: int, ones: tuple[int, int], most: int = 600) -> dict[str, tuple[int, int]]:
    """Features that tell a target's classes apart, most of each target at most, and the sign of each for each target.

    Their rates differ by 5 standard errors, and their odds by a factor of 4: common words
    that lean a little would only let a small sample be learned by heart.
    """
    names = [c[0] for c in counts]
    total = np.array([c[1] for c in counts], float)
    signs: dict[str, list[int]] = {}
    for t in (0, 1):
        with_one, n1 = np.array([c[2 + t] for c in counts], float), ones[t]
        if not len(counts) or not 0 < n1 < n:
            continue
        rate, with_none = total / n, total - with_one
        z = (with_one / n1 - with_none / (n - n1)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / (n - n1)))
        lift = np.log((with_one + 0.5) / (n1 - with_one + 0.5)) - np.log((with_none + 0.5) / (n - n1 - with_none + 0.5))
        clear = (np.abs(z) >= 5) & (np.abs(lift) >= np.log(4)) & (np.sign(z) == np.sign(lift))
        for _, i in sorted((-abs(z[i]), i) for i in sorted(np.flatnonzero(clear), key=names.__getitem__))[:most]:
            signs.setdefault(names[i], [0, 0])[t] = int(np.sign(z[i]))
    return {f: tuple(signs[f]) for f in sorted(signs)}


def regress(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, signs: np.ndarray, steps: int = 600, penalty: float = 0.03) -> np.ndarray:
    """Logistic regression on sparse 0/1 features (the last weight is the intercept), by Adam with a ridge penalty.

    A weight keeps the sign of its feature's own lift; it is 0 where that is 0.
    """
    n, width = len(y), len(signs)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    rate = (y.sum() + 0.5) / (n + 1)
    w[width] = np.log(rate / (1 - rate))
    for k in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + w[width]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(cols, gap[rows], width) + penalty * w[:width], gap.sum()) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w[:width] = np.where(signs * w[:width] > 0, w[:width], 0)
    return w


def majority(target: str) -> Column:
    """The label that most rows of a group have, ties to 0."""
    return (2 * F.sum(target) > F.count(F.lit(1))).cast("int").alias(target)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most: int = 600, least_share: float = 1 / 2000) -> tuple[dict[str, tuple[float, float]], tuple[float, float]]:
    """Weights of the chosen features for each target, and the intercepts. docs: _id, _hash, text; labels: _id, quality, toxic, a row per id.

    ``sample`` labelled rows at most are learned from, in the order of a hash of their ids;
    equal texts count once, with the labels of most of them. A feature is considered if
    ``least_share`` of them have it, and 4 at least; ``most`` are kept for each target.
    """
    some = labels.filter("quality is not null and toxic is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = docs.join(F.broadcast(some), "_id").groupBy("_hash").agg(F.first("text").alias("text"), majority("quality"), majority("toxic"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1), batch.column(2)], ["f", "quality", "toxic"])

    drawn = stored(chosen.select("text", "quality", "toxic").mapInArrow(look, "f array<string>, quality int, toxic int"), "labelled")  # sample rows at most
    n, q, x = drawn.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return {}, (0.0, 0.0)
    each = drawn.select(F.explode("f").alias("f"), "quality", "toxic").groupBy("f")
    counts = each.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("x")).filter(F.col("n") >= max(4, int(n * least_share))).collect()
    names = choose([(r["f"], r["n"], r["q"], r["x"]) for r in counts], n, (q, x), most)
    number = {f: i for i, f in enumerate(names)}
    signs = np.array(list(names.values())).reshape(-1, 2)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[f] for f in fs if f in number) for fs in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["f", "quality", "toxic"])

    got = drawn.mapInArrow(use, "f array<int>, quality int, toxic int").orderBy("f", "quality", "toxic").toArrow()
    lists = got.column("f").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    rows, cols = np.repeat(np.arange(n), sizes), lists.values.to_numpy()
    weights = [regress(rows, cols, got.column(t).to_numpy().astype(float), signs[:, i]) for i, t in enumerate(TARGETS)]
    return {f: (float(weights[0][i]), float(weights[1][i])) for f, i in number.items()}, tuple(float(w[-1]) for w in weights)


def evidence(docs: DataFrame, weights: dict[str, tuple[float, float]], base: tuple[float, float]) -> DataFrame:
    """Each document's own log odds for each target."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("evidence", dict)
        for batch in batches:
            hits = [[weights[f] for f in sorted(weights.keys() & features(t or ""))] for t in batch.column("text").to_pylist()]
            odds = [pa.array([base[i] + sum(h[i] for h in hit) for hit in hits], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *odds], [*batch.schema.names[:-1], *TARGETS])

    kept = docs.select("doc_id", "_id", "_hash", "_host", "_path", "text")
    return kept.mapInArrow(each, T.StructType([*kept.schema.fields[:-1], *(T.StructField(t, T.DoubleType()) for t in TARGETS)]))


def odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def exact_sum(x: Column) -> Column:
    """A sum that comes out the same in whatever order rows are added."""
    return F.sum(x.cast("decimal(28,12)")).cast("double")


def strength(sites: DataFrame, n: str, total: str, mean: float) -> float:
    """Prior rows that a site's rate is worth: within over between variance, by the method of moments."""
    rate = F.col(total) / F.col(n)
    r = sites.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), exact_sum(F.col(n) * (rate - mean) ** 2).alias("ss"), F.sum(F.col(n).cast("double") ** 2).alias("nn")).first()
    if not r["k"] or r["k"] < 2:
        return 100.0
    within = max(mean * (1 - mean), 1e-9)
    between = (r["ss"] - (r["k"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(max(within / between if between > 0 else 1e4, 10.0), 1e4))


def judge(df: DataFrame, labels: DataFrame, sample: int = 20_000, least_quality: float = 0.5, most_toxic: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Per row: doc_id, its evidence, host and path rates, posteriors of quality and toxicity, and keep.

    keep: p_quality is ``least_quality`` or more and p_toxic under ``most_toxic``. A null text is judged as an empty one. Null
    hosts and paths are sites of their own; a null id has no label. Repeated rows are judged
    alike. Null labels don't count; of repeated ones the majority does, ties to 0, and so of
    the labels of equal texts. Without any labels all rows get even odds, and are kept. A
    text of any length is judged by all its words. Other columns are ignored, whatever their
    names. An empty table gives no rows. Results don't depend on how rows are partitioned.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), *key(id_col, text_col), name(host_col).alias("_host"), F.concat(name(host_col), F.lit("/"), name(path_col)).alias("_path"), F.col(text_col).alias("text"))
    truth = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    known = [F.when(F.count(t) > 0, (2 * F.sum(t) > F.count(t)).cast("int")).alias(t) for t in TARGETS]
    truth = truth.groupBy("_id").agg(*known)
    weights, base = fit(docs.filter(F.col("_id") != NO_ID), truth, sample)
    truth = truth.select("_id", *(F.col(t).alias(f"_true_{t}") for t in TARGETS))
    own = evidence(docs, weights, base).join(truth, "_id", "left")
    own = stored(own.select("doc_id", "_id", "_hash", "_host", "_path", *TARGETS, *(F.coalesce(F.col(f"_true_{t}").cast("double"), 1 / (1 + F.exp(-F.col(t)))).alias(f"_y_{t}") for t in TARGETS)), "evidence")
    sums = [F.count(F.lit(1)).alias("_n"), *(exact_sum(F.col(f"_y_{t}")).alias(f"_s_{t}") for t in TARGETS)]
    paths = stored(own.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), *(exact_sum(F.col(f"_s_{t}")).alias(f"_h_{t}") for t in TARGETS))
    n, *whole = paths.agg(F.sum("_n"), *(exact_sum(F.col(f"_s_{t}")) for t in TARGETS)).first()
    sites, out = paths.join(hosts, "_host"), {}
    for t, total in zip(TARGETS, whole, strict=True):
        mean = min(max((total or 0.0) / (n or 1), 1e-4), 1 - 1e-4)
        k_host, k_path = strength(hosts, "_hn", f"_h_{t}", mean), strength(paths, "_n", f"_s_{t}", mean)
        host = (F.lit(k_host * mean) + F.col(f"_h_{t}") - F.col(f"_y_{t}")) / (k_host + F.col("_hn") - 1)
        path = (k_path * host + F.col(f"_s_{t}") - F.col(f"_y_{t}")) / (k_path + F.col("_n") - 1)
        path = F.greatest(F.least(path, F.lit(1 - 1e-4)), F.lit(1e-4))
        out |= {f"host_{t}": host, f"path_{t}": path, f"p_{t}": 1 / (1 + F.exp(-(F.col(t) + odds(path) - odds(F.lit(mean)))))}
    judged = own.join(sites.drop("_host"), "_path").withColumns(out)
    keep = (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic) if weights else F.lit(True)
    return judged.select("doc_id", "_id", "_hash", *(F.col(t).alias(f"evidence_{t}") for t in TARGETS), *out, keep.alias("keep"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_id", "_hash")
