"""Operator 7, SimHash near-dedup: pivot distance tables over 64-bit fingerprints.

1. One Arrow map computes fingerprints; copies collapse to distinct fingerprints.
2. Two fingerprints with at most 4 differing bits agree on two of six blocks of their bits
   at least, so 15 keys of two blocks each bring every such pair together: no link is lost.
3. Within a key, distances to 16 reference fingerprints (pivots) are tabulated. Rows are
   sorted by the first, a pair is discarded as soon as one coordinate differs by more than
   4 (the triangle inequality), and survivors are verified on their bits. What leaves the
   task is a spanning forest of the links, never all pairs of a group.
4. A key with over ``hot`` fingerprints is dealt again by 70 finer keys: of the eight half
   blocks that its key leaves open, any linked pair agrees on four.
5. Components of the forest's links give each fingerprint, and so each document, its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import NO_ID, only, partitions, stored, table, worker_cache
from threadloom.llm.components import components

#: (first bit, bits) of the six blocks, and the pairs of blocks that make a key.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PAIRS = tuple(combinations(range(6), 2))
#: Reference fingerprints: far apart, and the same in every run.
PIVOTS = np.random.default_rng(42).integers(0, 2**64, 16, dtype=np.uint64)


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode().lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), "<u8", n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    n = len(hashes)
    ones = sum((np.unpackbits(hashes[i : i + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64) for i in range(0, n, 65_536)), np.zeros(64, np.int64))
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def pivot_distances(fp: np.ndarray, pivots: np.ndarray = PIVOTS) -> list[np.ndarray]:
    """The distances of each fingerprint to each pivot."""
    return [np.bitwise_count(fp.view(np.uint64) ^ p).astype(np.int8) for p in pivots]


def near_by_pivots(fp: np.ndarray, distances: list[np.ndarray], a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of positions (a, b) at most ``bits`` apart: distances to pivots discard, the bits themselves decide."""
    for column in distances:
        near = np.abs(column[a] - column[b]) <= bits
        a, b = a[near], b[near]
    fp = fp.view(np.uint64)  # of a negative number bitwise_count takes the absolute value
    true = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[true], b[true]


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _hash of the text, fp long): a row per row of df; null texts have no words, and their fingerprint is 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("fingerprints", dict)
        for batch in batches:
            fp = np.array([fingerprint(t or "", shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], ["doc_id", "_hash", "fp"])

    kind = df.schema[id_col].dataType
    texts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.col(text_col).alias("text"))
    return texts.mapInArrow(each, T.StructType([T.StructField("doc_id", kind), T.StructField("_hash", T.LongType()), T.StructField("fp", T.LongType())]))


def keys(fp: str = "fp"):
    """The 15 keys of a fingerprint column, as an array."""
    part = [F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit(2**bits - 1)) for first, bits in BLOCKS]
    return F.array(*(F.lit(t << 22).bitwiseOR(F.shiftleft(part[i], 11)).bitwiseOR(part[j]).cast("long") for t, (i, j) in enumerate(PAIRS)))


def finer(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """70 finer keys a row: the key, and four of the eight half blocks that it leaves open."""
    out_key, out_fp = [], []
    for t in np.unique(key >> 22):
        own = key >> 22 == t
        open_bits = [x for b in range(6) if b not in PAIRS[t] for x in ((BLOCKS[b][0], 6), (BLOCKS[b][0] + 6, BLOCKS[b][1] - 6))]
        halves = [(fp[own].view(np.uint64) >> np.uint64(first)) & np.uint64(2**bits - 1) for first, bits in open_bits]
        for c, four in enumerate(combinations(range(8), 4)):
            fine = key[own].astype(np.uint64) * np.uint64(128) + np.uint64(c)  # 26 + 7 bits, then 24
            for h in four:
                fine = fine * np.uint64(64) + halves[h]
            out_key.append(fine.view(np.int64))
            out_fp.append(fp[own])
    return np.concatenate(out_key), np.concatenate(out_fp)


class Forest:
    """Union-find on array positions, many pairs at a time; a root is its set's least position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (r != self.up[r]).any():
            r = self.up[r]
        self.up[x] = r
        return r

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.up, high, low)


def linked(key: np.ndarray, fp: np.ndarray, bits: int, pivots: np.ndarray = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links at most ``bits`` apart within each key."""
    fp = fp.view(np.uint64)
    order = np.lexsort((np.bitwise_count(fp ^ pivots[0]), key))
    key, fp = key[order], fp[order]
    table_ = pivot_distances(fp, pivots)
    forest, at, step = Forest(len(fp)), np.arange(len(fp)), 1
    while len(at):
        at = at[at + step < len(fp)]
        at = at[(key[at] == key[at + step]) & (table_[0][at + step] - table_[0][at] <= bits)]  # sorted: a row that fails has no partner further on
        forest.unite(*near_by_pivots(fp, table_[1:], at, at + step, bits))
        step += 1
    root = forest.root(np.arange(len(fp)))
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child].view(np.int64), fp[root[child]].view(np.int64)


def links(fps: DataFrame, bits: int = 4, hot: int = 20_000) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (fp) exactly as all links would."""
    if bits > 4:
        raise ValueError("two of six blocks are sure to agree up to 4 bits only")
    schema = "key long, a long, b long"

    def out(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    def read(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        return (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = read(batches)
        if not len(key):
            return
        _, where, n = np.unique(key, return_inverse=True, return_counts=True)
        large = n[where] > hot
        yield out([None] * len(x[0]), *x) if len((x := linked(key[~large], fp[~large], bits))[0]) else out([], [], [])
        if large.any():
            yield out(key[large], fp[large], fp[large])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.slice
            for i in range(0, batch.num_rows, 1000):
                key, fp = finer(*(at(i, 1000).column(c).to_numpy() for c in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = read(batches)
        if len(key):
            a, b = linked(key, fp, bits)
            yield out([None] * len(a), a, b)

    n = partitions(fps.sparkSession)
    dealt = fps.select(F.explode(keys()).alias("key"), "fp").repartition(n, "key")
    found = stored(dealt.mapInArrow(first, schema), "near")
    again = found.filter("key is not null").select("key", "a").mapInArrow(second, "key long, fp long").repartition(n, "key").mapInArrow(third, schema)
    return found.filter("key is null").select("a", "b").unionAll(again.select("a", "b"))


def near_dedup(df: DataFrame, bits: int = 4, shingle: int = 4, hot: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links, itself included).

    A null text is one without words: fingerprint zero, linked like any other. Repeated rows
    are copies. A text of any length gives one fingerprint of all its shingles. Rows with a null id belong to a component like others; its id is the least
    that is not null, or null. Other columns are ignored, and an empty table gives no rows.
    """
    docs = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    return classes(docs, bits, hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classes(docs: DataFrame, bits: int = 4, hot: int = 20_000) -> DataFrame:
    """docs (a stored table with doc_id, fp) with component_id and _root, one fingerprint for each component."""
    fps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("_least")), "distinct")
    near = components(links(fps.select("fp"), bits, hot))
    tied = stored(near.join(fps, near["node"] == fps["fp"]).select("fp", "root", "_least"), "tied")
    least = stored(tied.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    of_fp = tied.join(least, "root").select("fp", "root", "component_id")
    of_all = stored(fps.join(of_fp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("_root"), F.coalesce("component_id", "_least").alias("component_id")), "classes")
    return docs.join(of_all, "fp")


def one_of_each(df: DataFrame, bits: int = 4, shingle: int = 4, hot: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows and columns, without all but one row (the least id) of each component; rows like ``near_dedup``."""
    docs = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "_hash")
    first = stored(classes(docs, bits, hot).groupBy("_root").agg(F.min(key).alias("_first")), "first")
    return only(df, first.select("_first.*"), id_col, text_col, once=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
