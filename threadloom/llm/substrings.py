"""Operator 10, substring dedup: relative Lempel-Ziv factors against an index of all reference blocks.

The reference is the whole corpus, in blocks of documents: each run of 20 words (a window)
is indexed with the place where it starts first. A document is parsed greedily from left to
right: where a window has an earlier place, a factor begins with that place as its source,
and it grows by a word as long as the next window's place is the next of the same source.
Where it ends, windows across the border are looked up like all others, and the next of
them that is found begins the next factor. Factors are 20 words or longer, so each is a
duplicate span; overlapping factors make one.

1. One Arrow map turns blocks of documents into hashes of their windows. A window
   that repeats within a block is known to be a repeat there and then; each block asks the
   index once for each of its windows, so a passage in a third of all documents is asked
   for a few times a block and never gathers its documents in one task.
2. Questions travel as packed arrays to the partition of their hash, which answers each
   with the window's first place in the corpus (exact on (doc_id, start)), if it is earlier.
3. Answers go back to the block, which parses its documents into factors and their spans.
4. Spans are joined to the texts, which are shuffled once.

A window has two independent hashes, of 64 and 32 bits. Within a block windows are compared
by both. The second deals questions to partitions, where the first compares them, so the
number of partitions, which grows with the corpus, counts too: among 10^13 windows a sixth
of a false repeat is expected, among 10^8 a millionth.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import key, stored, table, text_parts, with_key, worker_cache

#: Words after which a block of documents is closed, and entries that a worker's word cache holds.
BLOCK_WORDS, CACHE_ENTRIES = 1_000_000, 200_000
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 2**64)
#: The base of the hash that checks the first.
_C = 0xD6E8FEB86659FD93
_C_INVERSE = pow(_C, -1, 2**64)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


class Words(dict):
    """64-bit hashes of words, in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(words: np.ndarray, width: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The hash of each run of ``width`` words, from a polynomial's running sum."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    n = len(words) - width + 1
    return mixed((sums[width:] - sums[:-width]) * down[:n])


def packed(*columns: np.ndarray) -> bytes:
    """Whole-number columns, as differences of neighbours, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.cumsum(np.frombuffer(raw[at : at + size], k), dtype=k))
        at += size
    return out


#: Questions: hashes and places (document, start) of windows, ids of the documents. Answers: places, and in ids the sources.
SCHEMA = "part int, block long, hashes binary, places binary, ids binary"
FACTORS = "_id long, _hash long, spans array<int>, factors array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "block", "hashes", "places", "ids"])


def _new(*hashes: np.ndarray) -> np.ndarray:
    """Which of the sorted windows differ from the one before."""
    return np.concatenate(([True], np.any([h[1:] != h[:-1] for h in hashes], axis=0))) if len(hashes[0]) else np.empty(0, bool)


def _ask(docs: list[tuple[int, int, np.ndarray]], width: int, parts: int, block: int) -> Iterator[tuple]:
    """A block's questions, a row for each partition, and a row with the block's documents and the repeats known in it."""
    docs.sort(key=lambda d: d[:2])
    ids = np.array([d[0] for d in docs], np.int64)
    long = max((len(d[2]) for d in docs), default=0)
    up, down, up2, down2 = powers(_B, long), powers(_B_INVERSE, long), powers(_C, long), powers(_C_INVERSE, long)
    found = [windows(d[2], width, up, down) for d in docs]
    sizes = np.array([len(w) for w in found], np.int64)
    hashes = np.concatenate(found)
    checks = np.concatenate([windows(mixed(d[2]), width, up2, down2).astype(np.uint32) for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
    start = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
    if (ids[1:] == ids[:-1]).any():  # rows of one id: their windows in the order of their starts
        order = np.lexsort((doc, start, ids[doc]))
        hashes, checks, doc, start = hashes[order], checks[order], doc[order], start[order]
    by_hash = np.argsort(hashes, kind="stable")
    new = _new(hashes[by_hash], checks[by_hash])
    if new.sum() > 1 + np.count_nonzero(np.diff(hashes[by_hash])):  # one hash with two checks
        by_hash = np.lexsort((checks, hashes))
        new = _new(hashes[by_hash], checks[by_hash])
    first = np.empty(len(hashes), np.int64)
    first[by_hash] = by_hash[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(hashes) else by_hash
    later = (ids[doc] != ids[doc[first]]) | (start != start[first])
    places = packed(doc[later], start[later], doc[first[later]], start[first[later]])
    yield -1 - (block + (block >> 24)) % parts, block, np.array([d[1] for d in docs], np.int64).tobytes(), places, packed(ids)
    hashes, checks, doc, start = hashes[~later], checks[~later], doc[~later], start[~later]
    to = checks % np.uint32(parts)
    order = np.argsort(to, kind="stable")
    hashes, doc, start = hashes[order], doc[order], start[order]
    edges = np.searchsorted(to[order], np.arange(parts + 1))
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if b > a:
            yield p, block, hashes[a:b].tobytes(), packed(doc[a:b], start[a:b]), packed(ids[np.unique(doc[a:b])])


def _answer(rows: list[dict]) -> Iterator[tuple]:
    """The windows of one partition that also start earlier, each with its first place."""
    asked = []
    for r in rows:
        if r["part"] >= 0:
            doc, start = unpacked(r["places"], "<u4", "<u4")
            ids = unpacked(r["ids"], "<i8")[0]
            asked.append((np.frombuffer(r["hashes"], "<u8"), ids[np.unique(doc, return_inverse=True)[1]], start, doc, r["block"]))
    if not asked:
        return
    hashes, ids, start = (np.concatenate([a[i] for a in asked]) for i in range(3))
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    some = order[same[1:] | same[:-1]]  # windows asked for more than once
    some = some[np.lexsort((start[some], ids[some], hashes[some]))]
    new = _new(hashes[some])
    first = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
    earlier = (ids[some] != ids[first]) | (start[some] != start[first])
    source = np.full(len(hashes), -1)
    source[some[earlier]] = first[earlier]
    at = 0
    for own, _, begin, doc, block in asked:
        of = source[at : at + len(own)]
        at += len(own)
        hit = of >= 0
        if hit.any():
            yield 0, block, b"", packed(doc[hit], begin[hit]), packed(ids[of[hit]], start[of[hit]].astype(np.int64))


def _parsed(group: pa.Table, width: int) -> pa.Table:
    """A block's documents with repeats: factors (begin, words, source's id and begin, flat) and the spans that they cover."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["part"] < 0)
    ids, hashes = unpacked(head["ids"], "<i8")[0], np.frombuffer(head["hashes"], "<i8")
    answers = [(*unpacked(r["places"], "<u4", "<u4"), *unpacked(r["ids"], "<i8", "<i8")) for r in rows if r["part"] >= 0]
    doc, start, source, place = (np.concatenate(c).astype(np.int64) for c in zip(*answers, strict=True)) if answers else [np.empty(0, np.int64)] * 4
    again, again_start, of, of_start = (x.astype(np.int64) for x in unpacked(head["places"], *["<u4"] * 4))
    if len(again):  # a repeat within the block: its source is that of the window's first place in the block, or that place
        number = doc << 32 | start
        order = np.argsort(number)
        asked = of << 32 | of_start
        at = np.minimum(np.searchsorted(number[order], asked), max(0, len(number) - 1))
        known = number[order][at] == asked if len(number) else np.zeros(len(asked), bool)
        at = order[at] if len(number) else at
        own_source, own_place = ids[of], of_start
        own_source[known], own_place[known] = source[at[known]], place[at[known]]
        doc, start, source, place = (np.concatenate(x) for x in ((doc, again), (start, again_start), (source, own_source), (place, own_place)))
    if not len(doc):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int64()))], ["_id", "_hash", "spans", "factors"])
    order = np.lexsort((start, doc))
    doc, start, source, place = doc[order], start[order], source[order], place[order]
    grows = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
    first = np.flatnonzero(np.concatenate(([True], ~grows)))
    doc, begin, words, source, place = doc[first], start[first], np.diff(np.append(first, len(start))) + width - 1, source[first], place[first]
    factors = np.column_stack((begin, words, source, place))
    joins = (doc[1:] == doc[:-1]) & (begin[1:] <= begin[:-1] + words[:-1])  # ends rise with begins, as words are width or more
    opens = np.flatnonzero(np.concatenate(([True], ~joins)))
    closes = np.append(opens[1:], len(doc)) - 1
    spans = np.column_stack((begin[opens], begin[closes] + words[closes])).astype(np.int32)

    def lists(of: np.ndarray, values: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
        edges = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(of))
        return pa.ListArray.from_arrays(pa.array(values.shape[1] * edges, pa.int32()), pa.array(values.ravel())), of[edges[:-1]]

    spans, own = lists(doc[opens], spans)
    return pa.table([pa.array(ids[own]), pa.array(hashes[own]), spans, lists(doc, factors)[0]], ["_id", "_hash", "spans", "factors"])


def factors(df: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as ``FACTORS``: for each text with repeats the word ranges [begin, end) to remove, flat, and its factors.

    A factor is four numbers: its first word, its words, and the id and first word of the
    place that it repeats. What is not a factor is literal.
    """
    texts = df.select(*key(id_col, text_col), F.col(text_col).alias("text"))
    parts = text_parts(texts, each=8_000_000, times=2)  # a partition's questions are answered in one piece

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, seen, n, known = [], set(), 0, worker_cache("words", Words)
        block = TaskContext.get().partitionId() << 24  # a rerun of the task gives its blocks the same names
        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if len(words) < width or (i, h) in seen:
                    continue
                seen.add((i, h))
                docs.append((i, h, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
                n += len(words)
                if n >= BLOCK_WORDS:
                    for row in _ask(docs, width, parts, block):
                        yield _rows([row])
                    docs, seen, n, block = [], set(), 0, block + 1
        for row in _ask(docs, width, parts, block) if docs else ():
            yield _rows([row])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        heads = [tuple(r[c] for c in ("part", "block", "hashes", "places", "ids")) for r in rows if r["part"] < 0]
        return pa.Table.from_batches([_rows(heads + list(_answer(rows)))])

    # a block's own row is marked by -1 - its partition, so that it travels with the partition's questions
    asked = texts.mapInArrow(ask, SCHEMA)
    answered = asked.groupBy(F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")).alias("to")).applyInArrow(answer, SCHEMA)
    return answered.groupBy("block").applyInArrow(lambda group: _parsed(group, width), FACTORS)


def with_spans(df: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, spans): df's rows, each in a struct, with the word ranges to remove, null if there are none."""
    found = stored(factors(df, width, id_col, text_col).select("_id", "_hash", "spans"), "spans").distinct().hint("shuffle_hash")
    return with_key(df, id_col, text_col).join(found, ["_id", "_hash"], "left").select("row", "spans")


def kept_words(words: list, ranges: list[int]) -> list:
    """words without the ranges."""
    cuts = [0, *ranges, len(words)]
    return [w for a, b in zip(cuts[::2], cuts[1::2], strict=True) for w in words[a:b]]


def remove_repeats(df: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words, joined by one space.

    A word goes if a window of ``width`` words that covers it also starts earlier: in a smaller
    doc_id, or in the same document before. A null text has no words. Rows of one id are one
    document: equal starts don't remove each other, so copies of a row fare alike. A null
    id sorts after all others. Texts shorter than a window keep all words; one of any length
    is parsed whole. Other columns are ignored, whatever their names; an empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                left = kept_words(words, ranges) if ranges else words
                n.append(len(words))
                gone.append(len(words) - len(left))
                digest.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return with_spans(docs, width).select("row.*", "spans").mapInArrow(each, T.StructType(fields))


def cut_repeats(df: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows and columns, with the repeated words and the white space after them cut from the text; rows like ``remove_repeats``."""

    @F.udf("string", useArrow=True)
    def cut(text, ranges):
        if not ranges:
            return text
        raw = text.encode()
        at = [m.start() for m in WORDS.finditer(raw)] + [len(raw)]
        edges = [0, *(at[r] for r in ranges), len(raw)]
        return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()

    text = F.col("row").getField(text_col)
    left = F.when(F.col("spans").isNull(), text).otherwise(cut(text, F.col("spans")))
    return with_spans(df, width, id_col, text_col).select(F.col("row").withField(text_col, left).alias("row")).select("row.*")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
