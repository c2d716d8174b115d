"""Operator 4, packing: cutting-stock column generation over the length histogram.

1. One Arrow map tokenizes each text, cuts a full sequence off as long as one is left,
   and keeps the rest as one piece: only piece lengths and checksums go on, never ids.
2. Piece lengths fall into 256 classes (multiples of 16). Their counts, 256 numbers
   however large the corpus, are the demands of a cutting-stock problem. The driver
   solves its linear program by column generation: a revised simplex method holds 256
   patterns, and a knapsack dynamic program prices the next one.
3. Patterns are rounded down; the few pieces left (some hundreds at most) are placed by
   first fit into further patterns.
4. Pieces are ranked within their class and sent to the patterns by rank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from threadloom.llm.common import numbered, stored, table, worker_cache

#: Entries that each of a worker's two caches holds at most, and characters of a chunk worth keeping.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
#: Chunks that this module splits itself: printable ASCII and the letters of Latin-1, none of which composes with a neighbour.
PLAIN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
# How the tokenizer splits them, in lower case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def halved(cache: dict) -> None:
    """Drop the older half of a full cache."""
    if len(cache) > CACHE_ENTRIES:
        for old in list(islice(cache, CACHE_ENTRIES // 2)):
            del cache[old]


class Parts(dict):
    """Ids (little-endian 32-bit, as bytes) of the lower-case words, digits and marks that chunks are made of."""

    def __init__(self, tok):
        super().__init__()
        self.model, self.as_bytes = tok.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, part: str) -> bytes:
        letters = part if part.isascii() else self.as_bytes.pre_tokenize_str(part)[0][0]
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(part) <= CACHE_CHARS:
            halved(self)
            self[part] = ids
        return ids


class Encoder(dict):
    """Ids of the chunks between spaces.

    The tokenizer drops white space and never joins characters across it, so a text's ids
    are its chunks' ids one after another. An unknown chunk is split into parts, most of
    which are known; a chunk with other characters than ``PLAIN`` is encoded by the
    tokenizer, and a text that may hold a special token's string is encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tok = _tokenizer(path)
        self.parts = Parts(self.tok)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        ids = b"".join(map(self.parts.__getitem__, PARTS.findall(chunk.lower()))) if plain or not chunk else self.whole(chunk)
        if len(chunk) <= CACHE_CHARS:
            halved(self)
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return self.whole(text) if "<|" in text else b"".join(map(self.__getitem__, text.split(" ")))


def pieces(df: DataFrame, length: int, end_id: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each text's ids, with end_id after them, into full sequences and one rest."""
    path = public_tokenizers.path(tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(f"ids {path}", lambda: Encoder(path))
        for batch in batches:
            texts, keep, rows = [(t or "").replace("\n", " ") for t in batch.column(1).to_pylist()], [], []
            for i, text in enumerate(texts):
                raw = known.ids(text) + end
                n = len(raw) // 4
                for start in range(0, n, length):
                    own = raw[4 * start : 4 * (start + length)]
                    keep.append(i)
                    rows.append((start, len(own) // 4, zlib.crc32(own), n))
            cols = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), (), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), *cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    fields = [T.StructField("doc_id", df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, T.StructType(fields))


def knapsack(value: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: how often each size 1..width is used, sizes adding up to width at most."""
    best, last = np.zeros(width + 1), np.zeros(width + 1, int)
    for w in range(1, width + 1):
        gain = best[w - 1 :: -1] + value[:w]  # size s at index s - 1 leaves w - s
        s = int(gain.argmax())
        best[w], last[w] = (gain[s], s + 1) if gain[s] > best[w - 1] else (best[w - 1], 0)
    use, w = np.zeros(width), width
    while w > 0:
        use[last[w] - 1] += last[w] > 0
        w -= max(last[w], 1)
    return float(best[width]), use


def cutting_stock(demand: np.ndarray, gap: float = 1e-4, rounds: int = 4000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (times each size 1..width is used) and how often to use them, covering demand exactly.

    Gilmore and Gomory's column generation; it stops when the knapsack's price bounds the
    optimum within ``gap``. Every round's basis is feasible, so ``rounds`` costs quality only.
    """
    width = len(demand)
    sizes = np.flatnonzero(demand) + 1
    plan: Counter[tuple[int, ...]] = Counter()
    left = demand.astype(np.int64).copy()
    if len(sizes):
        m, need = len(sizes), demand[sizes - 1].astype(float)
        columns = np.zeros((width, m))
        per = width // sizes
        columns[sizes - 1, np.arange(m)] = per
        inverse, x = np.diag(1.0 / per), need / per
        for _ in range(rounds):
            value = np.zeros(width)
            value[sizes - 1] = inverse.sum(axis=0)
            bound, use = knapsack(np.maximum(value, 0), width)
            if bound <= 1 + gap:
                break
            use[value <= 0] = 0
            way = inverse @ use[sizes - 1]
            if not (way > 1e-9).any():
                break
            ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
            out = int(ratio.argmin())
            step = max(ratio[out], 0.0)
            x = np.maximum(x - step * way, 0)
            x[out] = step
            inverse[out] /= way[out]
            others = np.arange(m) != out
            inverse[others] -= np.outer(way[others], inverse[out])
            columns[:, out] = use
        for j in np.argsort(-x, kind="stable"):
            use = columns[:, j].astype(np.int64)
            on = use > 0
            times = int(min(np.floor(x[j] + 1e-9), (left[on] // use[on]).min())) if on.any() else 0
            if times > 0:
                plan[tuple(use.tolist())] += times
                left -= times * use
    for size in range(width, 0, -1):  # what rounding left: fill a sequence with the largest that fit
        while left[size - 1]:
            room, use = width, np.zeros(width, np.int64)
            for s in range(size, 0, -1):
                if s <= room and left[s - 1]:
                    k = min(room // s, int(left[s - 1]))
                    use[s - 1] += k
                    left[s - 1] -= k
                    room -= k * s
            plan[tuple(use.tolist())] += 1
    return sorted(plan.items(), key=lambda p: (p[0], p[1]), reverse=True)


def pack(df: DataFrame, length: int = 4096, end_id: int = 2, tokenizer: str = "word_bpe_49k.json", classes: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into sequences of at most ``length`` ids; a row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is
    an empty one: its only id is end_id. Long texts are cut at multiples of ``length`` and
    nowhere else. Null ids and repeated rows are packed like any others; rows that are equal
    in every column can't be told apart and may swap places. Other columns are ignored.
    An empty table gives no rows. Reruns give the same rows.
    """
    unit = length // classes
    cut = stored(pieces(df, length, end_id, tokenizer, id_col, text_col).withColumn("_class", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    counts = {r["_class"]: r["n"] for r in cut.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}  # 256 rows at most
    plan = cutting_stock(np.array([counts.get(c, 0) for c in range(1, classes + 1)], np.int64))
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used, base = Counter(), 0
    for use, times in plan:
        for c, k in enumerate(use, 1):
            if k:
                runs.setdefault(c, []).append((used[c], k, base))
                used[c] += k * times
        base += times
    lookup = {c: tuple(np.array(col, np.int64) for col in zip(*r, strict=True)) for c, r in runs.items()}

    @F.pandas_udf("long")
    def sequence(cls: pd.Series, rank: pd.Series) -> pd.Series:
        out, kinds, ranks = np.empty(len(cls), np.int64), cls.to_numpy(), rank.to_numpy()
        for c in np.unique(kinds):
            own = kinds == c
            first, per, seq = lookup[int(c)]
            run = np.searchsorted(first, ranks[own], "right") - 1
            out[own] = seq[run] + (ranks[own] - first[run]) // per[run]
        return pd.Series(out)

    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    placed = numbered(cut, ["_class"], order, "_rank", sum(counts.values())).withColumn("sequence_id", sequence("_class", "_rank"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
