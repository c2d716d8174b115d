"""Operator 2, token counts: a map-side two-tier lookup of pre-token lengths.

Tier one is a broadcast table of frequent pre-tokens and their lengths: the whole-word
pieces of the vocabulary file itself, so its size is bounded by that file (32,000
entries, about 1 MB) and no pass over the corpus is needed to build it. Tier two is a
cache in each Python worker that encodes a miss once and keeps the length. No row and
no pre-token is shuffled: the plan is one scan and one Arrow map.

Why a text is the sum of its pre-tokens: no piece of the vocabulary holds a space mark
after another character (checked when the table is built), so no merge can cross the
border before a run of spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import table, worker_cache

MARK = "▁"
#: Entries that a worker's cache holds at most, and characters of a pre-token worth keeping.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64
SEGMENT = re.compile(" *[^ ]+| +$")


@lru_cache(2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lengths(dict):
    """Token counts of pre-tokens (the text after its first space mark); a miss is encoded and kept."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.frequent = model, frequent

    def __missing__(self, part: str) -> int:
        n = len(self.model.encode(part)) if part else 1
        if len(part) <= CACHE_CHARS:
            self[part] = n
        return n

    def learn(self, texts: list[str]) -> None:
        """Encode the unknown pre-tokens of a batch in one call."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        for at in range(0, len(texts), 256):
            new = {p for t in texts[at : at + 256] for p in t.split(" ") if p and p not in self and len(p) <= CACHE_CHARS}
            if new:
                new = list(new)
                self.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            return len(self.model.encode(text))
        parts = text.split(" ")
        if "" in parts:  # runs of spaces, or a space at either end
            parts = [s[1:] for s in SEGMENT.findall(f" {text}")]
        return sum(map(self.__getitem__, parts))


def frequent_lengths(path: str) -> dict[str, int]:
    """Pre-tokens that are pieces of the vocabulary, with their lengths."""
    model = _model(path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece crosses a space: texts can't be counted by pre-token")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and p[1] != MARK]
    return dict(zip(words, map(len, model.encode(words, num_threads=1)), strict=True))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens of the whole text, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are kept, one
    output row per input row. Other columns are neither read nor returned, so their names
    can't clash. An empty table gives an empty result. A text of any length is counted
    whole; pre-tokens over 64 characters are encoded each time, not cached.
    """
    path = public_tokenizers.path(model)
    frequent = df.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    kind = df.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(f"lengths {path}", lambda: Lengths(_model(path), frequent.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = []
            for at in range(0, len(texts), 1024):
                part = texts[at : at + 1024]
                known.learn(part)
                n += map(known.count, part)
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
