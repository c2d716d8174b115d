"""Operator 8, LM scoring: a hierarchical Pitman-Yor model, seated by Gibbs sampling.

A token's context is the word before it: words are hashed to restaurants, whose number
grows with the corpus (4 for each square root of its tokens, so that a word has so many
pairs at most), and one more is for the start of a text. All restaurants share one parent,
the unigram restaurant, whose base is diffuse: a table there is a word, and the chance of a
new table is the chance of any unknown word.

How it runs on Spark: a block of documents is tokenized in one Arrow map. Its distinct
(word, context) pairs, with counts, go to the partition of the word's hash; its tokens
stay behind as numbers of pairs. A word's partition holds all its counts, and how the
customers of each pair sit: the sizes of its tables. A Gibbs sweep is a map over partitions:
customers leave their tables one after another and sit down again given all others. A pair
of one customer has one table whatever happens. Partitions sample side by side, and know
of the others the table totals of the sweep before, one number for each restaurant; a
sweep's seating is a written table that the next starts from, so a rerun after a loss finds
the same. Last, partitions answer each block with the averaged predictive probabilities of
its pairs, and blocks add them up by document. Model and vocabulary are never gathered in
one place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import partitions, stored, table, worker_cache

#: Context restaurants at least, without the one for the start of a text, and tokens after which a block is closed.
LEAST_CONTEXTS, BLOCK_TOKENS = 1024, 2_000_000
#: Discounts and strengths of the unigram and the context restaurants.
D0, S0, D1, S1 = 0.8, 1.0, 0.8, 1.0
SWEEPS, AVERAGED = 4, 2
#: A pair's customers are seated one by one up to so many; those of a larger one go in blocks, of this part of those there.
ONE_BY_ONE, BLOCKS = 256, 64
#: Bytes of text whose words a partition gets, about.
PART_BYTES = 16_000_000
#: What the rows of a partition are besides requests of blocks (0 and up): its counts, and from -2 down its seatings.
COUNTS, SEATING = -1, -2

ROW = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("words", "per_word", "contexts", "counts", "docs", "sizes"))])


def zipped(x: np.ndarray) -> bytes:
    """A whole-number array, its bytes sorted by their place, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unzipped(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], k) for i, k in enumerate(kinds)], ROW.names)


class Numbers(dict):
    """The number of each word of a block, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def restaurants(text_bytes: int) -> int:
    """Context restaurants for a corpus: a power of two."""
    return 1 << max(LEAST_CONTEXTS.bit_length() - 1, math.ceil(math.log2(4 * math.sqrt(text_bytes / 6 + 1))))


def block_rows(numbers: Numbers, docs: list[tuple[int | None, np.ndarray]], parts: int, contexts: int, block: int) -> Iterator[tuple]:
    """A row of requests for each partition of words, and a row (part -1) that keeps the block's tokens."""
    names, shift = list(numbers), contexts.bit_length()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    context = (hashes >> np.uint64(20)).astype(np.int64) % contexts
    sizes = np.array([len(w) for _, w in docs], np.int64)
    words = np.concatenate([w for _, w in docs])
    before = np.empty(len(words), np.int64)
    before[1:] = context[words[:-1]]
    before[np.cumsum(sizes) - sizes] = contexts
    order = np.lexsort((hashes, hashes % np.uint64(parts)))  # words by partition
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hashes = hashes[order]
    keys, pair = np.unique(place[words] << shift | before, return_inverse=True)
    training = np.repeat(np.array([not held_out(i) for i, _ in docs]), sizes)
    counts = np.bincount(pair[training], minlength=len(keys)).astype(np.uint32)
    per_word = np.bincount(keys >> shift, minlength=len(hashes)).astype(np.uint32)
    own_contexts = (keys & (1 << shift) - 1).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum(per_word, dtype=np.int64)))
    edges = np.searchsorted(hashes % np.uint64(parts), np.arange(parts + 1).astype(np.uint64))
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if b > a:
            own = slice(first[a], first[b])
            yield p, block, hashes[a:b].tobytes(), zipped(per_word[a:b]), zipped(own_contexts[own]), zipped(counts[own])
    ids = pa.array([i for i, _ in docs])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type), ("n", pa.int64())])) as out:
        out.write(pa.RecordBatch.from_arrays([ids, pa.array(sizes)], ["doc_id", "n"]))
    in_order = np.sort(np.repeat(np.arange(len(docs)), sizes) << 32 | pair) & 2**32 - 1  # a document's tokens add up in any order
    yield -1, block, None, zipped(per_word), None, zipped(np.diff(in_order.astype(np.uint32), prepend=np.uint32(0))), sink.getvalue().to_pybytes()


class Part:
    """A partition's words, its (word, context) pairs and their training counts."""

    def __init__(self, words: np.ndarray, keys: np.ndarray, counts: np.ndarray, contexts: int, part: int):
        self.words, self.keys, self.counts, self.contexts, self.part = words, keys, counts, contexts, part
        self.shift = contexts.bit_length()
        self.word, self.context = keys >> self.shift, keys & (1 << self.shift) - 1
        several = np.flatnonzero(counts > 1)
        #: The pairs of several customers, which are seated: fewest customers first.
        self.several = several[np.argsort(counts[several], kind="stable")]

    @classmethod
    def of(cls, r: dict, contexts: int) -> Part:
        words, per = np.frombuffer(r["words"], "<u8"), unzipped(r["per_word"], "<u4")
        keys = (np.repeat(np.arange(len(words)), per) << contexts.bit_length()) | unzipped(r["contexts"], "<u4")
        return cls(words, keys, unzipped(r["counts"], "<u4").astype(np.int64), contexts, r["part"])

    @classmethod
    def sum(cls, requests: list[dict], contexts: int) -> Part:
        """The training counts of all blocks."""
        each, shift = [Part.of(r, contexts) for r in requests], contexts.bit_length()
        words, number = np.unique(np.concatenate([p.words for p in each]), return_inverse=True)
        at = np.cumsum([0, *(len(p.words) for p in each)])
        keys, pair = np.unique(np.concatenate([(number[p.word + a] << shift) | p.context for p, a in zip(each, at, strict=False)]), return_inverse=True)
        counts = np.bincount(pair, np.concatenate([p.counts for p in each]), len(keys)).astype(np.int64)
        keys, counts = keys[counts > 0], counts[counts > 0]
        used, word = np.unique(keys >> shift, return_inverse=True)
        return cls(words[used], (word << shift) | (keys & (1 << shift) - 1), counts, contexts, requests[0]["part"])

    def row(self) -> tuple:
        per = np.bincount(self.word, minlength=len(self.words)).astype(np.uint32)
        return self.part, COUNTS, self.words.tobytes(), zipped(per), zipped(self.context.astype(np.uint32)), zipped(self.counts.astype(np.uint32))

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, self.contexts + 1)

    def unigram(self, tables: np.ndarray, customers: float) -> np.ndarray:
        """Each word's probability in the unigram restaurant, whose customers are the contexts' tables."""
        return (np.bincount(self.word, tables, len(self.words)) - D0) / (S0 + customers)

    def tables(self, of_several: np.ndarray) -> np.ndarray:
        """Tables of all pairs, from those of the pairs of several customers."""
        out = np.ones(len(self.keys))
        out[self.several] = of_several
        return out


class Rates:
    """What a new table's weight depends on: tables by context in all partitions, and this one's tables by word. Kept up to date within a sweep."""

    def __init__(self, total: np.ndarray, of_word: np.ndarray):
        self.total, self.of_word, self.whole = total.astype(float), of_word.astype(float), float(total.sum())

    def change(self, context: np.ndarray, word: np.ndarray, by: np.ndarray) -> None:
        some = np.flatnonzero(by)
        np.add.at(self.total, context[some], by[some])
        np.add.at(self.of_word, word[some], by[some])
        self.whole += float(by.sum())

    def new(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (S1 + D1 * self.total[context]) * (self.of_word[word] - D0) / (S0 + self.whole)


def beside(rng: np.random.Generator, pair: np.ndarray, there: np.ndarray, base: np.ndarray, ends: np.ndarray, sizes: np.ndarray, lowest: int = 0, leaves: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The tables that customers of pairs join, taken in proportion to their sizes less the discount: each draws another customer until one's table takes it."""
    while len(pair):
        drawn = (rng.random(len(pair)) * there[pair]).astype(np.int64)
        at = np.searchsorted(ends, base[pair] + drawn, "right") + lowest
        taken = rng.random(len(pair)) * sizes[at] < sizes[at] - D1
        if leaves is not None:
            taken &= drawn != leaves[pair]
        yield at[taken]
        pair = pair[~taken]


class Seating:
    """How the customers of a partition's pairs of several sit: the sizes of their tables.

    ``word`` numbers the words that have such pairs, ``singles`` are those words' pairs of one
    customer, each a table; pairs are in the order of ``count``.
    """

    def __init__(self, part: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, singles: np.ndarray, tables: np.ndarray, sizes: np.ndarray):
        self.part, self.word, self.context, self.count, self.singles, self.tables, self.sizes = part, word, context, count, singles, tables, sizes

    @classmethod
    def first(cls, p: Part, total: np.ndarray, rng: np.random.Generator) -> Seating:
        """All customers come in: ``ONE_BY_ONE``, then in blocks."""
        at = p.several
        words, word = np.unique(p.word[at], return_inverse=True)
        singles = np.bincount(p.word[p.counts == 1], minlength=len(p.words))[words]
        s = cls(p.part, word, p.context[at], p.counts[at], singles, np.ones(len(at), np.int64), np.ones(len(at), np.int64))
        s.sweep(total, rng, first=True)
        return s

    @classmethod
    def of(cls, r: dict) -> Seating:
        whole = lambda c: unzipped(r[c], "<u4").astype(np.int64)
        return cls(r["part"], whole("words"), whole("contexts"), whole("counts"), whole("per_word"), whole("docs"), whole("sizes"))

    def row(self, sweep: int) -> tuple:
        small = lambda x: zipped(x.astype(np.uint32))
        return self.part, SEATING - sweep, small(self.word), small(self.singles), small(self.context), small(self.count), small(self.tables), small(self.sizes)

    def sweep(self, total: np.ndarray, rng: np.random.Generator, first: bool = False) -> None:
        """Every customer leaves and sits down again, given all others.

        ``total``: tables by context in all partitions. Pairs go side by side, a customer of
        each at a time; of pairs of over ``ONE_BY_ONE`` customers a block of each at a time,
        ``BLOCKS`` blocks in all. first: customers only come in.
        """
        rates = Rates(total, self.singles + np.bincount(self.word, self.tables, len(self.singles)))
        crowded = int(np.searchsorted(self.count, ONE_BY_ONE, "right"))
        few = len(self.count) if first else crowded
        cut = int(self.tables[:few].sum())
        t, sizes = self._one_by_one(few, self.sizes[:cut], rates, rng, first)
        self.tables, self.sizes = np.concatenate((t, self.tables[few:])), np.concatenate((sizes, self.sizes[cut:]))
        if crowded < len(self.count):
            cut = int(self.tables[:crowded].sum())
            t, sizes = self._in_blocks(crowded, self.sizes[cut:], rates, rng, first)
            self.tables, self.sizes = np.concatenate((self.tables[:crowded], t)), np.concatenate((self.sizes[:cut], sizes))

    def _one_by_one(self, few: int, seated: np.ndarray, rates: Rates, rng: np.random.Generator, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """The first pairs' tables and their sizes after a sweep."""
        count, t, context, word = np.minimum(self.count[:few], ONE_BY_ONE), self.tables[:few], self.context[:few], self.word[:few]
        room = t + count  # a table's place is not used again in a sweep
        start = np.cumsum(room) - room
        sizes = np.zeros(int(room.sum()), np.int64)
        sizes[np.repeat(start - (np.cumsum(t) - t), t) + np.arange(int(t.sum()))] = seated
        t, top = t.copy(), t.copy()
        for step in range(int(first), int(count[-1]) if few else 0):
            a = int(np.searchsorted(count, step, "right"))
            n = few - a
            lo, there = start[a], np.full(n, step) if first else count[a:]
            ends = np.cumsum(sizes[lo:])
            base = np.concatenate(([0], ends))[start[a:] - lo]
            leaves = np.full(n, -1)
            if not first:
                leaves = (rng.random(n) * there).astype(np.int64)
                left = np.searchsorted(ends, base + leaves, "right") + lo
                sizes[left] -= 1
                gone = (sizes[left] == 0).astype(np.int64)
                t[a:] -= gone
                rates.change(context[a:], word[a:], -gone)
            new = rates.new(context[a:], word[a:])
            opens = rng.random(n) * (new + there - (not first) - D1 * t[a:]) < new
            for joined in beside(rng, np.flatnonzero(~opens), there, base, ends, sizes, lo, leaves):
                sizes[joined] += 1
            at = np.flatnonzero(opens) + a
            sizes[start[at] + top[at]] = 1
            top[at] += 1
            t[a:] += opens
            rates.change(context[a:], word[a:], opens.astype(np.int64))
        return t, sizes[sizes > 0]

    def _in_blocks(self, crowded: int, sizes: np.ndarray, rates: Rates, rng: np.random.Generator, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """The crowded pairs' tables and their sizes after a sweep.

        A block's customers sit down given those outside the block, so each sees all but a
        ``1 / BLOCKS`` of the others; a sweep deals the customers to the blocks at random.
        """
        count, t, context, word = self.count[crowded:], self.tables[crowded:].copy(), self.context[crowded:], self.word[crowded:]
        n, owner = len(count), np.repeat(np.arange(len(count)), t)
        there = np.full(n, ONE_BY_ONE) if first else count.copy()
        place = np.arange(len(sizes))  # of the tables of the start
        customers = np.array([], np.int64) if first else np.repeat(place, sizes)
        block = rng.integers(0, BLOCKS, len(customers))
        customers, edges = customers[np.argsort(block, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(block, minlength=BLOCKS))))
        step = 0
        while (there < count).any() if first else step < BLOCKS:
            if first:
                many = np.minimum(np.maximum(there // BLOCKS, 1), count - there)
            else:
                left = place[customers[edges[step] : edges[step + 1]]]
                many = np.bincount(owner[left], minlength=n)
                sat = sizes > 0
                sizes = sizes - np.bincount(left, minlength=len(sizes))
                gone = np.bincount(owner[sat & (sizes == 0)], minlength=n)
                t -= gone
                there = count - many
                rates.change(context, word, -gone)
            new = rates.new(context, word)
            pair = np.repeat(np.arange(n), many)
            opens = rng.random(len(pair)) * (new + there - D1 * t)[pair] < new[pair]
            ends = np.cumsum(sizes)
            base = np.concatenate(([0], ends))[np.searchsorted(owner, np.arange(n))]
            joined = list(beside(rng, pair[~opens], there, base, ends, sizes))
            sizes = sizes + np.bincount(np.concatenate([*joined, np.array([], np.int64)]), minlength=len(sizes))
            opened = np.bincount(pair[opens], minlength=n)
            after = np.searchsorted(owner, np.arange(n), "right")  # a pair's new tables come behind its others
            place = place + (np.cumsum(opened) - opened)[owner[place]]
            sizes = np.insert(sizes, np.repeat(after, opened), 1)
            owner = np.insert(owner, np.repeat(after, opened), np.repeat(np.arange(n), opened))
            t += opened
            rates.change(context, word, opened)
            if first:
                there = there + many
            step += 1
        return t, sizes[sizes > 0]


def blocks(df: DataFrame, parts: int, contexts: int) -> DataFrame:
    """df (doc_id, text) as rows of requests and of tokens."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language model", dict)
        numbers, docs, n, block = Numbers(), [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().lower().split()
                words.append(b"")  # the end: no word is empty
                docs.append((i, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))))
                n += len(words)
                if n >= BLOCK_TOKENS:
                    for row in block_rows(numbers, docs, parts, contexts, block):
                        yield rows_of([row])
                    numbers, docs, n, block = Numbers(), [], 0, block + 1
        for row in block_rows(numbers, docs, parts, contexts, block) if docs else ():
            yield rows_of([row])

    return df.mapInArrow(each, ROW)


def score(df: DataFrame, sweeps: int = SWEEPS, averaged: int = AVERAGED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id) mod 5 is 1 are held out; the model learns from all others and
    scores all. A null text is an empty one: its only token is the end. A null id counts as
    an empty one, which trains. Repeated rows train and are scored each. A text of any length
    is scored whole. Other columns are ignored, whatever their names; an empty table gives no
    rows. Words are told apart by 64-bit hashes.
    """
    kind = df.schema[id_col].dataType
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, contexts = max(2 * partitions(df.sparkSession), size // PART_BYTES), restaurants(size)
    asked = stored(blocks(texts, parts, contexts), "blocks")
    requests = asked.filter("part >= 0")

    def add(group: pa.Table) -> pa.Table:
        part = Part.sum(group.to_pylist(), contexts)
        return pa.Table.from_batches([rows_of([part.row()] if len(part.keys) else [])])

    state = stored(requests.groupBy("part").applyInArrow(add, ROW), "counts")

    def totals(rows: DataFrame, of) -> np.ndarray:
        """A whole number for each context, and some more, added up over all partitions: in each task, in eight tasks, and then here."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from added(of(r) for batch in batches for r in batch.to_pylist())

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from added(unzipped(x, "<u8") for batch in batches for x in batch.column(0).to_pylist())

        def added(vectors: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            out = None
            for v in vectors:
                out = v.astype(np.uint64) if out is None else out + v.astype(np.uint64)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([zipped(out)], pa.binary())], ["x"])

        found = rows.mapInArrow(each, "x binary").repartition(8).mapInArrow(again, "x binary").collect()
        return np.sum([unzipped(r["x"], "<u8") for r in found], axis=0).astype(float) if found else np.zeros(contexts + 3)

    def ones(r: dict) -> np.ndarray:
        p = Part.of(r, contexts)
        singles = p.by_context(p.counts == 1)
        return np.concatenate((p.by_context(p.counts), singles, p.by_context(np.ones(len(p.keys))), [len(p.words)]))

    def seats(r: dict) -> np.ndarray:
        s = Seating.of(r)
        return np.bincount(s.context, s.tables, contexts + 1)

    def seated(before: np.ndarray, sweep: int):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for batch in batches for r in batch.to_pylist()):
                rng = np.random.default_rng([r["part"], sweep])
                if sweep:
                    own = Seating.of(r)
                    own.sweep(before, rng)
                else:
                    own = Seating.first(Part.of(r, contexts), before, rng)
                yield rows_of([own.row(sweep)])

        return each

    head = totals(state, ones)
    head = head if len(head) > contexts + 3 else np.zeros(3 * (contexts + 1) + 1)
    customers, singles, one_each = head[:-1].reshape(3, -1)
    vocabulary, tokens = int(head[-1]), int(customers.sum())
    seatings, sums = [state], [one_each]
    for k in range(sweeps + 1):
        seatings.append(stored(seatings[-1].mapInArrow(seated(sums[-1], k), ROW), "seating"))
        several = totals(seatings[-1], seats)
        sums.append(singles + (several if len(several) == contexts + 1 else 0))
    kept = {SEATING - k: sums[k + 1] for k in range(sweeps + 1 - averaged, sweeps + 1)}

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = [r for r in rows if r["block"] == COUNTS]
        part = Part.of(own[0], contexts) if own else None
        samples = [(part.tables(unzipped(r["docs"], "<u4")), kept[r["block"]]) for r in sorted(rows, key=lambda r: r["block"]) if r["block"] <= SEATING] if part else [(None, total) for total in kept.values()]
        count_of = np.bincount(part.word, part.counts, len(part.words)) if part else None
        out = []
        for r in rows:
            if r["block"] < 0:
                continue
            words, of = np.frombuffer(r["words"], "<u8"), unzipped(r["contexts"], "<u4").astype(np.int64)
            word = np.repeat(np.arange(len(words)), unzipped(r["per_word"], "<u4"))
            at = np.minimum(np.searchsorted(part.words, words), len(part.words) - 1) if part else np.zeros(len(words), np.int64)
            known = part.words[at] == words if part else np.zeros(len(words), bool)
            count = np.where(known, count_of[at], 0).astype(np.int64) if part else np.zeros(len(words), np.int64)
            chance = np.zeros(len(of))
            for tables, total in samples:
                parent = np.full(len(words), (S0 + D0 * vocabulary) / (S0 + total.sum()))
                direct = np.zeros(len(of))
                if part:
                    parent = np.where(known, part.unigram(tables, total.sum())[at], parent)
                    key = (at[word] << part.shift) | of
                    where = np.minimum(np.searchsorted(part.keys, key), len(part.keys) - 1)
                    seen = known[word] & (part.keys[where] == key)
                    direct = np.where(seen, part.counts[where] - D1 * tables[where], 0)
                chance += (direct + (S1 + D1 * total[of]) * parent[word]) / (S1 + customers[of])
            out.append((r["part"], r["block"], None, None, np.log10(chance / len(samples)).astype("<f4").tobytes(), zipped(count.astype(np.uint32))))
        return pa.Table.from_batches([rows_of(out)])

    scored = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("_base", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def add_up(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        head, answers = rows[0], rows[1:]
        per_word, pair = unzipped(head["per_word"], "<u4"), np.cumsum(unzipped(head["counts"], "<u4"), dtype=np.uint32)
        docs = pa.ipc.open_stream(head["docs"]).read_all()
        sizes = docs.column("n").to_numpy()
        first = np.cumsum(sizes) - sizes
        chance = np.concatenate([np.frombuffer(r["contexts"], "<f4") for r in answers]).astype(float)
        count = np.repeat(np.concatenate([unzipped(r["counts"], "<u4") for r in answers]).astype(np.int64), per_word)
        add = lambda x: np.add.reduceat(x[pair], first)
        ids = docs.column("doc_id")
        out = [pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(sizes), pa.array(add((count > 0).astype(np.int64))), pa.array(add(np.log10(count + 0.5))), pa.array(add(chance))]
        return pa.table([ids, *out], scored.names)

    rows = requests.unionAll(state)
    for own in seatings[-averaged:]:
        rows = rows.unionAll(own.withColumns({c: F.lit(None).cast("binary") for c in ("words", "per_word", "contexts", "counts", "sizes")}).select(*ROW.names))
    answers = rows.groupBy("part").applyInArrow(answer, ROW)
    summed = asked.filter("part < 0").unionAll(answers).groupBy("block").applyInArrow(add_up, scored)
    base = F.col("_base") - F.col("n_tokens") * F.log10(F.lit(tokens + 0.5 * (vocabulary + 1)))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
