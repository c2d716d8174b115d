"""Near copies by word shingles: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The pipeline's form of operator 7. At that similarity 64-bit fingerprints are 10 bits apart
in the mean, too far for block keys, so candidates come from shingles; operator 7's
fingerprints and pivot tables then discard, and the shingle sets verify.

1. One Arrow map turns blocks of documents into shingle hashes, which ask the partition of
   their hash in how many sets of the corpus they occur. Shingles of one set need no answer.
2. Two sets at 0.8 share a shingle among the rarest fifth of either (a prefix filter in the
   order of rarity), so each set goes to the keys of its rarest shared shingles: no link
   is lost, and a passage that many documents share is a key only of those made of it.
3. Within a key a pair is discarded by its sizes, by what can still follow the shared
   shingle in both, and by distances to the pivots. Survivors are verified on both texts.
4. A key with over ``small`` sets first compares all with one of them. Then, by rounds,
   more of its sets are compared with all that the links found so far do not connect to
   them, until no such pair is left: a large group of near copies costs few comparisons,
   and no link between components is lost.
5. Components of the verified links give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import key, only, partitions, stored, text_parts, worker_cache
from threadloom.llm.components import components
from threadloom.llm.simhash import majority, near_by_pivots, pivot_distances
from threadloom.llm.substrings import packed, unpacked

WIDTH = 5
#: Similarity at least 4 / 5, in integers.
PART, WHOLE = 4, 5
#: Bits that fingerprints of two sets at 0.8 differ in at most, if both have so many shingles: over that come
#: 2.6 in a hundred million pairs at most, whatever their sizes. Pairs with a smaller set aren't cut.
RADIUS, LEAST_CUT = 28, 20
#: Shingles after which a block of documents is closed.
BLOCK_SHINGLES = 1_000_000


def undiscarded(sim: np.ndarray, distances: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of positions (a, b) that fingerprints don't discard: pairs with a small set are all kept."""
    cut = np.minimum(size[a], size[b]) >= LEAST_CUT
    x, y = near_by_pivots(sim, distances, a[cut], b[cut], RADIUS)
    return np.concatenate((a[~cut], x)), np.concatenate((b[~cut], y))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle of all its words."""
    words = text.encode().lower().split()  # as simhash.fingerprint
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(width, n)
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out + of_word[i : n - k + 1 + i])
    return np.unique(out)


ASKED = "part int, block long, hashes binary, docs binary, fps binary, sizes binary, sims binary, ids binary"
#: A row per document (_id, _hash, fp, size), with key null; and a row per key of a set (key, fp, size, place, sim).
FOUND = "key long, fp long, size int, place int, sim long, _id long, _hash long"


def _table(names: str, kinds: tuple, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in names.split(", ")])


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    return _table(ASKED, (pa.int32(), pa.int64(), *[pa.binary()] * 6), rows)


def _ask(sets: dict[int, np.ndarray], docs: list[tuple[int, int, int]], parts: int, block: int) -> Iterator[tuple]:
    """A block's shingles, a row for each partition, and a row with its documents and distinct sets."""
    fps = np.array(list(sets), np.uint64)
    sizes = np.array([len(s) for s in sets.values()], np.int64)
    sims = np.array([majority(s) for s in sets.values()], np.uint64)
    at = {fp: i for i, fp in enumerate(sets)}
    ids = [np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64), np.array([at[d[2]] for d in docs], np.int64)]
    yield -1 - (block + (block >> 24)) % parts, block, None, None, fps.tobytes(), packed(sizes), sims.tobytes(), packed(*ids)
    hashes, doc = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
    to = hashes % np.uint64(parts)
    order = np.argsort(to, kind="stable")
    hashes, doc = hashes[order], doc[order]
    edges = np.searchsorted(to[order], np.arange(parts + 1).astype(np.uint64))
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if b > a:
            yield p, block, hashes[a:b].tobytes(), packed(doc[a:b]), None, None, None, None


def _answer(rows: list[dict]) -> Iterator[tuple]:
    """The shingles of more than one set, with the number of sets (in sizes)."""
    asked = [(r["block"], np.frombuffer(r["hashes"], "<u8"), unpacked(r["docs"], "<u4")[0]) for r in rows if r["part"] >= 0]
    if not asked:
        return
    hashes = np.concatenate([a[1] for a in asked])
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
    at = 0
    for block, own, doc in asked:
        n = df[at : at + len(own)]
        at += len(own)
        hit = n > 1
        if hit.any():
            yield 0, block, own[hit].tobytes(), packed(doc[hit]), None, packed(n[hit]), None, None


def _keys(group: pa.Table) -> pa.Table:
    """A block's documents, and the keys of its sets."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["part"] < 0)
    fps, sims, sizes = np.frombuffer(head["fps"], "<i8"), np.frombuffer(head["sims"], "<i8"), unpacked(head["sizes"], "<i8")[0]
    ids, hashes, of = unpacked(head["ids"], "<i8", "<i8", "<i8")
    none = lambda kind, n: pa.nulls(n, kind)
    m = len(ids)
    out = [pa.table([none(pa.int64(), m), pa.array(fps[of]), pa.array(sizes[of].astype(np.int32)), none(pa.int32(), m), none(pa.int64(), m), pa.array(ids), pa.array(hashes)], [c.split()[0] for c in FOUND.split(", ")])]
    answers = [r for r in rows if r["part"] >= 0]
    if answers:
        shared = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in answers])
        doc = np.concatenate([unpacked(r["docs"], "<u4")[0] for r in answers]).astype(np.int64)
        df = np.concatenate([unpacked(r["sizes"], "<i8")[0] for r in answers])
        order = np.lexsort((shared, df, doc))  # the order of rarity within each set; shingles of one set come before all these
        shared, doc = shared[order], doc[order]
        n = np.bincount(doc, minlength=len(fps))
        place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + (sizes - n)[doc]
        early = place <= sizes[doc] - -(-PART * sizes[doc] // WHOLE)
        shared, doc, place = shared[early], doc[early], place[early]
        k = len(doc)
        out.append(pa.table([pa.array(shared.view(np.int64)), pa.array(fps[doc]), pa.array(sizes[doc].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sims[doc]), none(pa.int64(), k), none(pa.int64(), k)], out[0].column_names))
    return pa.concat_tables(out)


def signed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as ``FOUND``: each row's set by its digest fp, and the keys under which sets may meet others."""
    texts = df.select(*key(id_col, text_col), F.col(text_col).alias("text"))
    parts = text_parts(texts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near copies", dict)
        block = TaskContext.get().partitionId() << 24  # a rerun of the task gives its blocks the same names
        sets, docs, n = {}, [], 0
        for batch in batches:
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text or "")
                fp = xxhash.xxh64_intdigest(s.tobytes())
                docs.append((i, h, fp))
                if fp not in sets:
                    sets[fp] = s
                    n += len(s)
                if n + len(docs) >= BLOCK_SHINGLES:
                    for row in _ask(sets, docs, parts, block):
                        yield _asked([row])
                    sets, docs, n, block = {}, [], 0, block + 1
        for row in _ask(sets, docs, parts, block) if docs else ():
            yield _asked([row])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        heads = [tuple(r[c.split()[0]] for c in ASKED.split(", ")) for r in rows if r["part"] < 0]
        return pa.Table.from_batches([_asked(heads + list(_answer(rows)))])

    asked = texts.mapInArrow(ask, ASKED)
    to = F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")).alias("to")
    return asked.groupBy(to).applyInArrow(answer, ASKED).groupBy("block").applyInArrow(_keys, FOUND)


def _read(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    got = [[b.column(c).to_numpy() for c in range(columns)] for b in batches]
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.empty(0, np.int64)] * columns


def _may(size: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Neither the sizes alone nor what can follow a shared shingle at these places rules the similarity out."""
    x, y = size[a].astype(np.int64), size[b].astype(np.int64)
    follows = 1 + np.minimum(x - place[a] - 1, y - place[b] - 1)
    return (WHOLE * np.minimum(x, y) >= PART * np.maximum(x, y)) & ((PART + WHOLE) * follows >= PART * (x + y))


def _first(small: int):
    """All pairs of keys with up to ``small`` sets that may be similar; of other keys the pairs with their first set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, fp, size, place, sim = _read(batches, 5)
        if not len(k):
            return
        order = np.lexsort((fp, place, k))  # a key's first set is the one with the fewest rarer shingles: of edited copies, the original
        k, fp, size, place, sim = (x[order] for x in (k, fp, size, place, sim))
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])))  # a set that several blocks hold
        k, fp, size, place, sim = (x[new] for x in (k, fp, size, place, sim))
        _, start, where, n = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
        few, pairs = np.flatnonzero((n[where] <= small) & (n[where] > 1)), []
        for step in range(1, small):
            few = few[few + step < len(k)]
            few = few[k[few] == k[few + step]]
            pairs.append((few, few + step))
        many = np.flatnonzero(n[where] > small)
        others = many[start[where[many]] != many]
        pairs.append((start[where[others]], others))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        may = _may(size, place, a, b)
        a, b = undiscarded(sim, pivot_distances(sim), size, a[may], b[may])
        a, b = np.unique(np.stack([fp[a], fp[b]]), axis=1) if len(a) else (fp[:0], fp[:0])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "crowded"])
        crowded = np.unique(k[many])
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(crowded), pa.int64())] * 2, pa.array(crowded, pa.int64())], ["a", "b", "crowded"])

    return task


def _more(pivots: int):
    """Pairs of up to ``pivots`` sets of each key with those of another root that may be similar; a null row says that more are left.

    Sets with the fewest rarer shingles come first, and the largest component needs no turn.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, fp, size, place, sim, root = _read(batches, 6)
        order = np.lexsort((fp, k))
        k, fp, size, place, sim, root = (x[order] for x in (k, fp, size, place, sim, root))
        left, distances = False, pivot_distances(sim)
        for i, n in zip(*np.unique(k, return_index=True, return_counts=True)[1:], strict=True):
            at = np.arange(i, i + n)
            _, where, of_root = np.unique(root[at], return_inverse=True, return_counts=True)
            turn = np.lexsort((fp[at], place[at]))
            turn = turn[where[turn] != of_root.argmax()]
            used = 0
            for p in turn:
                other = at[where != where[p]]
                other = other[_may(size, place, np.full(len(other), at[p]), other)]
                a, b = undiscarded(sim, distances, size, np.full(len(other), at[p]), other)
                if not len(b):
                    continue
                if used == pivots:
                    left = True
                    break
                used += 1
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])
        if left:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, ["a", "b"])

    return task


def verified(pairs: DataFrame, texts: DataFrame, per_task: int = 500) -> DataFrame:
    """The pairs (a, b) whose texts (fp, text) have the similarity; an a with many pairs is dealt in chunks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near copies", dict)
        last, own = None, None
        for batch in batches:
            good = []
            for at in range(batch.num_rows):
                if (a := batch.column(0)[at].as_py()) != last:
                    last, own = a, shingles(batch.column(2)[at].as_py())
                other = shingles(batch.column(3)[at].as_py())
                both = len(own) + len(other) - len(np.union1d(own, other))
                good.append(WHOLE * both >= PART * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), "b")
    others = dealt.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    owns = texts.join(chunks, texts["fp"] == chunks["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("text").alias("text_a"))
    return others.join(owns, ["a", "chunk"]).select("a", "b", "text_a", "text_b").mapInArrow(each, "a long, b long")


def similar(df: DataFrame, keys: DataFrame, fps: DataFrame, small: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root): components of the links at the similarity. keys: stored rows of ``FOUND``; fps: stored (fp, _first)."""
    n = max(partitions(df.sparkSession), keys.count() // 1_000_000)
    dealt = keys.select("key", "fp", "size", "place", "sim")
    near = stored(dealt.repartition(n, "key").mapInArrow(_first(small), "a long, b long, crowded long"), "near")
    pairs = stored(near.filter("a is not null").select("a", "b").distinct(), "pairs")
    crowded = stored(dealt.join(near.filter("crowded is not null").select(F.col("crowded").alias("key")), "key").distinct(), "crowded")
    nodes = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).unionAll(crowded.select("fp")).distinct()
    wanted = fps.join(nodes, "fp", "left_semi").select("fp", "_first.*")
    rows = df.select(*key(id_col, text_col), F.col(text_col).alias("text"))
    texts = stored(rows.join(wanted.hint("shuffle_hash"), ["_id", "_hash"]).dropDuplicates(["fp"]).select("fp", "text"), "texts")
    links = stored(verified(pairs, texts), "links")
    roots, pivots = components(links), 4
    if crowded.isEmpty():
        return roots
    tested = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    while True:
        known = crowded.join(roots, crowded["fp"] == roots["node"], "left").select(*dealt.columns, F.coalesce("root", "fp").alias("root"))
        found = stored(known.repartition(n, "key").mapInArrow(_more(pivots), "a long, b long"), "found")
        new = found.filter("a is not null").groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"))
        new = stored(new.join(tested, ["low", "high"], "left_anti").select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"), "low", "high"), "new")
        if not new.isEmpty():
            links = links.unionAll(stored(verified(new.select("a", "b"), texts), "links"))
            tested = tested.unionAll(new.select("low", "high"))
            roots = components(links)
        if found.filter("a is null").isEmpty():
            return roots
        pivots *= 4


def one_of_each_similar(df: DataFrame, small: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows and columns, without all but one row (the least id) of each component of near copies.

    Texts without words, nulls among them, are copies of each other; so are texts with the
    same shingles, and repeated rows. A null id comes last. Of rows equal in id and text,
    the least by all columns that can be compared stays. A text of any length is one set of
    all its shingles. An empty table gives no rows. Columns may have any names.
    """
    found = stored(signed(df, id_col, text_col), "shingles")
    docs = found.filter("key is null")
    fps = stored(docs.groupBy("fp").agg(F.min(F.struct("_id", "_hash")).alias("_first")), "distinct")
    near = similar(df, found.filter("key is not null"), fps, small, id_col, text_col)
    first = fps.join(near, fps["fp"] == near["node"], "left").groupBy(F.coalesce("root", "fp").alias("_root")).agg(F.min("_first").alias("_first"))
    first = stored(first, "first").select("_first.*")
    return only(df, first, id_col, text_col, once=True)
