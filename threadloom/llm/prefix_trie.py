"""Operator 12, conversation prefix trie: which beginnings conversations share, and what sharing them would save.

A conversation's turns are hashed, and chained: the digest of its first d turns is the
SHA-256 of the digest of its first d - 1 and of turn d, cut to 16 bytes. Each prefix of each
conversation is a row; rows of one depth and digest are a node of the trie. A node is then
exploded to its ancestors, whose subtrees' sums are added up.

A row carries the digests of its ancestors, but only back to the last depth that is a
multiple of ``block``; nodes at such depths carry those of each other in the same way, and
so on. Sums go up within blocks, then along the nodes between blocks, and back: work is
linear in the turns, however long a conversation is. Texts are hashed where they are read
and never shuffled.

A conversation passes one task as a sorted stream, a turn at a time, as its digests are a
chain. Nodes may have any share of all conversations as members or children: counts are
combined in the tasks before they are shuffled, and the parents' join is the query's last
step, where Spark can split a hot parent's children. The ids that end at a node are joined
to strings range by range, side by side, and one task streams the strings through SHA-256,
which is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import stored, table

#: Bytes of a node's digest, and depths in a block.
ID, BLOCK = 16, 16
#: Ids in one string at most.
JOINED = 8192

PREFIX = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("path", T.BinaryType()), T.StructField("bytes", T.LongType()), T.StructField("last", T.BooleanType())])


def rebuilt(df: DataFrame, every: int = 5, most: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, pos, digest, bytes): each conversation's turns in order, the first ``h`` being those of the conversation c - c % every.

    part -1 is a row for the conversation itself, 0 the turns taken over, 1 its own.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    read = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), content.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).filter("conv_id is not null")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "digest")) - 1
    turns = stored(read.select("conv_id", at.cast("long").alias("pos"), "digest", "bytes"), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.filter(F.col("pos") >= taken)
    convs = turns.filter("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("_base"), taken.alias("_h"))
    heads = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "_base").join(convs, "_base").filter("pos < _h")
    marks = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return marks.unionByName(heads.select("conv_id", F.lit(0).alias("part"), "pos", "digest", "bytes")).unionByName(own.withColumn("part", F.lit(1)))


def chained(turns: Iterator[tuple[int, int, bytes | None, int]], block: int) -> Iterator[tuple[int, int, bytes, bytes, int, bool]]:
    """A row for each prefix, of sorted (conv_id, part, digest, bytes): conv_id, depth, node, path, bytes, and whether it is the whole."""
    waiting, state, depth, root, above = None, b"", 0, b"", []
    for conv, part, digest, size in turns:
        if waiting is not None:
            yield *waiting, part < 0
        path = []
        if part < 0:
            state, depth, above = hashlib.sha256(b"").digest(), 0, []
            root = state[:ID]
        else:
            state, at, level = hashlib.sha256(state + digest).digest(), depth + 1, 0
            depth = at
            while True:
                if level == len(above):
                    above.append([root])
                path += above[level]
                if at % block:
                    above[level].append(state[:ID])
                    break
                above[level] = [state[:ID]]
                at, level = at // block, level + 1
        waiting = (conv, depth, state[:ID], b"".join(path), size)
    if waiting is not None:
        yield *waiting, True


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each prefix of each conversation, of ``rebuilt`` turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("path", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(chained(tuples(batches), block), schema)

    in_order = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return in_order.select("conv_id", "part", "digest", "bytes").mapInArrow(each, PREFIX)


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the decimal ids in order, joined by commas."""
    strings, hashes = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def joined(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple[bytes, int, str]]:
        node, ids = None, []
        for at, conv in rows:
            if ids and (at != node or len(ids) == JOINED):
                yield node, ids[0], ",".join(map(str, ids))
                ids = []
            node = at
            ids.append(conv)
        if ids:
            yield node, ids[0], ",".join(map(str, ids))

    def hashed(rows: Iterator[tuple[bytes, str]]) -> Iterator[tuple[bytes, str]]:
        node, state = None, None
        for at, ids in rows:
            if at != node:
                if state is not None:
                    yield node, state.hexdigest()
                node, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if state is not None:
            yield node, state.hexdigest()

    ranged = ends.repartitionByRange("conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id")
    pieces = ranged.mapInArrow(lambda batches: in_batches(joined(tuples(batches)), strings, 16), "node binary, first long, ids string")
    in_order = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return in_order.mapInArrow(lambda batches: in_batches(hashed(tuples(batches)), hashes), "node binary, ends_sha256 string")


def _ancestors(block: int):
    """The digests of ``path`` that belong to the level of ``at``."""
    n = F.when(F.col("at") > 0, F.pmod(F.col("at") - 1, F.lit(block)) + 1).otherwise(0).cast("int")
    digest = lambda i: F.substring(F.col("path"), i * ID + 1, F.lit(ID))
    return n, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), digest)).otherwise(F.array().cast("array<binary>"))


def subtree_sums(items: DataFrame, deepest: int, block: int) -> DataFrame:
    """(node, n_leaves, saved) summed over each subtree, of (node, at, path, n_leaves, saved): each node is exploded to its ancestors.

    Where paths end at the last multiple of ``block``, first what lies below the nodes between
    blocks is summed, block by block and then along those nodes.
    """
    n, ancestors = _ancestors(block)
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_leaves", "saved")]
    if deepest <= block:
        return items.select(F.explode(F.concat(F.array("node"), ancestors)).alias("node"), "n_leaves", "saved").groupBy("node").agg(*sums)
    below = items.filter("at > 0").select(F.substring("path", 1, ID).alias("node"), "n_leaves", "saved").groupBy("node").agg(*sums)
    between = items.filter(F.col("at") % block == 0).select("node", (F.col("at") / block).cast("long").alias("at"), F.substring(F.col("path"), n * ID + 1, F.octet_length("path")).alias("path"))
    between = stored(between.join(below, "node", "left").na.fill(0, ["n_leaves", "saved"]), "between")
    under = subtree_sums(between, deepest // block, block).select("node", F.col("n_leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    whole = items.join(under, "node", "left").na.fill(0, ["_leaves", "_saved"]).withColumns({"n_leaves": F.col("n_leaves") + F.col("_leaves"), "saved": F.col("saved") + F.col("_saved")})
    inner = F.slice(ancestors, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return whole.select(F.explode(F.concat(F.array("node"), inner)).alias("node"), "n_leaves", "saved").groupBy("node").agg(*sums)


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of ``rebuilt`` conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    each = stored(prefixes(turns, block), "prefixes")
    nodes = stored(each.groupBy("depth", "node", "path").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes")), "nodes")
    parent = F.when(F.col("depth") > 0, F.substring(F.col("path"), (F.pmod(F.col("depth") - 1, F.lit(block)) * ID + 1).cast("int"), F.lit(ID)))
    children = nodes.filter("depth > 0").groupBy(parent.alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = stored(nodes.join(children, "node", "left").na.fill(0, ["n_children"]).withColumn("parent", parent), "tree")
    items = tree.select("node", F.col("depth").alias("at"), "path", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = subtree_sums(items, tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], block).withColumnRenamed("saved", "saved_tokens")
    told = tree.join(sums, "node").join(ends_hashed(each.filter("last")), "node", "left")
    told = told.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    parents = tree.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return told.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(df: DataFrame, block: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie's nodes, a row each, of conversations rebuilt by the contract's rule.

    Null roles and texts are empty; null turns come first, and equal turns go by their
    content's digest, so repeated rows are turns like others. Rows with a null conversation
    id belong to no conversation. c - c % 5 takes the sign of c. A text of any length counts
    whole. Other columns are ignored, whatever their names; an empty table gives no rows, not
    even a root. Nodes are told apart by 128 bits.
    """
    return trie(rebuilt(df, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), block)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: The same rows by DuckDB, whose prefixes are lists of turns; CRC-32 bit by bit.
SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base FROM t),
k AS (SELECT conv_id, base, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, 3988292384 * (x % 2))))) % 9 AS h
      FROM c),
r AS (SELECT k.conv_id, 0 AS part, pos, said FROM k JOIN t ON t.conv_id = k.base AND pos < h
      UNION ALL SELECT k.conv_id, 1, pos, said FROM k JOIN t ON t.conv_id = k.conv_id AND pos >= h),
l AS (SELECT k.conv_id, coalesce(list(said ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS said FROM k LEFT JOIN r USING (conv_id) GROUP BY k.conv_id),
p AS (SELECT conv_id, unnest(range(0, len(said) + 1)) AS depth, said FROM l),
n AS (SELECT depth, said[1:depth] AS node, count(*) AS n_convs, min(conv_id) AS conv_id, coalesce(strlen(any_value(said[depth].text)), 0) AS bytes,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(said) = depth), '')) AS ends_sha256
      FROM p GROUP BY ALL),
m AS (SELECT n.*, (SELECT count(*) FROM n AS o WHERE o.depth = n.depth + 1 AND o.node[1:n.depth] = n.node) AS n_children FROM n),
u AS (SELECT *, unnest(range(0, depth + 1)) AS top FROM m),
s AS (SELECT node[1:top] AS node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM u GROUP BY node[1:top])
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (node) LEFT JOIN m AS o ON o.depth = m.depth - 1 AND o.node = m.node[1:m.depth - 1]
"""
