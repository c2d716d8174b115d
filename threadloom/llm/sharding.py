"""Operator 1, sharding: best-fit-decreasing bin packing of indivisible groups.

A group's rows stay in one shard. Groups that weigh anything against a shard (over 1/64 of
one, so 64 x shards groups at most) are units of their own; all smaller groups are joined
by a hash of their key into 256 x shards bundles. The driver therefore packs a number of
units that depends on the number of shards and never on the corpus. Only a group that no
shard can hold is cut, by a hash of its row ids, into pieces of 1/16 of a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import numbered, stored, table


class Bins:
    """A balanced tree (treap) of bins by (room, bin): the tightest bin that has room, in logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Bins._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = Bins._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    @staticmethod
    def _join(a, b):
        if a is None or b is None:
            return a or b
        if a[1] >= b[1]:
            return a[0], a[1], a[2], Bins._join(a[3], b)
        return b[0], b[1], Bins._join(a, b[2]), b[3]

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        rank = ((number + 1) * 0x9E3779B97F4A7C15 + room * 0xC2B2AE3D27D4EB4F) % 2**64
        self.root = self._join(self._join(low, ((room, number), rank, None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least size."""
        low, high = self._split(self.root, (size, -1))
        node, found = high, None
        while node is not None:
            found, node = node[0], node[2]
        if found is not None:
            _, high = self._split(high, (found[0], found[1] + 1))
        self.root = self._join(low, high)
        return found


def best_fit_decreasing(units: list[tuple[int, int]], capacity: int) -> tuple[dict[int, int], int]:
    """Place units (size, id) into as few bins of the capacity as best fit needs: bin of each id, and how many bins."""
    bins, placed, opened = Bins(), {}, 0
    for size, unit in sorted(units, key=lambda u: (-u[0], u[1])):
        room, number = bins.take(size) or (max(capacity, size), opened)
        opened += number == opened
        placed[unit] = number
        bins.add(room - size, number)
    return placed, opened


def fill_shards(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The shard of each unit: the least capacity for which best fit needs no more bins than shards.

    A unit larger than an even share has a shard to itself, and the others share the rest.
    """
    left, placed = sorted(units, key=lambda u: (-u[0], u[1])), {}
    while left and shards > 1 and left[0][0] * shards >= sum(s for s, _ in left):
        shards -= 1
        placed[left.pop(0)[1]] = shards
    if not left:
        return placed
    low = max(-(-sum(s for s, _ in left) // shards), left[0][0])
    step, high = max(1, low // 10_000), low
    while (found := best_fit_decreasing(left, high))[1] > shards:
        high, step = high + step, step * 2
    best, low = found[0], high - step // 2
    for _ in range(8):
        middle = (low + high) // 2
        if middle >= high or middle <= low:
            break
        placing, used = best_fit_decreasing(left, middle)
        if used <= shards:
            best, high = placing, middle
        else:
            low = middle
    return placed | best


def shard(df: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Groups are equal texts; sizes of shards are near equal. A null text counts as an empty
    one. Null and repeated ids are placed like others; slots number a shard's rows by id. A
    row larger than an even share has its shard to itself. Other columns are ignored, an
    empty table gives no rows, and reruns place rows alike.
    """
    spark, text = df.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.sha2(text, 256).alias("_group")), "rows")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = max(1, -(-total // shards))
    bundles = 256 * shards
    large = rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") * 64 >= share).collect()  # 64 x shards at most
    units, at = [], bundles
    for r in sorted(large, key=lambda r: r["_group"]):
        cuts = -(-16 * r["_bytes"] // share) if r["_bytes"] > share else 1
        units.append((r["_group"], at, cuts))
        at += cuts
    own = spark.createDataFrame(units, "_group string, _first int, _cuts int")
    piece = F.col("_first") + F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.col("_cuts"))
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles))
    dealt = rows.join(F.broadcast(own), "_group", "left").withColumn("_unit", F.coalesce(piece, bundle).cast("int"))
    sizes = [(r["_bytes"], r["_unit"]) for r in dealt.groupBy("_unit").agg(F.sum("size").alias("_bytes")).collect()]  # about 320 x shards at most
    places = spark.createDataFrame(sorted(fill_shards(sizes, shards).items()), "_unit int, shard int")
    placed = dealt.join(F.broadcast(places), "_unit").select("doc_id", "size", "text_crc32", "shard")
    ranked = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", count)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
