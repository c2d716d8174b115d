"""Dialect C: entry trees. Acceptance, the root path of a leaf, compaction and dispositions.

Entries: (session_id, ord, id, parent_id, type, ...), ord being the order in which they
were appended. A session's entries are folded together, as a session is one file; sessions
are spread over the cluster.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _on_cycles(parents: dict) -> set:
    """The ids whose parents lead back to them: what is left of the ids that no root reaches when all without children among them are peeled off."""
    children: dict = {}
    for id_, parent in parents.items():
        children.setdefault(parent, []).append(id_)
    apart, reached = set(parents), [p for p in children if p not in parents]
    while reached:
        below = children.get(reached.pop(), [])
        apart.difference_update(below)
        reached += below
    many = {id_: sum(c in apart for c in children.get(id_, ())) for id_ in apart}
    bare = [id_ for id_ in apart if not many[id_]]
    while bare:
        id_ = bare.pop()
        apart.discard(id_)
        many[parents[id_]] -= 1
        if not many[parents[id_]]:
            bare.append(parents[id_])
    return apart


def _verdicts(session: pa.Table) -> pa.Table:
    session = session.sort_by("ord")
    rows = list(zip(session.column("id").to_pylist(), session.column("parent_id").to_pylist(), strict=True))
    parents: dict = {}
    for id_, parent in rows:
        if id_:
            parents.setdefault(id_, parent)
    cyclic, known, out = _on_cycles(parents), set(), []
    for id_, parent in rows:
        if not id_:
            out.append("empty_id")
        elif id_ in known:
            out.append("duplicate_id")
        elif id_ in cyclic:
            out.append("cycle")
        elif parent is not None and parent not in known:
            out.append("missing_parent")
        else:
            known.add(id_)
            out.append("accepted")
    return session.select(["session_id", "ord"]).append_column("verdict", pa.array(out, pa.string()))


def verdicts(entries: DataFrame) -> DataFrame:
    """entries with verdict: accepted, or why not: empty_id, duplicate_id (of an accepted entry), cycle, missing_parent.

    An entry needs a parent that was accepted before it, or none. A session's ids are gone
    through in order in one task; its other columns stay where they are. ord tells a
    session's entries apart. A null id is an empty one.
    """
    fields = [entries.schema[c] for c in ("session_id", "ord")]
    of = entries.select("session_id", "ord", "id", "parent_id").groupBy("session_id").applyInArrow(_verdicts, T.StructType([*fields, T.StructField("verdict", T.StringType())]))
    return entries.join(of, ["session_id", "ord"])


def accepted(entries: DataFrame) -> DataFrame:
    """The entries whose verdict is that: orphans, and all below them, are left out, and so are duplicates and cycles."""
    return verdicts(entries).filter("verdict = 'accepted'").drop("verdict")


def leaves(entries: DataFrame) -> DataFrame:
    """(session_id, id) of the entries that are no entry's parent."""
    parents = entries.select("session_id", F.col("parent_id").alias("id"))
    return entries.select("session_id", "id").join(parents, ["session_id", "id"], "left_anti")


def _path(leaf: Column | None) -> Column:
    """The ids from the root to the leaf: a backward fold, as a parent always comes before its child."""
    edges = F.reverse(F.array_sort(F.collect_list(F.struct("ord", "id", "parent_id"))))
    start = F.struct((leaf if leaf is not None else F.max_by("id", "ord")).alias("next"), F.expr("cast(array() as array<string>)").alias("path"))
    up = F.aggregate(edges, start, lambda s, e: F.when(e["id"] == s["next"], F.struct(e["parent_id"].alias("next"), F.array_append(s["path"], e["id"]).alias("path"))).otherwise(s))
    return F.reverse(up["path"])


def root_path(entries: DataFrame, leaf: str | None = None) -> DataFrame:
    """(session_id, id, place from the root) of the path to the leaf, by default each session's last entry."""
    paths = entries.groupBy("session_id").agg(_path(F.lit(leaf) if leaf else None).alias("path"))
    return paths.select("session_id", F.posexplode("path").alias("place", "id")).withColumn("place", F.col("place").cast("long"))


def compacted(entries: DataFrame, leaf: str | None = None) -> DataFrame:
    """The active branch after compaction: (session_id, place, key, entry_id, origin).

    Entries also have first_kept_id and retained (array of strings, null if absent). The
    latest compaction of the path wins: with retained, even an empty one, that stands for
    all before it; else the entries from first_kept_id on stay, without older compactions.
    Order: the compaction, what is kept, what follows.
    """
    path = root_path(entries, leaf).join(entries.select("session_id", "id", "type", "first_kept_id", "retained"), ["session_id", "id"])
    last = path.filter("type = 'compaction'").groupBy("session_id").agg(F.max("place").alias("_at"), F.max_by(F.struct("id", "first_kept_id", "retained"), "place").alias("c"))
    kept = path.select(F.col("session_id").alias("_s"), F.col("id").alias("_kept"), F.col("place").alias("_from"))
    on = last.join(kept, (F.col("session_id") == F.col("_s")) & (F.col("c.first_kept_id") == F.col("_kept")), "left").drop("_s")
    rows = path.join(on, "session_id", "left")
    none, after = F.col("_at").isNull(), F.col("place") > F.col("_at")
    legacy = F.col("c.retained").isNull() & F.col("_from").isNotNull() & (F.col("place") >= F.col("_from")) & (F.col("place") < F.col("_at")) & (F.col("type") != "compaction")
    own = rows.filter(none | after | legacy | (F.col("place") == F.col("_at")))
    rank = F.when(F.col("place") == F.col("_at"), 0).when(legacy, 1).otherwise(2)
    plain = own.select("session_id", F.struct(rank.alias("r"), F.col("place").alias("p"), F.lit(0).alias("n")).alias("_order"), F.col("id").alias("key"), F.col("id").alias("entry_id"), F.when(legacy, "kept").otherwise("entry").alias("origin"))
    tail = last.select("session_id", "c", F.posexplode("c.retained").alias("n", "_r"))
    retained = tail.select("session_id", F.struct(F.lit(1).alias("r"), F.lit(0).cast("long").alias("p"), F.col("n")).alias("_order"), F.concat(F.lit("retained:"), F.col("c.id"), F.lit(":"), F.col("n").cast("string")).alias("key"), F.col("c.id").alias("entry_id"), F.lit("retained").alias("origin"))
    branches = plain.unionAll(retained).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("_order", "key", "entry_id", "origin"))).alias("b"))
    return branches.select("session_id", F.posexplode("b").alias("place", "x")).select("session_id", F.col("place").cast("long").alias("place"), "x.key", "x.entry_id", "x.origin")


def dispositions(entries: DataFrame, leaf: str | None = None, compact: bool = False) -> DataFrame:
    """(session_id, id, disposition): active, summarized (on the path, compacted away) or off_branch."""
    path = root_path(entries, leaf).select("session_id", "id", F.lit(True).alias("_on"))
    out = entries.select("session_id", "id").join(path, ["session_id", "id"], "left")
    if not compact:
        return out.select("session_id", "id", F.when(F.col("_on"), "active").otherwise("off_branch").alias("disposition"))
    active = compacted(entries, leaf).filter("origin <> 'retained'").select("session_id", F.col("entry_id").alias("id"), F.lit(True).alias("_active"))
    return out.join(active, ["session_id", "id"], "left").select("session_id", "id", F.when(F.col("_active"), "active").when(F.col("_on"), "summarized").otherwise("off_branch").alias("disposition"))


def warnings(entries: DataFrame) -> DataFrame:
    """(session_id, code, entry_id, related_id): entries that were not accepted, and labels and summaries of entries that were not."""
    told = verdicts(entries)
    none = F.lit(None).cast("string")
    refused = told.filter("verdict <> 'accepted'")
    code, named = F.col("verdict").alias("code"), F.when(F.col("verdict") != "empty_id", F.col("id"))
    # a cycle is told of each id once, though the id come again
    cycles = refused.filter("verdict = 'cycle'").select("session_id", code, named.alias("entry_id"), none.alias("related_id")).distinct()
    related = F.when(F.col("verdict") == "missing_parent", F.col("parent_id"))
    out = refused.filter("verdict <> 'cycle'").select("session_id", code, named.alias("entry_id"), related.alias("related_id")).unionAll(cycles)
    kept = told.filter("verdict = 'accepted'")
    known = kept.select(F.col("session_id").alias("_s"), F.col("id").alias("_k"))
    for kind, ref, name in (("label", "target_id", "dangling_label_reference"), ("branch_summary", "from_id", "dangling_branch_reference")):
        if ref in entries.columns:
            asked = kept.filter((F.col("type") == kind) & F.col(ref).isNotNull()).select("session_id", F.lit(name).alias("code"), F.col("id").alias("entry_id"), F.col(ref).alias("related_id"))
            out = out.unionAll(asked.join(known, (F.col("session_id") == F.col("_s")) & (F.col("related_id") == F.col("_k")), "left_anti"))
    return out


def dangling(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results (session_id, ord, call_id, ...) whose call (session_id, ord, call_id) comes later or never.

    Of a call that comes again the first counts, so a call is one row whatever its repeats; a
    null id dangles.
    """
    first = calls.groupBy("session_id", "call_id").agg(F.min("ord").alias("_called"))
    told = results.join(first, ["session_id", "call_id"], "left")
    return told.filter(F.col("_called").isNull() | (F.col("_called") >= F.col("ord"))).select(*results.columns)
