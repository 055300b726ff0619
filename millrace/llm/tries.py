"""Prefix tries of conversations: a node for each distinct sequence of first turns, with counts over its subtree.

Turns are compared by digests of their role and text, and equal conversations count as one sequence with how
many there are.  Sequences are dealt by a hash of their first turn and built into tries of pointer dictionaries,
some hundred thousand turns to a task.  The sequences below one first turn that are more than that leave the
turns they have in common as a chain of nodes of its own and are dealt again by the turn that follows, as often
as it takes.  The sums over a subtree that was dealt on come from the tops of its parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Turns of a trie that one task builds, at most, and at least before a first turn is thought worth dealing on.
MOST_TURNS, LEAST_TURNS = 100_000, 500
#: Subtries whose facts are broadcast, at most; beyond that they are joined by a shuffle.
FEW = 20_000
#: Ids share a row of a list of ids if they agree but for so many low bits.
ID_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text, step, bytes): turns numbered from 1 in the order of ``turn``, null first.

    Null roles and texts become empty.  Rows of one turn come in the order of ``step``, the digest of role and
    text, and rows that repeat are turns of their own.  Rows without a conversation id go; other columns are not
    looked at.
    """
    named = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    named = named.where("conv_id is not null").withColumn("step", F.substring(F.sha2(whole, 256), 1, 32)).withColumn("bytes", F.octet_length("text").cast("long"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "step"))
    return named.withColumn("place", place).select("conv_id", "place", "role", "text", "step", "bytes")


def spliced(turns: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """(conv_id, part, place, step, bytes) of conversations that begin with turns of another.

    Conversation c has the first h turns of conversation ``c - c % every`` and then its own after its first h,
    h being crc32(c in decimal) modulo ``modulus``; a donor that is absent gives none.  A row with part 0 and no
    step stands for each conversation, so that those without turns are not lost.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    ids = turns.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("donor"), h.alias("h"))
    heads = turns.where((F.col("place") < modulus) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("donor"), "place", "step", "bytes")
    given = ids.join(heads, "donor").where("place <= h").select("conv_id", F.lit(1).alias("part"), "place", "step", "bytes")
    own = turns.where(F.col("place") > h).select("conv_id", F.lit(2).alias("part"), "place", "step", "bytes")
    marks = ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("step"), F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(given).unionByName(marks)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, steps, sizes, seq) of (conv_id, part, place, step, bytes): a conversation's turns in order, and a digest of all.

    A conversation is one row of some 40 bytes a turn.
    """
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "step", "bytes"))).alias("turns"))
    rows = rows.withColumn("turns", F.filter("turns", lambda t: t["step"].isNotNull()))
    rows = rows.select("conv_id", F.transform("turns", lambda t: t["step"]).alias("steps"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    return rows.withColumn("seq", F.sha2(F.array_join("steps", "").cast("binary"), 256))


def _ends(convs: DataFrame) -> DataFrame:
    """(conv_id, n, ends): for each distinct sequence its smallest conversation, how many there are, and the digest of their ids.

    Ids are joined in short runs first; then one pass over the runs of a sequence, in order, feeds the digest, so
    that no list of all ids of a sequence exists.
    """
    runs = convs.groupBy("seq", F.shiftright("conv_id", ID_BITS).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("seq", "run", F.element_at("ids", 1).alias("conv_id"), F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    alone = runs.groupBy("seq").agg(F.count(F.lit(1)).alias("runs"))
    runs = cut(runs.join(alone, "seq"), "trie-ids")
    single = runs.where("runs = 1").select("conv_id", "n", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, n, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for s, conv, count, ids in zip(*(batch.column(k).to_pylist() for k in ("seq", "conv_id", "n", "ids"))):
                if s != seq:
                    if seq is not None:
                        done.append((first, n, digest.hexdigest()))
                    seq, first, n, digest = s, conv, 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                n += count
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["conv_id", "n", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "n", "ends"])

    many = runs.where("runs > 1").select("seq", "run", "conv_id", "n", "ids").repartition("seq").sortWithinPartitions("seq", "run")
    return single.unionByName(many.mapInArrow(feed, "conv_id long, n long, ends string"))


def _prefix(steps: Column, n: Column) -> Column:
    """A digest of the first n turns."""
    return F.sha2(F.array_join(F.slice(steps, F.lit(1), n), "").cast("binary"), 256)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries in ``pdf``; ``above`` is set for their tops only.

    Nodes are numbered as they are made, parents first, so counting down visits every child before its parent.
    """
    kids: list[dict[str, int]] = []
    up, depth, conv, convs, size, ends = [], [], [], [], [], []
    tops: dict[str, int] = {}
    above: dict[int, tuple[int, list[str]]] = {}

    def node(parent: int, at: int, own: int, octets: int) -> int:
        kids.append({})
        for column, value in ((up, parent), (depth, at), (conv, own), (convs, 0), (size, octets), (ends, NOTHING)):
            column.append(value)
        return len(kids) - 1

    for own, n, end, steps, sizes, known, key, parent, spines in pdf[["conv_id", "n", "ends", "steps", "sizes", "known", "key", "parent", "spines"]].itertuples(index=False):
        if key not in tops:
            tops[key] = node(-1, known + 1, own, sizes[known])
            above[tops[key]] = (parent, list(spines))
        v = tops[key]
        conv[v], convs[v] = min(conv[v], own), convs[v] + n
        for at in range(known + 1, len(steps)):
            below = kids[v].get(steps[at])
            if below is None:
                below = kids[v][steps[at]] = node(v, at + 1, own, sizes[at])
            v = below
            conv[v], convs[v] = min(conv[v], own), convs[v] + n
        ends[v] = end
    leaves, saved = [0] * len(kids), [(n - 1) * octets for n, octets in zip(convs, size)]
    for v in range(len(kids) - 1, -1, -1):
        if not kids[v]:
            leaves[v] = 1
        if up[v] >= 0:
            leaves[up[v]] += leaves[v]
            saved[up[v]] += saved[v]
    parents = [conv[u] if u >= 0 else above[v][0] for v, u in enumerate(up)]
    out = {"conv_id": conv, "depth": depth, "parent_conv_id": parents, "n_convs": convs, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends}
    return pd.DataFrame(out | {"above": [above[v][1] if v in above else None for v in range(len(kids))]})


def _with(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Rows beside the facts of their key, which are broadcast where they were counted and are few."""
    return rows.join(F.broadcast(facts) if facts.count() <= FEW else facts, "key", how)


def trie(convs: DataFrame, most_turns: int = MOST_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, steps, sizes, seq), one row each.

    ``conv_id`` is a node's smallest member, ``parent_conv_id`` that of its parent (null for the root, whose
    depth is 0), ``n_convs`` its members, ``n_children`` its children; ``n_leaves`` and ``saved_tokens`` are sums
    over its subtree, of childless nodes and of members but one times bytes of the last text; ``ends_sha256`` is
    the digest of the ids of the members that end in it.  Conversations without turns end in the root.  No
    conversations, no root: an empty table gives an empty result.
    """
    spark = convs.sparkSession
    convs = cut(convs, "trie-convs")
    heads = cut(_ends(convs.select("conv_id", "seq")).join(convs.select("conv_id", "steps", "sizes"), "conv_id"), "trie-heads")
    whole = heads.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.size("steps")).alias("turns"), F.max(F.when(F.size("steps") == 0, F.col("ends"))).alias("ends")).first()
    if whole["conv_id"] is None:
        return spark.createDataFrame([], _NODE)
    share = whole["turns"] // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    limit = min(most_turns, max(least_turns, share))

    left = heads.where(F.size("steps") > 0).withColumn("known", F.lit(0)).withColumn("key", _prefix(F.col("steps"), F.lit(1)))
    left = left.withColumn("parent", F.lit(whole["conv_id"]).cast("long")).withColumn("spines", F.array().cast("array<string>"))
    ready, chains = [], []
    while True:
        sizes = left.groupBy("key").agg(F.sum(F.size("steps") - F.col("known")).alias("turns"), F.count(F.lit(1)).alias("seqs"))
        large = cut(sizes.where((F.col("turns") > limit) & (F.col("seqs") > 1)).select("key"), "trie-large")
        if large.isEmpty():
            ready.append(left)
            break
        ready.append(_with(left, large, "left_anti"))
        mine = _with(left, large)
        lo = F.struct("steps", "sizes", "ends")
        facts = mine.groupBy("key").agg(F.min(lo).alias("lo"), F.max("steps").alias("hi"), F.min("conv_id").alias("own"), F.sum("n").alias("n_convs"), F.min("known").alias("before"), F.min("parent").alias("over"), F.min("spines").alias("ancestors"))
        differ = F.filter(F.sequence(F.lit(1), F.size("lo.steps")), lambda k: F.coalesce(F.try_element_at("lo.steps", k) != F.try_element_at("hi", k), F.lit(True)))
        facts = cut(facts.withColumn("common", F.when(F.size(differ) > 0, F.array_min(differ) - 1).otherwise(F.size("lo.steps"))), "trie-chains")
        chains.append(facts)
        below = _with(mine, facts.select("key", "own", "common")).where(F.size("steps") > F.col("common"))
        left = below.select("conv_id", "n", "ends", "steps", "sizes", F.col("common").alias("known"), _prefix(F.col("steps"), F.col("common") + 1).alias("key"), F.col("own").alias("parent"), F.array_append("spines", F.col("key")).alias("spines"))
        left = cut(left, "trie-left")

    ready = reduce(DataFrame.unionByName, [r.select("conv_id", "n", "ends", "steps", "sizes", "known", "key", "parent", "spines") for r in ready])
    buckets = max(1, -(-2 * whole["turns"] // limit))
    dealt = ready.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    built = cut(dealt.groupBy("bucket").applyInPandas(_build, _NODE + ", above array<string>"), "trie-nodes")
    out = built.drop("above")

    tops = built.where("above is not null").select("above", F.lit(1).alias("tops"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("parent_conv_id").alias("parent"), "depth")
    parts = tops
    if chains:
        saved = F.aggregate(F.slice("lo.sizes", F.col("before") + 1, F.col("common") - F.col("before")), F.lit(0).cast("long"), lambda s, x: s + x) * (F.col("n_convs") - 1)
        facts = reduce(DataFrame.unionByName, chains).withColumn("chain", saved)
        parts = parts.unionByName(facts.select(F.col("ancestors").alias("above"), F.lit(1).alias("tops"), F.lit(0).cast("long").alias("leaves"), F.col("chain").alias("saved"), F.col("over").alias("parent"), (F.col("before") + 1).cast("long").alias("depth")))
        parts = cut(parts, "trie-parts")
        sums = parts.select("leaves", "saved", F.explode("above").alias("key")).groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
        kids = parts.where(F.size("above") > 0).select(F.element_at("above", -1).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("kids"))
        spine = facts.join(sums, "key").join(kids, "key").withColumn("depth", F.explode(F.sequence(F.col("before") + 1, F.col("common"))))
        rest = F.aggregate(F.slice("lo.sizes", F.col("depth"), F.col("common") - F.col("depth") + 1), F.lit(0).cast("long"), lambda s, x: s + x) * (F.col("n_convs") - 1)
        last = F.col("depth") == F.col("common")
        out = out.unionByName(
            spine.select(
                F.col("own").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("before") + 1, F.col("over")).otherwise(F.col("own")).alias("parent_conv_id"), "n_convs",
                F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + rest).alias("saved_tokens"),
                F.when(last & (F.size("lo.steps") == F.col("common")), F.col("lo.ends")).otherwise(NOTHING).alias("ends_sha256"),
            )
        )
    root = parts.agg(F.coalesce(F.sum(F.when(F.size("above") == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    root = root.select(
        F.lit(whole["conv_id"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n_convs"]).cast("long").alias("n_convs"), "n_children",
        F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", F.lit(whole["ends"] or NOTHING).alias("ends_sha256"),
    )
    return out.unionByName(root)


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` of :func:`trie` with the role and text of their last turns, from (conv_id, place, role, text); the root has none."""
    said = turns.select("conv_id", F.col("place").cast("long").alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")
