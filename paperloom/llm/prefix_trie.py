"""Conversations as a trie of turns: which beginnings they share, and what sharing them saves.

Texts stay where they are read: a turn goes on as the SHA-256 of role and text, and its length. Turns
get their places by a range partitioning, so a conversation of any length is ranked by many tasks.
Conversations are dealt out by a hash of their first turn's digest. A task builds the tries of its
part as dictionaries of children by digest, nodes in order of creation; children come after their
parents, so sums run over the nodes once, from the last to the first, without recursion.

A beginning that too many turns hang below is no part: its node is made by aggregations, with all further
nodes up to where its conversations part, and what follows is dealt out by the next turn, and so on. What
only one conversation holds needs no trie: its nodes are written from its length.

Order of turns: by turn (null first), equal ones by digest. Defined results: null role or text is empty;
rows without conv_id belong to no conversation; repeated rows are turns of their own; conversations
without turns (all taken away, and none to begin with) are members of the root alone; an empty table has
no root; columns beside conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, sent_if_few, shuffle_partitions

#: Turns that one task's tries hold; beginnings with more below them are split.
PART_TURNS = 20_000
#: Conversations begin with up to five turns of the one whose id ends in 00.
FAMILY, HEADS = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()
ROOT = ""
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# -- turns and their places


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; the role's length tells where it ends."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def placed_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), digest and chars of each turn.

    Equal turns are counted first and the rest is dealt out by ranges of (conv_id, turn, digest): no
    conversation and no repeated turn has to go through one task.
    """
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(F.col("role"), F.col("text")).alias("digest"), chars.alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    ranged = rows.groupBy("conv_id", "turn", "digest", "chars").agg(F.count("*").alias("times")).repartitionByRange(shuffle_partitions(turns.sparkSession), *order)
    ranged = scratch.table(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv_id", "part").agg(F.sum("times").alias("held")).select("conv_id", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = ranged.withColumn("last", F.sum("times").over(within)).join(offsets, ["conv_id", "part"])
    place = F.explode(F.sequence(F.col("offset") + F.col("last") - F.col("times") + 1, F.col("offset") + F.col("last")))
    return scratch.table(last.select("conv_id", place.alias("pos"), "digest", "chars"), "placed")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size) and their turns (conv_id, depth, digest, chars) after each took its family's head."""
    placed = placed_turns(turns, scratch)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = placed.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"heads": heads, "family": family})
    first = own.where("conv_id = family").select("family", F.least("own", F.lit(HEADS)).alias("there"))
    known = own.join(first, "family", "left").withColumn("taken", F.least("heads", F.coalesce("there", F.lit(0))))
    convs = scratch.table(known.select("conv_id", "family", "heads", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("heads"), F.lit(0))).alias("size")), "convs")
    # the turns that stay need only what their conversation's family takes
    late = placed.withColumn("heads", heads).where("pos > heads").join(convs.select("conv_id", "taken"), "conv_id")
    late = late.select("conv_id", (F.col("pos") - F.col("heads") + F.col("taken")).alias("depth"), "digest", "chars")
    lead = placed.where((F.col("conv_id") == family) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("family"), "pos", "digest", "chars")
    early = convs.select("conv_id", "family", "taken").join(lead, "family").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    return convs.select("conv_id", "size"), scratch.table(late.unionByName(early), "turns")


# -- tries of a part


def _part(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of one part; rows: key, depth, digest, chars, conv_id, size, parent, parent_conv.

    ``top`` is the parent's key on the nodes that hang below it, null on all others.
    """
    rows = rows.sort_values(["conv_id", "depth"], kind="stable")
    children: list[dict[str, int]] = []
    up, conv, depth, members, chars, ends, top, top_conv = [], [], [], [], [], [], [], []
    tops: dict[str, int] = {}
    at = -1
    for key, level, turn, length, c, size, parent, parent_conv in zip(*(rows[k].tolist() for k in ("key", "depth", "digest", "chars", "conv_id", "size", "parent", "parent_conv")), strict=True):
        first = at < 0
        table, name = (tops, key) if first else (children[at], turn)
        node = table.get(name)
        if node is None:
            node = table[name] = len(conv)
            children.append({})
            up.append(at)
            conv.append(c)  # conversations come in ascending order
            depth.append(level)
            members.append(0)
            chars.append(length)
            ends.append([])
            top.append(parent if first else None)
            top_conv.append(parent_conv)
        members[node] += 1
        at = node
        if level == size:
            ends[node].append(c)
            at = -1
    leaves = [0 if x else 1 for x in children]
    saved = [(n - 1) * length for n, length in zip(members, chars, strict=True)]
    for node in range(len(conv) - 1, -1, -1):
        if up[node] >= 0:
            leaves[up[node]] += leaves[node]
            saved[up[node]] += saved[node]
    parent_of = [conv[u] if u >= 0 else p for u, p in zip(up, top_conv, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else NOTHING for e in ends]
    made = dict(zip(NODE, (conv, depth, parent_of, members, [len(x) for x in children], leaves, saved, sha), strict=True))
    return pd.DataFrame(made | {"top": pd.Series(top, dtype=object)})


# -- all tries


def _ends(members: DataFrame) -> DataFrame:
    """key and ends_sha256 of members (key, conv_id): ids are streamed in order, however many a key has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, now, sha = [], [], None, None
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sha is None or key != now:
                    if sha is not None:
                        keys.append(now)
                        found.append(sha.hexdigest())
                    now, sha = key, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
        if sha is not None:
            keys.append(now)
            found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])

    return members.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key string, ends_sha256 string")


def _stretch(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Of turns (key, conv_id, depth, ...) of beginnings: key, n_convs, conv_id (the least), start and stop, the depths of their common turns."""
    levels = turns.groupBy("key", "depth").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.min("conv_id").alias("conv_id"))
    levels = scratch.table(levels, "levels")
    whole = levels.groupBy("key").agg(F.max("n").alias("n_convs"), F.min("depth").alias("start"), F.max("depth").alias("deepest"), F.min("conv_id").alias("conv_id"))
    parted = levels.join(whole.select("key", "n_convs"), "key").where("n < n_convs or low <> high").groupBy("key").agg((F.min("depth") - 1).alias("parted"))
    return whole.join(parted, "key", "left").select("key", "n_convs", "conv_id", "start", F.coalesce("parted", "deepest").alias("stop"))


def conversation_trie(turns: DataFrame, most: int = PART_TURNS) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, turn, role, text); see the module's text."""
    spark = turns.sparkSession
    scratch = Scratch(spark)
    convs, rows = rebuilt(turns, scratch)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    if root.isEmpty():
        return root.select(*(F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in NODE))
    least = root.first()["conv_id"]

    starts = rows.where("depth = 1").select("conv_id", F.col("digest").alias("key"), F.lit(ROOT).alias("parent"), F.lit(least).cast("long").alias("parent_conv"), F.lit(0).cast("long").alias("above"))
    members = scratch.table(convs.join(starts, "conv_id"), "members")
    alone, small, stretches = [], [], []
    while True:
        # key: a beginning; above: the depth of its parent
        sizes = members.groupBy("key").agg(F.count("*").alias("held"), F.sum(F.col("size") - F.col("above")).alias("below"))
        sizes = scratch.table(sizes, "sizes")
        alone.append(members.join(sizes.where("held = 1").select("key"), "key", "left_semi"))
        small.append(members.join(sizes.where((F.col("held") > 1) & (F.col("below") <= most)).select("key"), "key", "left_semi"))
        large = sizes.where((F.col("held") > 1) & (F.col("below") > most)).select("key")
        if large.isEmpty():
            break
        over = scratch.table(members.join(large, "key", "left_semi"), "over")
        hung = scratch.table(rows.join(over, "conv_id").where("depth > above").select("key", "parent", "parent_conv", "conv_id", "size", "depth", "digest", "chars"), "hung")
        spans = scratch.table(_stretch(hung, scratch).join(over.select("key", "parent", "parent_conv").distinct(), "key"), "spans")
        stretches.append((spans, hung, over))
        # beyond its common turns a beginning is parted by the next one, with which every key is new
        bound = sent_if_few(spans.select("key", F.col("conv_id").alias("least"), "stop"))
        nexts = hung.join(bound, "key").where("depth = stop + 1")
        members = scratch.table(nexts.select("conv_id", "size", F.sha2(F.concat("key", "digest"), 256).alias("key"), F.col("key").alias("parent"), F.col("least").alias("parent_conv"), F.col("stop").alias("above")), "members")

    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    alone, small = scratch.table(union(alone), "alone"), scratch.table(union(small), "small")

    # tries of parts, each about so large
    below = small.agg(F.sum(F.col("size") - F.col("above"))).first()[0] or 0
    parts = 1 + int(below // most)
    filed = rows.join(small, "conv_id").where("depth > above").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE) + ", top string"
    tries = scratch.table(filed.groupBy("part").applyInPandas(_part, kinds), "tries")

    # conversations without company: nodes by length, in blocks so that no row holds a long list
    block = 10_000
    single = alone.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - F.col("above") - 1) / block))).alias("b"))
    begin = F.col("above") + 1 + F.col("b") * block
    single = single.select("*", F.explode(F.sequence(begin, F.least(begin + (block - 1), F.col("size")))).alias("depth"))
    last = F.col("depth") == F.col("size")
    single = single.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("above") + 1, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )

    # what hangs below the split beginnings and the root, from the deepest up
    hangs = tries.where("top is not null").select(F.col("top").alias("parent"), "n_leaves", "saved_tokens")
    hangs = hangs.unionByName(alone.select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    sums = lambda rows: rows.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = []
    for spans, hung, over in reversed(stretches):
        under = spans.join(sums(hangs), "key", "left").fillna(0, ["n_children", "saved_tokens"]).withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1)))
        common = hung.join(sent_if_few(spans.select("key", "stop")), "key").where("depth <= stop").groupBy("key", "depth").agg(F.min("chars").alias("chars"))
        ended = over.join(sent_if_few(spans.select("key", "stop")), "key").where("size = stop")
        lower = Window.partitionBy("key").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bottom = F.col("depth") == F.col("stop")
        nodes = common.join(under, "key").join(_ends(ended), "key", "left").withColumn("own", F.sum(F.col("chars") * (F.col("n_convs") - 1)).over(lower))
        nodes = nodes.select(
            "key",
            "parent",
            "conv_id",
            "depth",
            F.when(F.col("depth") == F.col("start"), F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.when(bottom, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("saved_tokens") + F.col("own")).cast("long").alias("saved_tokens"),
            F.when(bottom, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
            (F.col("depth") == F.col("start")).alias("is_top"),
        )
        nodes = scratch.table(nodes, "upper")
        upper.append(nodes.select(*NODE))
        hangs = scratch.table(hangs.unionByName(nodes.where("is_top").select("parent", "n_leaves", "saved_tokens")), "hangs")

    turnless = convs.where("size = 0").select(F.lit(ROOT).alias("key"), "conv_id")
    crown = root.withColumn("key", F.lit(ROOT)).join(sums(hangs.where(F.col("parent") == ROOT)), "key", "left")
    crown = crown.select("key", "conv_id", F.lit(0).alias("depth"), F.lit(None).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"))
    crown = crown.join(_ends(turnless), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    every = union([crown.select(*NODE), tries.select(*NODE), single, *upper])
    return every.select(*(F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in NODE))
