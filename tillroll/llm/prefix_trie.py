"""A trie of conversations that share their first turns, measured by an Euler tour.

1. Each conversation becomes a path: one row per turn, with a key that stands for all turns up to it.
   The key comes from running sums over hashes of (depth, role, text), so a conversation of any length
   is cut into chunks and no task goes through all of it.
2. Rows with equal keys are one node; its name is its smallest conversation.
3. Each node has an arc that enters and one that leaves it. The arc after each is known from children
   and siblings alone, which makes the tour a linked list.
4. The list is ranked: one arc in sixteen is a ruler, all others jump by doubling until they stand on a
   ruler, and the rulers are a list of a sixteenth of the length, ranked in the same way.
5. Ranks are positions. With running sums over them, what a subtree holds is the difference between the
   positions where its top is entered and left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.prefix import ordinal
from tillroll.llm.common import saved

SUMS = ("s1", "s2", "s3", "s4")
LISTED = 1 << 14  # a list of up to this many arcs is ranked by one task
GAP = 16  # one arc in so many is a ruler


def _pieces(digest: Column) -> list[Column]:
    """A hex digest of 128 bits as four numbers of 32 bits."""
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_md5, n_bytes: the turns in order; equal ones go by their md5."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.col("turn").isNotNull().alias("has_turn"),
        # the length of the role says where it ends
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_md5"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    chunks = [F.shiftright("turn", 20), F.shiftright("turn", 10)]
    placed = ordinal(turns, ["conv_id"], chunks, [F.col("turn"), F.col("has_turn"), F.col("turn_md5")], "place")
    return placed.select("conv_id", F.col("place").cast("long").alias("place"), "turn_md5", "n_bytes")


def shared_head(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five: 0 to 8, by the crc32 of its id."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("long")


def rebuild(turns: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, depth, turn_md5, n_bytes) and (conv_id, head, shift, length).

    A conversation takes its first `head` turns from conversation c - c % group (at most eight of them,
    so a head is small), and then its own after as many as it was to take.
    """
    lengths = saved(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-lengths")
    named = lengths.select(
        "conv_id", "own", shared_head(F.col("conv_id")).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("source"),
    )
    sources = lengths.select(F.col("conv_id").alias("source"), F.col("own").alias("there"))
    head = F.least("h", F.coalesce("there", F.lit(0))).cast("long")
    convs = named.join(sources, "source", "left").withColumn("head", head).select(
        "conv_id", "source", "h", "head",
        (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"),
    )
    convs = saved(convs, "trie-convs")
    firsts = turns.where("place <= 8").withColumnRenamed("conv_id", "source")
    heads = firsts.join(convs.where("head > 0").select("source", "conv_id", "head", "length"), "source").where("place <= head")
    heads = heads.select("conv_id", F.col("place").alias("depth"), "turn_md5", "n_bytes", "length")
    tails = turns.where(F.col("place") > shared_head(F.col("conv_id"))).join(
        convs.select("conv_id", "h", "head", "length"), "conv_id"
    )
    depth = (F.col("place") - F.col("h") + F.col("head")).alias("depth")
    tails = tails.select("conv_id", depth, "turn_md5", "n_bytes", "length")
    return saved(heads.unionByName(tails), "trie-rebuilt"), convs.select("conv_id", "length")


def paths(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, n_bytes, length: a key stands for all turns up to its own.

    Two different starts have one key only if 128 bits of hashes agree, as with any digest.
    """
    own = F.md5(F.concat(F.col("depth").cast("string"), F.lit(","), F.col("turn_md5")))
    cut = rebuilt.withColumns(dict(zip(("f1", "f2", "f3", "f4"), _pieces(own))))
    chunks = [F.shiftright("depth", 20), F.shiftright("depth", 10)]
    running = dict(zip(SUMS, ("f1", "f2", "f3", "f4")))
    summed = ordinal(cut.drop("turn_md5"), ["conv_id"], chunks, [F.col("depth")], "place", running=running)
    before = [F.col(s) - F.col(f) for s, f in running.items()]
    return summed.select(
        "conv_id", "depth", _key(F.col("depth"), [F.col(s) for s in SUMS]).alias("key"),
        _key(F.col("depth") - 1, before).alias("parent"), "n_bytes", "length",
    )


def _nodes(path: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: id, depth, key, parent, n_bytes, conv_id, n_convs, ends_sha256.

    Counting is reduced before the shuffle, so the first turn that all begin with is one row per task.
    The conversations that end in a node make one text, as its hash is asked for; nothing else of a node
    is brought together.
    """
    zero = F.lit(0).cast("long")
    root = _key(zero, [zero] * 4)
    tops = convs.select(
        "conv_id", zero.alias("depth"), root.alias("key"), F.lit(None).cast("binary").alias("parent"),
        zero.alias("n_bytes"), "length",
    )
    rows = saved(path.unionByName(tops), "trie-paths")
    nodes = rows.groupBy("key", "parent", "depth", "n_bytes").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
    )
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    ends = rows.where("depth = length").groupBy("key").agg(F.array_join(ids, ",").alias("ends"))
    none = F.coalesce("ends", F.lit(""))
    done = nodes.join(ends, "key", "left").withColumn("ends_sha256", F.sha2(none.cast("binary"), 256)).drop("ends")
    return saved(done.select(F.monotonically_increasing_id().alias("id"), "*"), "trie-nodes")


def _family(nodes: DataFrame, n_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(id, parent_id, parent_conv, sibling) of all but the root, and (id, n_children, first_child).

    The children of a node are ordered by (bucket, id). Any order gives a tour, and this one lets the
    children of a hot node be linked bucket by bucket, and the buckets among each other; with the root
    of the number of nodes as buckets, neither is more than that many rows in one task.
    """
    above = nodes.select(F.col("key").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv"))
    linked = saved(nodes.where("parent IS NOT NULL").select("id", "parent").join(above, "parent").drop("parent"), "trie-links")
    linked = linked.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(math.isqrt(n_nodes) + 1)))
    buckets = linked.groupBy("parent_id", "bucket").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    after = buckets.withColumn("following", F.lead("first").over(Window.partitionBy("parent_id").orderBy("bucket")))
    inside = F.lead("id").over(Window.partitionBy("parent_id", "bucket").orderBy("id"))
    siblings = linked.withColumn("inside", inside).join(after.drop("first", "n"), ["parent_id", "bucket"])
    siblings = siblings.select("id", "parent_id", "parent_conv", F.coalesce("inside", "following").alias("sibling"))
    parents = buckets.groupBy(F.col("parent_id").alias("id")).agg(
        F.sum("n").alias("n_children"), F.min_by("first", "bucket").alias("first_child")
    )
    return saved(siblings, "trie-siblings"), saved(parents, "trie-parents")


def euler_tour(nodes: DataFrame, siblings: DataFrame, parents: DataFrame) -> DataFrame:
    """item, nxt: arc 2 * id enters a node and arc 2 * id + 1 leaves it; nothing follows leaving the root."""
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    down = nodes.select("id").join(parents, "id", "left").select(
        enter("id").alias("item"), F.coalesce(enter("first_child"), leave("id")).alias("nxt")
    )
    up = nodes.select("id").join(siblings, "id", "left").select(
        leave("id").alias("item"), F.coalesce(enter("sibling"), leave("parent_id")).alias("nxt")
    )
    return saved(down.unionByName(up), "trie-arcs")


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """Ranks of a short list: every item jumps twice as far each time."""
    items = frame["item"].to_numpy()
    order = np.argsort(items)
    last = frame["nxt"].isna().to_numpy()
    found = order[np.searchsorted(items, frame["nxt"].fillna(items[0]).to_numpy("int64"), sorter=order)]
    # behind the last item stands one more, which is 0 from the end
    end = len(items)
    nxt = np.append(np.where(last, end, found), end)
    gap = np.append(frame["gap"].to_numpy(), 0)
    while (nxt != end).any():
        gap, nxt = gap + gap[nxt], nxt[nxt]
    return pd.DataFrame({"item": items, "ahead": gap[:end]})


def rank_list(links: DataFrame, listed: int = LISTED, level: int = 0) -> DataFrame:
    """item, nxt, gap -> item, ahead: how far each item is from the end of its list.

    nxt is null at the end; gap is the distance to nxt, or to the end where nxt is null. Each item is the nxt of at most one other, so no
    join has a hot key. What one task gets is at most `listed` items, at every size of the list.
    """
    if links.count() <= listed:
        return links.groupBy().applyInPandas(_walk, "item long, ahead long")

    def ruler(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(GAP)) == 0

    jumps = saved(links.select("item", "nxt", "gap", (F.col("nxt").isNull() | ruler("nxt")).alias("done")), "trie-jumps")
    while not (open_ := jumps.where("NOT done")).isEmpty():
        there = jumps.select(
            F.col("item").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("gap").alias("gap2"), F.col("done").alias("done2")
        )
        moved = open_.drop("done").join(there, "nxt").select(
            "item", F.col("nxt2").alias("nxt"), (F.col("gap") + F.col("gap2")).alias("gap"), F.col("done2").alias("done")
        )
        jumps = saved(jumps.where("done").unionByName(moved), "trie-jumps")
    ranked = rank_list(jumps.where(ruler("item")).select("item", "nxt", "gap"), listed, level + 1)
    ends = saved(ranked.select(F.col("item").alias("nxt"), F.col("ahead").alias("beyond")), "trie-rulers")
    total = F.col("gap") + F.coalesce("beyond", F.lit(0))
    return jumps.join(ends, "nxt", "left").select("item", total.alias("ahead"))


def prefix_trie(conversations: DataFrame, listed: int = LISTED) -> DataFrame:
    """One row per node, with enter_at and leave_at, its positions in the tour, from 0.

    Columns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    `conversations` has conv_id, turn, role and text; other columns don't matter. A null turn comes
    first, equal turns are ordered by the md5 of role and text, and a repeated row is one more turn. Null roles
    and texts are empty. Rows without conv_id belong to no conversation and are left out. Without
    conversations there is no node.
    """
    rebuilt, convs = rebuild(saved(numbered_turns(conversations), "trie-turns"))
    nodes = _nodes(paths(rebuilt), convs)
    n_nodes = nodes.count()
    siblings, parents = _family(nodes, n_nodes)
    arcs = euler_tour(nodes, siblings, parents)
    ranks = rank_list(arcs.withColumn("gap", F.col("nxt").isNotNull().cast("long")), listed)

    known = nodes.join(parents.drop("first_child"), "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = known.select(
        (2 * F.col("id")).alias("item"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving"),
    )
    tour = ranks.withColumn("at", F.lit(2 * n_nodes - 1) - F.col("ahead")).drop("ahead").join(own, "item", "left")
    tour = saved(tour.fillna(0, ["leaf", "saving"]), "trie-tour")
    summed = ordinal(
        tour, [], [F.shiftright("at", 22), F.shiftright("at", 11)], [F.col("at")], "_place",
        running={"leaves": "leaf", "savings": "saving"},
    )
    # sums up to leaving, without those up to entering, but with the node's own
    entered = F.col("item") % 2 == 0
    inside = [
        F.sum(F.when(entered, F.col(own) - F.col(total)).otherwise(F.col(total))).alias(name)
        for name, own, total in (("n_leaves", "leaf", "leaves"), ("saved_tokens", "saving", "savings"))
    ]
    subtree = summed.groupBy(F.shiftright("item", 1).alias("id")).agg(
        *inside, F.min("at").alias("enter_at"), F.max("at").alias("leave_at")
    )
    named = known.join(siblings.select("id", F.col("parent_conv").alias("parent_conv_id")), "id", "left").join(subtree, "id")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
        "enter_at", "leave_at",
    )
