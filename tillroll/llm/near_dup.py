"""Near duplicates by a chosen-path set similarity join.

Each text is the set of its distinct word shingles. In a tree, a document goes down from the root along
the path of tokens that it chooses itself: at each node, the shingle with the smallest hash under the
hash function of the path so far. Similar sets choose the same token with the probability of their
similarity. Nodes that are small enough are compared exhaustively on full sets, larger ones are branched
once more, and independent trees are repeated until a link is missed with negligible probability: with a
similarity of 0.85, 16 trees and 3 levels, that is 0.15^16 (1e-13) if the node stops at the first level
and 2e-7 at worst.

What is still large at the last level are mostly copies with small changes. There a few documents are
first compared with all others, which joins most of the node, and then all blocks of documents that may
still have links between different components are compared. No bound drops a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import rolling
from tillroll.llm.common import release, saved

MASK = (1 << 64) - 1
WORDS_AT_ONCE = 200_000


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of the whole sequence if it is shorter."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the blanks \x20, \x09-\x0D
    if not found:
        return np.zeros(0, np.uint64)
    parts = []
    for at in range(0, max(len(found) - words + 1, 1), WORDS_AT_ONCE):
        some = found[at : at + WORDS_AT_ONCE + words - 1]
        length = np.fromiter(map(len, some), np.int64, len(some))
        end = np.cumsum(length + 1) - 1
        sums = rolling.prefix_sums(np.frombuffer(b" ".join(some), np.uint8))
        size = min(words, len(some))
        parts.append(rolling.ranges(sums, (end - length)[: len(some) - size + 1], end[size - 1 :]))
    return np.unique(np.concatenate(parts))


def chosen_paths(tokens: np.ndarray, trees: int, levels: int) -> list[int]:
    """The nodes of a set in each tree, level by level, as signed 64-bit numbers."""
    out = []
    for tree in range(trees):
        path = _mix(tree + 1)
        for _ in range(levels):
            chosen = int(tokens[np.argmin(tokens * np.uint64(path | 1))])
            path = _mix((path * 0x9E3779B97F4A7C15 + chosen) & MASK)
            out.append(path - (1 << 64) if path >> 63 else path)
    return out


def document_sets(docs: DataFrame, words: int, trees: int, levels: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if it is empty) and paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, paths = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                paths.append(chosen_paths(s, trees, levels) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(paths, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "paths"],
            )

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
              T.StructField("set_key", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType()))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, T.StructType(fields))


def tree_nodes(sets: DataFrame, trees: int, levels: int, leaf: int) -> DataFrame:
    """node, tree, rep and n: members of nodes of two or more, at the first level with at most `leaf`."""
    keys = [f"k{i}" for i in range(levels)]
    level = sets.select("rep", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "rep", "tree", *(F.element_at("paths", F.col("tree") * levels + i + 1).alias(k) for i, k in enumerate(keys))
    )
    out = None
    for i, key in enumerate(keys):
        # stored, so that the join with a node that very many documents are in can be split
        counts = saved(level.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), f"counts-{i + 1}")
        shared = saved(level.join(counts, key), f"level-{i + 1}")
        release(sets.sparkSession)
        small = shared if i == levels - 1 else shared.where(F.col("n") <= leaf)
        small = small.select(F.col(key).alias("node"), "tree", "rep", "n")
        out = small if out is None else out.unionByName(small)
        level = shared.where(F.col("n") > leaf).drop("n")
    return out


def compare(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (by position) that join what is similar enough; pairs already joined are not looked at."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(tokens, kind="stable")
    owners, start = owner[order], np.searchsorted(tokens[order], np.arange(len(flat) + 1))
    offset = np.concatenate([[0], np.cumsum(size)])
    part = np.unique(np.array(labels), return_inverse=True)[1]
    links, queue, done = [], [0], np.zeros(len(sets), bool)
    while not done.all():
        u = queue.pop() if queue else int(np.argmin(done))
        if done[u]:
            continue
        done[u] = True
        if (part == part[u]).all():
            break
        own = tokens[offset[u] : offset[u + 1]]
        n = start[own + 1] - start[own]
        where = np.arange(n.sum()) + np.repeat(start[own] - (np.cumsum(n) - n), n)
        common = np.bincount(owners[where], minlength=len(sets))
        similar = (100 * common >= percent * (size[u] + size - common)) & (part != part[u])
        for v in np.flatnonzero(similar):
            if part[v] != part[u]:
                links.append((u, int(v)))
                part[part == part[v]] = part[u]
                queue.append(int(v))
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with the same node and chunk, from sorted rows."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("node", "chunk", "rep", "label", "text")]
        for row in zip(*columns):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def find_links(groups: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of the same group. `groups` has node, chunk, rep and label.

    Groups with the same members are compared once.
    """
    signature = groups.groupBy("node", "chunk").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("rep").alias("low"), F.max("rep").alias("high"),
    )
    chosen = signature.where("n > 1").groupBy("n", "x", "y", "low", "high").agg(
        F.min(F.struct("node", "chunk")).alias("g")
    )
    members = groups.join(chosen.select("g.node", "g.chunk"), ["node", "chunk"])
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            sets = [shingles(r[4], words) for r in group]
            some = [i for i, s in enumerate(sets) if len(s)]
            if len(some) < 2:
                continue
            group, sets = [group[i] for i in some], [sets[i] for i in some]
            links = compare(sets, [r[3] for r in group], percent)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[u][2] for u, _ in links], pa.int64()),
                     pa.array([group[v][2] for _, v in links], pa.int64())],
                    ["a", "b"],
                )

    dealt = rows.select("node", "chunk", "rep", "label", "text").repartition("node", "chunk")
    return dealt.sortWithinPartitions("node", "chunk").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """member and root (the smallest member) of each connected component of the links.

    Alternates two steps until only stars are left: each node tells its larger neighbours, then its
    smaller ones, the smallest it knows. The number of rounds grows with the logarithm of the size.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = saved(links.select(a, b).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        release(links.sparkSession)
        twice = edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not twice and not edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            return edges.select(F.col("a").alias("member"), F.col("b").alias("root"))


def _labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    joined = nodes.join(roots, nodes.rep == roots.member, "left")
    return joined.select(*nodes.columns, F.coalesce("root", "rep").alias("label"))


def _with_pivots(giant: DataFrame, block: int, pivots: int) -> DataFrame:
    """Chunks of each large node, each with the node's first documents beside its own."""
    chunks = F.ceil(F.col("n") / block).cast("int")
    rows = giant.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("long"))
    first = giant.withColumn("nr", F.row_number().over(Window.partitionBy("node").orderBy("rep"))).where(
        F.col("nr") <= pivots
    )
    everywhere = first.select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)).alias("chunk"))
    return rows.select("node", "rep", "chunk").unionByName(everywhere.select("node", "rep", "chunk")).distinct()


def _block_pairs(giant: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of each large node that may hold links between different labels.

    A label with many members has blocks of its own, which need not meet each other; all others share
    mixed blocks.
    """
    sizes = giant.groupBy("node", "label").agg(F.count("*").alias("c"))
    large = sizes.where(F.col("c") >= block)
    tagged = giant.join(large, ["node", "label"], "left").withColumn(
        "own", F.when(F.col("c").isNotNull(), F.col("label"))
    )
    pooled = tagged.where("own IS NULL").groupBy("node").agg(F.count("*").alias("pool"))
    tagged = tagged.join(pooled, "node", "left").withColumn(
        "nr", F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("c", "pool") / block))
    )
    members = saved(tagged.select("node", "rep", "label", "own", F.xxhash64("own", "nr").alias("block")), "blocks")
    blocks = members.select("node", "own", "block").distinct()
    left, right = blocks.toDF("node", "own", "block"), blocks.toDF("node", "own2", "block2")
    pairs = left.join(right, "node").where(
        "block <= block2 AND (own IS NULL OR own2 IS NULL OR own <> own2)"
    )
    chunk = F.xxhash64("block", "block2").alias("chunk")
    sides = pairs.select("node", "block", chunk).union(pairs.select("node", "block2", chunk)).toDF("node", "block", "chunk")
    return members.join(sides.distinct(), ["node", "block"]).select("node", "chunk", "rep", "label")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    words: int = 5,
    trees: int = 16,
    levels: int = 3,
    leaf: int = 64,
    block: int = 512,
    pivots: int = 4,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs`.

    Texts with 100 * intersection >= percent * union of their shingle sets are linked; links are found
    by the trees and always confirmed on full sets. component_id is the smallest doc_id that can be
    reached, kept is whether that is the row's own. A text without words, or null, is linked with
    nothing. A doc_id that comes with several texts is one node of
    the graph where it represents a class, so their links add up. A row without doc_id has no
    component and is kept. An empty table gives no rows; other columns don't matter.

    Equal sets are one class, whatever their number, and only its first document goes on. Two trees are
    compared first; nodes of the others whose members are already joined are dropped.
    """
    spark = docs.sparkSession
    rows = saved(document_sets(docs, words, trees, levels), "sets")
    usable = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = saved(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes, "set_key").where("doc_id = rep").dropDuplicates(["set_key"]).select("rep", "paths")
    nodes = tree_nodes(saved(reps, "representatives"), trees, levels, leaf)
    release(spark)

    own = F.col("rep").alias("label")
    giant = nodes.where(F.col("n") > leaf)
    first = nodes.where((F.col("n") <= leaf) & (F.col("tree") < 2)).select("node", F.lit(0).cast("long").alias("chunk"), "rep")
    start = first.unionByName(_with_pivots(giant, block, pivots).select("node", "chunk", "rep"))
    links = saved(find_links(start.select("*", own), docs, words, percent), "first-links")
    release(spark)
    roots = components(links)

    later = nodes.where((F.col("n") > leaf) | (F.col("tree") >= 2))
    labelled = _labelled(later, roots)
    mixed = labelled.groupBy("node").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    left = saved(labelled.join(mixed.select("node"), "node"), "mixed-nodes")
    rest = left.where(F.col("n") <= leaf).select("node", F.lit(0).cast("long").alias("chunk"), "rep", "label")
    groups = rest.unionByName(_block_pairs(left.where(F.col("n") > leaf), block))
    more = saved(find_links(groups, docs, words, percent), "more-links")
    release(spark)
    known = roots.select(F.col("member").alias("a"), F.col("root").alias("b"))
    roots = components(more.unionByName(known))

    of_class = classes.join(roots, classes.rep == roots.member, "left").select(
        "set_key", F.coalesce("root", "rep").alias("component_id")
    )
    found = rows.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return found.select("doc_id", "n_shingles", component).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
