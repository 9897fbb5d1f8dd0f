"""The prefix trie of conversations, and sums over its subtrees.

``conversations`` are ordered by turn (null first; rows of one turn by the MD5 of
role and text, so equal rows in any order) and rebuilt: the first h turns of
conversation c - c % 100, then c's own after its first h. Positions and prefix keys
are running sums over a range-partitioned order, so a conversation of any length
spans many tasks: a prefix's key is the sum of the digests of (position, role,
text) of its turns, four sums of 32-bit numbers. A node is named by its smallest
member and its depth.

Sums over subtrees come from a centroid decomposition of the parent edges. The
centroid of a component is its deepest node with half of the component's nodes or
more below it (itself included); the nodes with so many are the centroid's path to
the component's top. Cutting there leaves the parts below the centroid's children
and the part above. The total of everything from the centroid downward is added to
each node of the path, and the parts go on by themselves: a component is halved
each time, so a forest of any shape, chains too, takes log2(nodes) rounds. Rounds
are joins and aggregates as long as a component has more than ``TASK_NODES`` nodes;
tasks take the smaller ones on by the same steps over arrays, many components at a
time. Which part a node belongs to is looked up in the table of paths (conversation,
depth, node), never by walking edges.

Null conv_ids name no conversation: their rows are left out. Null roles and texts
are empty. Repeated rows are turns of their own. An empty table has no node, not
even a root. Conversations without turns end at the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pieces, stored
from rankloom.operators.sequence import running_totals

#: Components of so many nodes are taken on within a task.
TASK_NODES = 4096
#: Nodes of the components that one task takes on, about.
BUCKET_NODES = 1 << 16
#: Conversation ids that a row of an end list holds.
LISTED = 1000
KEY = ["k0", "k1", "k2", "k3"]


def _shared(conv: Column) -> Column:
    """How many turns a conversation has from its hundred's first one."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv, p, x, n): each turn's position from 1, digest, and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    narrow = turns.filter("conv is not null").select(
        "conv", "turn", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))).alias("x"),
        F.char_length("text").cast("long").alias("n"))
    placed = running_totals(narrow, ["conv"], ["turn", "x"], index_name="p", start=1)
    return stored(placed.select("conv", "p", "x", "n"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, x, n) of all rebuilt turns, and (conv, length) of all
    rebuilt conversations."""
    own = turns.groupBy("conv").agg(F.max("p").alias("own")).withColumn("h", _shared(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % 100)
    base = own.filter("conv = base").select("base", F.col("own").alias("there"))
    convs = own.join(base, "base", "left").withColumn("first", F.least("h", F.coalesce("there", F.lit(0)))).select(
        "conv", "base", "h", "first", (F.col("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = stored(convs, "rebuilt")
    head = turns.filter("conv % 100 = 0 and p < 6").withColumnRenamed("conv", "base").join(convs.select("conv", "base", "h"), "base") \
        .filter("p <= h").select("conv", F.col("p").alias("depth"), "x", "n")
    tail = turns.filter(F.col("p") > _shared(F.col("conv"))).join(convs.select("conv", "h", "first"), "conv") \
        .select("conv", (F.col("p") - F.col("h") + F.col("first")).alias("depth"), "x", "n")
    return head.unionByName(tail), convs.select("conv", "length")


def paths_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, n): a row for each prefix of each conversation,
    from depth 0, with the smallest members of its node and of the node above."""
    d = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("x")).cast("binary"))
    values = {f"x{i}": F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    keyed = running_totals(turns, ["conv"], ["depth"], values, index_name="at") \
        .select("conv", "depth", "n", *[F.col(f"run_x{i}").alias(f"k{i}") for i in range(4)])
    keyed = stored(keyed, "prefixes")
    names = keyed.groupBy("depth", *KEY).agg(F.min("conv").alias("node"))
    named = keyed.join(names, ["depth", *KEY]).select("conv", "depth", "node", "n")
    root = convs.agg(F.min("conv")).first()[0]
    named = stored(named.unionByName(convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"),
                                                  F.lit(0).cast("long").alias("n"))), "named")
    above = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    return stored(named.join(above, ["conv", "depth"], "left"), "paths")


def nodes_of(paths: DataFrame) -> DataFrame:
    """(node, depth, parent, n_convs, n_children, size, leaf, saved): one row a
    node; size is the number of nodes of its subtree. A conversation names the
    lower end of its own path, so the nodes that it names count for all above."""
    owners = paths.filter("conv = node").groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("end"))
    counted = paths.join(owners, "conv", "left").withColumn("below", F.coalesce(F.col("end") - F.greatest("depth", "top") + 1, F.lit(0)))
    nodes = counted.groupBy("node", "depth").agg(F.min("parent").alias("parent"), F.count("*").alias("n_convs"),
                                                 F.max("n").alias("n"), F.sum("below").alias("size"))
    nodes = stored(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, ["node", "depth"], "left").select(
        "node", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "size",
        F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))


def split(forest: DataFrame, paths: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The forest with its components cut until none has more than ``task_nodes``
    nodes: (node, depth, parent, size, top, top_depth, leaf, saved, leaves_above,
    saved_above); the last two are what the cuts added to a node."""
    steps = paths.select(F.col("conv").alias("node"), F.col("depth").alias("c_depth"), F.col("node").alias("step"), F.col("parent").alias("step_parent"))
    comp = ["top", "top_depth"]
    live, closed = forest, []
    while True:
        weight = live.groupBy(*comp).agg(F.max("size").alias("w")).filter(F.col("w") > task_nodes)
        centroid = live.join(weight, comp).filter("2 * size >= w").groupBy(*comp).agg(
            F.max("w").alias("w"), F.max_by(F.struct("node", "depth", "size"), "depth").alias("c"))
        centroid = stored(centroid.select(*comp, "w", F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_at"), F.col("c.size").alias("c_size")), "centroids")
        if centroid.isEmpty():
            return _union([*closed, live])
        at = live.join(centroid, comp, "left").withColumn("c_depth", F.when(F.col("depth") > F.col("c_at"), F.col("c_at") + 1))
        at = at.join(steps, ["node", "c_depth"], "left")
        is_c = F.coalesce((F.col("node") == F.col("c_node")) & (F.col("depth") == F.col("c_at")), F.lit(False))
        under = F.coalesce((F.col("depth") > F.col("c_at")) & (F.col("step_parent") == F.col("c_node")), F.lit(False))
        at = stored(at.withColumn("is_c", is_c).withColumn("under", under).drop("step_parent"), "cut")
        total = at.filter("is_c or under").groupBy(*comp).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
        at = at.join(total, comp, "left")
        on_path = F.coalesce(~F.col("under") & (2 * F.col("size") >= F.col("w")), F.lit(False))
        added = {c: F.when(F.col("is_c"), F.col(t) - F.col(v)).when(on_path, F.col(t)).otherwise(0)
                 for c, t, v in (("leaves_above", "t_leaf", "leaf"), ("saved_above", "t_saved", "saved"))}
        new_top = {"top": F.when(F.col("is_c"), F.col("node")).when(F.col("under"), F.col("step")).otherwise(F.col("top")),
                   "top_depth": F.when(F.col("is_c"), F.col("depth")).when(F.col("under"), F.col("c_at") + 1).otherwise(F.col("top_depth"))}
        size = F.when(F.col("is_c"), 1).when(on_path, F.col("size") - F.col("c_size")).otherwise(F.col("size")).cast("long")
        cut = stored(at.select("node", "depth", "parent", size.alias("size"), *[v.alias(k) for k, v in new_top.items()], "leaf", "saved",
                               *[(F.col(k) + v).alias(k) for k, v in added.items()], F.col("w").isNotNull().alias("live")), "split")
        closed.append(cut.filter("not live").drop("live"))
        live = cut.filter("live").drop("live")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _parents(node, depth, parent, is_top) -> np.ndarray:
    """Row of each node's parent; its own row at a component's top."""
    names, code = np.unique(np.concatenate([node, parent]), return_inverse=True)
    key = depth * len(names) + code[:len(node)]
    order = np.argsort(key)
    want = (depth - 1) * len(names) + code[len(node):]
    at = order[np.minimum(np.searchsorted(key[order], want), len(order) - 1)]
    return np.where(is_top, np.arange(len(node)), at)


def _preorder(depth, parent, is_top, size) -> np.ndarray:
    """A number for each node so that a subtree is a range that begins with its root."""
    order = np.lexsort((parent, depth, ~is_top))
    before = np.cumsum(size[order]) - size[order]
    tops, above = is_top[order], parent[order]
    new = ~tops  # the tops come first and count from 0 together; then siblings do
    new[1:] &= tops[:-1] | (above[1:] != above[:-1])
    new[:1] = True
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    place = np.empty(len(order), np.int64)
    place[order] = before - before[start]
    rest = order[~is_top[order]]
    for level in np.split(rest, np.flatnonzero(np.diff(depth[rest])) + 1):
        place[level] += place[parent[level]] + 1
    return place


def _decomposed(node, depth, parent, size, top, top_depth, values, above) -> np.ndarray:
    """Subtree sums of ``values`` (columns) within components, plus ``above``."""
    is_top = (node == top) & (depth == top_depth)
    parent = _parents(node, depth, parent, is_top)
    place = _preorder(depth, parent, is_top, size)
    whole, size, out = size, size.copy(), above + values
    # the component of a node is the row of its top, found down the preorder
    by_place = np.argsort(place)
    comp = np.empty(len(node), np.int64)
    comp[by_place] = by_place[np.maximum.accumulate(np.where(is_top[by_place], np.arange(len(node)), 0))]
    left = np.arange(len(node))
    while True:
        left = left[size[comp[left]] > 1]
        if not len(left):
            return out
        left = left[np.lexsort((place[left], comp[left]))]
        first = np.flatnonzero(np.concatenate(([True], comp[left][1:] != comp[left][:-1])))
        n = np.diff(np.append(first, len(left)))
        heavy = 2 * size[left] >= np.repeat(size[left[first]], n)
        c = left[np.maximum.reduceat(np.where(heavy, np.arange(len(left)), 0), first)]
        c_of = np.repeat(c, n)
        below = (place[left] >= place[c_of]) & (place[left] < place[c_of] + whole[c_of])
        total = np.add.reduceat(np.where(below[:, None], values[left], 0), first)
        path = heavy & ~below
        out[left[path]] += np.repeat(total, n, axis=0)[path]
        size[left[path]] -= size[c_of[path]]
        out[c] += total - values[c]
        size[c] = 1
        comp[c] = c
        at_child = below & (parent[left] == c_of) & (left != c_of)
        nearest = left[np.maximum.accumulate(np.where(at_child, np.arange(len(left)), 0))]
        down = below & (left != c_of)
        comp[left[down]] = nearest[down]


def rollup(forest: DataFrame, paths: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, depth, n_leaves, saved_tokens): sums of leaf and saved over each
    node's subtree. ``forest`` is what ``nodes_of`` gives."""
    n = forest.count()
    root = forest.filter("depth = 0").select("node", "depth").first()
    zero = F.lit(0).cast("long")
    whole = forest.select("node", "depth", "parent", "size", F.lit(root["node"] if root else None).cast("long").alias("top"), zero.alias("top_depth"),
                          "leaf", "saved", zero.alias("leaves_above"), zero.alias("saved_above"))
    # written, so that the first component's name is a column and not a constant in joins
    parts = split(stored(whole, "forest"), paths, task_nodes)
    buckets = pieces(n, BUCKET_NODES)

    def sums(t: pa.Table) -> pa.Table:
        a = {c: t.column(c).to_numpy() for c in ("node", "depth", "size", "top", "top_depth", "leaf", "saved", "leaves_above", "saved_above")}
        parent = pa.compute.fill_null(t.column("parent"), -1).to_numpy()
        out = _decomposed(a["node"], a["depth"], parent, a["size"], a["top"], a["top_depth"],
                          np.stack([a["leaf"], a["saved"]], 1), np.stack([a["leaves_above"], a["saved_above"]], 1))
        return pa.table({"node": a["node"], "depth": a["depth"], "n_leaves": out[:, 0], "saved_tokens": out[:, 1]})

    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("top", "top_depth"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(sums, "node long, depth long, n_leaves long, saved_tokens long")


def end_lists(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of the nodes where conversations end: the hash
    of their ids in order, joined by commas. Sorted ranges are joined into rows of
    ``LISTED`` ids first; what one task hashes, it streams."""
    ends = paths.join(convs.select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select("node", "depth", "conv")

    def joined(batches):
        for b in batches:
            node, depth, conv = (b.column(c).to_numpy() for c in ("node", "depth", "conv"))
            if not len(node):
                continue
            new = np.concatenate(([True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])))
            run = np.arange(len(node)) - np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
            first = np.flatnonzero(run % LISTED == 0)
            texts = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(first, np.append(first[1:], len(node)))]
            yield pa.record_batch([pa.array(node[first]), pa.array(depth[first]), pa.array(conv[first]), pa.array(texts)], names=["node", "depth", "conv", "ids"])

    def hashed(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for node, depth, ids in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if (node, depth) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (node, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield _hashes(out)
        if key is not None:
            yield _hashes([(*key, sha.hexdigest())])

    lists = ends.repartitionByRange("node", "depth", "conv").sortWithinPartitions("node", "depth", "conv") \
        .mapInArrow(joined, "node long, depth long, conv long, ids string")
    return lists.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv").select("node", "depth", "ids") \
        .mapInArrow(hashed, "node long, depth long, ends_sha256 string")


def _hashes(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.string())], names=["node", "depth", "ends_sha256"])


def trie(conversations: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """One row a node of the trie, with its sums."""
    turns, convs = rebuilt(ordered(conversations))
    paths = paths_of(turns, convs)
    nodes = stored(nodes_of(paths), "trie")
    sums = rollup(nodes, paths, task_nodes)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, ["node", "depth"]).join(end_lists(paths, convs), ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
