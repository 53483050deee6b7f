"""Parent links as whole hierarchies: path, depth, root, descendants, and the chains that never end.

Sizes of subtrees are added up from the leaves; each node then hands its children ranges of preorder
numbers by prefix sums over their sizes. ``lft`` and ``rgt`` are these nested-set ranges: d lies below a
when ``a.lft < d.lft <= a.rgt``. What the upward pass never reaches lies on a cycle.

Two plans give the same rows. Trees of up to ``block_rows`` rows are sent whole to one task (one
shuffle, few bytes a row) and worked off level by level for many trees at once in numpy. Larger trees
never meet in one task: their sizes, ranges and paths come from pointer doubling, whose rounds grow
with the logarithm of the depth.

Defined results: rows without a tree or node id are not nodes; of a node's rows the latest by
``loaded_at`` counts (null is earliest), of equally late ones that with the largest parent; a parent
that is null or not a node of the tree makes a root; a node that is its own parent is a cycle. Nodes on
or below a cycle have a ``cycle_id``, the smallest node id on it, and null elsewhere. Trees without
rows give none, further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtree.plans.prefix import grouped_prefix_sum
from voxtree.session import materialize, release

#: Rows of a tree up to which one task holds it: about 100 MB of arrays.
BLOCK_ROWS = 1_000_000
_CHUNK_ROWS, _PATH_INTS = 200_000, 2_000_000
_FIELDS = (
    ("neuron_id", "bigint", pa.int64()), ("node_id", "int", pa.int32()), ("parent_id", "int", pa.int32()),
    ("root_id", "int", pa.int32()), ("depth", "int", pa.int32()), ("lft", "bigint", pa.int64()), ("rgt", "bigint", pa.int64()),
    ("n_descendants", "bigint", pa.int64()), ("cycle_id", "int", pa.int32()),
)


def _group_add(target: np.ndarray, at: np.ndarray, what: np.ndarray) -> np.ndarray:
    """target[at] += what; the distinct places."""
    places, which = np.unique(at, return_inverse=True)
    target[places] += np.bincount(which, weights=what, minlength=len(places)).astype(target.dtype)
    return places


def _peel(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subtree sizes from the leaves up; which nodes are on cycles, as no pass reaches them."""
    size = np.ones(len(parent), np.int64)
    waiting = np.bincount(parent[parent >= 0], minlength=len(parent))
    front = np.flatnonzero(waiting == 0)
    while len(front):
        front = front[parent[front] >= 0]
        up = parent[front]
        places = _group_add(size, up, size[front])
        _group_add(waiting, up, np.full(len(up), -1))
        front = places[waiting[places] == 0]
    return size, waiting > 0


def _solve(tree: np.ndarray, node: np.ndarray, parent: np.ndarray) -> dict[str, np.ndarray]:
    """All results for nodes in (tree, node) order; parent: place of the parent, -1 for a root."""
    n = len(node)
    here = np.arange(n)
    size, cyclic = _peel(parent)
    # smallest id on each cycle, by doubling along the cycle
    cycle = np.where(cyclic, node.astype(np.int64), np.iinfo(np.int64).max)
    if cyclic.any():
        at = np.where(cyclic, parent, here)
        for _ in range(int(cyclic.sum()).bit_length()):
            cycle, at = np.minimum(cycle, cycle[at]), at[at]
    # where the preorder range of a node begins in that of its parent
    family = np.where(parent >= 0, n + parent, np.unique(tree, return_inverse=True)[1])
    order = np.argsort(family, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    first = np.flatnonzero(np.r_[True, family[order][1:] != family[order][:-1]]) if n else np.zeros(0, int)
    before -= np.repeat(before[first], np.diff(np.r_[first, n]))
    start = np.empty(n, np.int64)
    start[order] = before + 1
    # down the tree: sums along the chain of parents
    top = (parent < 0) | cyclic
    at, depth, lft = np.where(top, here, parent), np.where(top, 0, 1), start.copy()
    lft[top & (parent >= 0)] = 0
    carry = lft.copy()
    for _ in range(max(1, n).bit_length()):
        open_ = np.flatnonzero(~top[at])
        reach = at[open_]
        if not len(open_):
            break
        carry[open_], depth[open_], at[open_] = carry[open_] + carry[reach], depth[open_] + depth[reach], at[reach]
    carry = np.where(top, carry, carry + carry[at])
    endless = cyclic[at]
    return {"root": at, "depth": depth, "lft": carry, "size": size, "endless": endless, "cycle": cycle[at]}


def _forest(table: pa.Table, paths: bool, only_endless: bool) -> Iterator[pa.RecordBatch]:
    tree, node = table["neuron_id"].to_numpy(), table["node_id"].to_numpy()
    missing = np.iinfo(np.int64).min
    up = table["parent_id"].cast(pa.int64()).fill_null(missing).to_numpy()
    late = table["loaded_at"].fill_null(missing).to_numpy()
    order = np.lexsort((up, late, node, tree))
    tree, node, up = tree[order], node[order], up[order]
    last = np.r_[(tree[1:] != tree[:-1]) | (node[1:] != node[:-1]), True]
    tree, node, up = tree[last], node[last], up[last]
    # the place of each parent: ids are sorted within runs of one tree
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    rank = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(tree)]))
    key = (rank << 33) + node.astype(np.int64)
    valid = (up >= -(2**31)) & (up < 2**31)
    want = (rank << 33) + np.where(valid, up, 0)
    place = np.minimum(np.searchsorted(key, want), len(key) - 1)
    parent = np.where(valid & (key[place] == want), place, -1)
    r = _solve(tree, node, parent)
    keep = np.flatnonzero(r["endless"]) if only_endless else np.arange(len(node))
    sound = ~r["endless"]
    empty = ~sound[keep]
    columns = [
        pa.array(tree[keep]), pa.array(node[keep], pa.int32()), pa.array(node[parent[keep]], pa.int32(), mask=parent[keep] < 0),
        pa.array(node[r["root"]][keep], pa.int32(), mask=empty), pa.array(r["depth"][keep], pa.int32(), mask=empty), pa.array(r["lft"][keep], mask=empty),
        pa.array((r["lft"] + r["size"] - 1)[keep], mask=empty), pa.array((r["size"] - 1)[keep], mask=empty), pa.array(np.where(sound, 0, r["cycle"])[keep], pa.int32(), mask=~empty),
    ]
    names = [f[0] for f in _FIELDS]
    if not paths:
        yield pa.RecordBatch.from_arrays(columns, names)
        return
    length = np.where(sound, r["depth"] + 1, 0)[keep]
    ends = np.cumsum(length)
    begin = 0
    while begin < len(keep):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + _PATH_INTS, "right")))
        stop = ends[begin:end] - done
        values = np.empty(stop[-1] if len(stop) else 0, np.int32)
        at, back = keep[begin:end][length[begin:end] > 0], stop[length[begin:end] > 0] - 1
        while len(at):
            values[back] = node[at]
            more = parent[at] >= 0
            at, back = parent[at[more]], back[more] - 1
        offsets = pa.array(np.r_[0, stop], pa.int32(), mask=np.r_[length[begin:end] == 0, False])
        path = pa.ListArray.from_arrays(offsets, pa.array(values))
        yield pa.RecordBatch.from_arrays([c.slice(begin, end - begin) for c in columns] + [path], [*names, "path"])
        begin = end


def _whole_trees(paths: bool, only_endless: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < _CHUNK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            ids = table["neuron_id"].to_numpy()
            cut = len(ids) - int(np.argmax(np.r_[ids[::-1] != ids[-1], True]))  # rows of a tree are together; the last may go on
            if cut:
                yield from _forest(table.slice(0, cut), paths, only_endless)
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield from _forest(pa.Table.from_batches(held), paths, only_endless)

    return run


def _schema(paths: bool) -> str:
    return ", ".join(f"{n} {t}" for n, t, _ in _FIELDS) + (", path array<int>" if paths else "")


def hierarchy(nodes: DataFrame, paths: bool = False, only_endless: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """neuron_id, node_id, parent_id, root_id, depth, lft, rgt, n_descendants, cycle_id[, path].

    ``paths`` adds the ids from the root to the node; ``only_endless`` leaves only the nodes whose chain
    of parents never ends.
    """
    links = nodes.where("neuron_id is not null and node_id is not null").select(
        F.col("neuron_id").cast("bigint"), F.col("node_id").cast("int"), F.col("parent_id").cast("int"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_at")
    )
    sizes = links.groupBy("neuron_id").count()
    large = sizes.where(F.col("count") > block_rows)
    biggest = large.agg(F.max("count")).first()[0]
    small = links if biggest is None else links.join(large, "neuron_id", "left_anti")
    # a key of its own: a shuffle by the tree's id would be dropped as done after the join above, and that join may
    # become a broadcast at run time, whose rows are neither together nor in order
    whole = small.withColumn("_task", F.xxhash64("neuron_id")).repartition("_task").sortWithinPartitions("_task", "neuron_id")
    blocks = whole.mapInArrow(_whole_trees(paths, only_endless), _schema(paths))
    if biggest is None:
        return blocks
    return blocks.unionByName(_doubling(links.join(large.select("neuron_id"), "neuron_id", "left_semi"), biggest, paths, only_endless))


def _doubling(links: DataFrame, most: int, paths: bool, only_endless: bool) -> DataFrame:
    """The same rows for trees too large for one task."""
    rounds, key = math.ceil(math.log2(most)) + 1, ["neuron_id", "node_id"]
    latest = links.groupBy(*key).agg(F.max(F.struct("loaded_at", "parent_id")).alias("last")).select(*key, F.col("last.parent_id").alias("parent_id"))
    ids = latest.select("neuron_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    tree = materialize(
        latest.join(ids, ["neuron_id", "parent_id"], "left").select(*key, F.when(F.col("there"), F.col("parent_id")).alias("parent_id"))
    )

    # every node's chain: where 2^k steps lead, their number, and the smallest id met
    state = tree.select(
        *key, F.coalesce("parent_id", "node_id").alias("at"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"),
        F.col("node_id").alias("least"), F.col("parent_id").isNull().alias("done"),
    )
    for _ in range(rounds):
        ahead = state.select("neuron_id", F.col("node_id").alias("at"), F.col("at").alias("at2"), F.col("depth").alias("d2"), F.col("least").alias("l2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(ahead, ["neuron_id", "at"]).select(
            *key, F.col("at2").alias("at"), (F.col("depth") + F.col("d2")).alias("depth"), F.least("least", "l2").alias("least"), F.col("done2").alias("done")
        )
        last, state = state, materialize(state.where("done").unionByName(moved))
        release(last)
        if state.where("not done").isEmpty():
            break
    endless = state.where("not done")
    on_cycle = endless.select("neuron_id", F.col("at").alias("node_id")).distinct().join(endless.select(*key, "least"), key)
    named = endless.join(on_cycle.select("neuron_id", F.col("node_id").alias("at"), F.col("least").alias("cycle_id")), ["neuron_id", "at"]).select(*key, "cycle_id")
    null = {n: F.lit(None).cast(t).alias(n) for n, t, _ in _FIELDS}
    extra = [F.lit(None).cast("array<int>").alias("path")] if paths else []
    cyclic = tree.join(named, key).select(*[n if n in (*key, "parent_id", "cycle_id") else null[n] for n, *_ in _FIELDS], *extra)
    if only_endless:
        return cyclic

    sound = materialize(tree.join(state.where("done").select(*key, F.col("at").alias("root_id"), "depth"), key))
    # sizes upward: what lies fewer than 2^k steps below, and the ancestor exactly 2^k above
    deepest = sound.agg(F.max("depth")).first()[0] or 0
    size = sound.select(*key, F.col("parent_id").alias("up"), F.lit(1).cast("bigint").alias("size"))
    for _ in range(max(1, deepest).bit_length()):
        below = size.where("up is not null").groupBy("neuron_id", "up").agg(F.sum("size").alias("more")).withColumnRenamed("up", "node_id")
        jump = size.select("neuron_id", F.col("node_id").alias("up"), F.col("up").alias("up2"))
        grown = size.join(below, key, "left").select(*key, "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        last, size = size, materialize(grown.join(jump, ["neuron_id", "up"], "left").select(*key, F.col("up2").alias("up"), "size"))
        release(last)
    sized = sound.join(size.select(*key, "size"), key).withColumn("family", F.coalesce(F.col("parent_id").cast("bigint"), F.lit(-(2**40))))
    ranked = grouped_prefix_sum(sized, ["neuron_id", "family"], ["node_id"], "size", "before")
    # ranges downward: sums of the offsets along the chain of parents
    ranked = materialize(ranked.drop("family"))
    path = [F.array("node_id").alias("path")] if paths else []
    down = ranked.select(*key, F.col("parent_id").alias("at"), (F.col("before") + 1).alias("lft"), *path)
    for _ in range(max(1, deepest).bit_length()):
        ahead = down.select("neuron_id", F.col("node_id").alias("at"), F.col("at").alias("at2"), F.col("lft").alias("l2"), *([F.col("path").alias("p2")] if paths else []))
        moved = down.where("at is not null").join(ahead, ["neuron_id", "at"]).select(
            *key, F.col("at2").alias("at"), (F.col("lft") + F.col("l2")).alias("lft"), *([F.concat("p2", "path").alias("path")] if paths else [])
        )
        last, down = down, materialize(down.where("at is null").unionByName(moved))
        release(last)
    full = ranked.join(down.drop("at"), key).select(
        *key, "parent_id", "root_id", "depth", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"),
        null["cycle_id"], *(["path"] if paths else []),
    )
    return full.unionByName(cyclic)


def descendants(tree: DataFrame, ancestors: DataFrame) -> DataFrame:
    """neuron_id, ancestor_id, node_id: all nodes below the given (neuron_id, node_id), by their ranges."""
    tops = tree.join(ancestors.select("neuron_id", "node_id").distinct(), ["neuron_id", "node_id"]).select(
        "neuron_id", F.col("node_id").alias("ancestor_id"), F.col("lft").alias("from_"), F.col("rgt").alias("to_")
    )
    inside = (F.col("lft") > F.col("from_")) & (F.col("lft") <= F.col("to_"))
    return tree.join(tops, "neuron_id").where(inside).select("neuron_id", "ancestor_id", "node_id")
