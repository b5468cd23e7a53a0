"""Conversation prefix trie, by adaptive radix trees.

A turn's id is WIDTH bytes: the MD5 of its role and text, then the code points of the text as a big-endian number, so what a node
saves is read off its key. A conversation is the ids of its turns one after the other. Each task keeps one adaptive radix tree over
the conversations it holds: nodes of 4, 16, 48 or 256 places that grow as children come, and edges that hold all bytes up to the next branch. A tree
branches at any byte; only depths that are a whole number of ids are nodes of the trie and are emitted, those inside an edge too.

Trees of different tasks share nodes. A node's key is a digest chained along its path, so the tasks' nodes are merged by key with partial sums:
a first turn that a third of all conversations have is one row a tree, not one a conversation. What a subtree holds needs no walk over
all its nodes. The smallest member of a node owns it; members of a node are members of its parent, so a conversation owns the nodes from some
depth `own` on. From that, for each member of a node at depth d, the summed lengths of turns d to own - 1 add up to what the subtree saves, and
the members that own a leaf to its leaves. A second pass over the conversations with their `own` sums both in the trees.

A conversation's turn ids (WIDTH bytes a turn, no texts) are gathered in one row, and a tree holds TREE_BYTES of them or one
conversation, whichever is more. Conversations are dealt to tasks by ranges of conv_id, so the ids that end at a node reach the one
that hashes them as few ordered stretches, which it streams; SHA-256 reads its input in order, so that hashing can't be split.

Defined results: turns without a conv_id belong to no conversation. A null turn number comes first; rows that share one are ordered
by their ids. Null role or text count as empty. Repeated rows are turns of their own. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small

WIDTH = 20
TREE_BYTES, TREE_ROWS, OUT_ROWS = 8 << 20, 40_000, 20_000
#: conversations of a block share the first turns of its first one, up to BLOCK_TURNS - 1 of them
BLOCK, BLOCK_TURNS = 100, 6
NOWHERE = 1 << 60


class Node:
    """A radix node: `edge` leads to it; `keys` and `kids` are laid out by how many children there are; `end` is what ends here."""

    __slots__ = ("edge", "layout", "keys", "kids", "end")

    def __init__(self, edge: bytes):
        self.edge, self.layout, self.keys, self.kids, self.end = edge, 4, bytearray(), [], None

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            return self.kids[self.keys[byte] - 1] if self.keys[byte] else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Adds or replaces the child at a byte; a full layout grows into the next one."""
        if self.layout <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.kids) < self.layout:
                self.keys.append(byte)
                self.kids.append(node)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                places = bytearray(256)
                for k, b in enumerate(self.keys):
                    places[b] = k + 1
                self.layout, self.keys = 48, places
            self.put(byte, node)
        elif self.layout == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.keys[byte] = len(self.kids)
            else:
                wide = [self.kids[k - 1] if k else None for k in self.keys]
                self.layout, self.keys, self.kids = 256, bytearray(), wide
                self.put(byte, node)
        else:
            self.kids[byte] = node

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None]


def _common(edge: bytes, key: bytes, at: int) -> int:
    """How many bytes of edge key has from `at` on."""
    if key.startswith(edge, at):
        return len(edge)
    low, high = 0, min(len(edge), len(key) - at)  # the first low bytes are equal, those up to high + 1 aren't or don't exist
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if edge[low:mid] == key[at + low : at + mid] else (low, mid - 1)
    return low


class Tree:
    """An adaptive radix tree of byte strings, each with a list of values."""

    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, value) -> None:
        node, parent, at = self.root, None, 0
        while True:
            n = _common(node.edge, key, at)
            if n < len(node.edge):
                upper = Node(node.edge[:n])
                parent.put(upper.edge[0], upper)
                node.edge = node.edge[n:]
                upper.put(node.edge[0], node)
                node = upper
            at += n
            if at == len(key):
                node.end = node.end or []
                node.end.append(value)
                return
            below = node.child(key[at])
            if below is None:
                below = Node(key[at:])
                below.end = [value]
                node.put(key[at], below)
                return
            node, parent = below, node


def walk(tree: Tree, width: int = WIDTH) -> Iterator[tuple[Node, list[tuple[int, bytes, bytes, bytes]], int]]:
    """Children before parents: each radix node, the trie nodes on its edge as (depth, key, parent's key, turn id), and its depth in whole ids."""
    top = hashlib.md5(b"").digest()
    order, stack = [], [(tree.root, top, 0, b"")]
    while stack:
        node, key, depth, tail = stack.pop()
        held = tail + node.edge
        whole = len(held) // width
        steps = [(0, top, b"", b"")] if node is tree.root else []
        for k in range(whole):
            turn = held[width * k : width * k + width]
            below = hashlib.md5(key + turn).digest()
            depth += 1
            steps.append((depth, below, key, turn))
            key = below
        order.append((node, steps, depth))
        stack += [(kid, key, depth, held[width * whole :]) for kid in node.children()]
    return reversed(order)


PARTS = "hi long, lo long, up_hi long, up_lo long, depth long, n long, low long, longest long, first long, ends string"
_PARTS = pa.schema([*[(x, pa.int64()) for x in ("hi", "lo", "up_hi", "up_lo", "depth", "n", "low", "longest", "first")], ("ends", pa.string())])
SUMS = "hi long, lo long, saved long, leaves long"
_SUMS = pa.schema([(x, pa.int64()) for x in ("hi", "lo", "saved", "leaves")])


def _halves(key: bytes) -> tuple[int | None, int | None]:
    return struct.unpack(">qq", key) if key else (None, None)


def part_rows(tree: Tree) -> Iterator[tuple]:
    """A tree's nodes with the members it knows; values of the tree are ascending conv_ids."""
    below: dict[int, tuple[int, int, int]] = {}
    for node, steps, depth in walk(tree):
        found = [below.pop(id(kid)) for kid in node.children()]
        if node.end:
            found.append((len(node.end), node.end[0], depth))
        n, low, longest = sum(x[0] for x in found), min(x[1] for x in found), max(x[2] for x in found)
        below[id(node)] = n, low, longest
        for d, key, up, _ in reversed(steps):
            ends = node.end if node.end and d == depth else None
            yield *_halves(key), *_halves(up), d, n, low, longest, ends[0] if ends else None, ",".join(map(str, ends)) if ends else None


def sum_rows(tree: Tree) -> Iterator[tuple]:
    """What a tree's members add to each node; values of the tree are (conv_id, own, leaf)."""
    below: dict[int, tuple[int, tuple, int, int]] = {}
    for node, steps, depth in walk(tree):
        found = [below.pop(id(kid)) for kid in node.children()]
        if node.end:
            owner = min(node.end)
            found.append((len(node.end), owner, 0, int(owner[2] and owner[1] <= depth)))
        n, low, saved, leaves = sum(x[0] for x in found), min(x[1] for x in found), sum(x[2] for x in found), sum(x[3] for x in found)
        for d, key, _, turn in reversed(steps):
            saved += (int.from_bytes(turn[-4:], "big") if turn else 0) * (n - (low[1] <= d))
            yield *_halves(key), saved, leaves
        below[id(node)] = n, low, saved, leaves


def _keys(ids: pa.ListArray) -> list[bytes]:
    """Each row's ids as one byte string."""
    values, offsets = ids.values, ids.offsets.to_numpy()
    if not len(values):
        return [b""] * len(ids)
    start = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
    data = memoryview(values.buffers()[2] or b"")
    return [bytes(data[start[a] : start[b]]) for a, b in zip(offsets, offsets[1:])]


def _in_trees(rows, schema: pa.Schema, value):
    """A function for mapInArrow: trees over the conversations of a task, and their rows in batches."""

    def emit(tree: Tree) -> Iterator[pa.RecordBatch]:
        made = []
        for row in rows(tree):
            made.append(row)
            if len(made) == OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), schema.types)], schema=schema)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, size, n = Tree(), 0, 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns - 1)]
            for key, *of in zip(_keys(batch.column(batch.num_columns - 1)), *columns):
                tree.add(key, value(*of))
                size, n = size + len(key), n + 1
                if size >= TREE_BYTES or n >= TREE_ROWS:
                    yield from emit(tree)
                    tree, size, n = Tree(), 0, 0
        if n:
            yield from emit(tree)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stretches of ids, sorted by node and then by first id, the hash of each node's ids; a node's stretches are streamed."""
    now, state = None, None
    for batch in batches:
        made = []
        for hi, lo, ends in zip(*(batch.column(x).to_pylist() for x in ("hi", "lo", "ends"))):
            if (hi, lo) == now:
                state.update(b",")
            else:
                if now:
                    made.append((*now, state.hexdigest()))
                now, state = (hi, lo), hashlib.sha256()
            state.update(ends.encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["hi", "lo", "ends_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["hi", "lo", "ends_sha256"])


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, ids): each conversation's turn ids in the order of its turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.concat(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), F.unhex(code).alias("id")).alias("at"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["id"]).alias("ids"))


def share_first_turns(convs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from the first conversation of its block, h = crc32(conv_id) % BLOCK_TURNS."""
    first = convs.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("first"), F.slice("ids", 1, BLOCK_TURNS - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BLOCK_TURNS).cast("int")
    both = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % BLOCK).join(first, "first", "left").withColumn("h", h)
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.array().cast("array<binary>"))
    return both.select("conv_id", F.concat(lead, F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids"), F.lit(1)))).alias("ids"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie over convs (conv_id, ids), whose conv_ids are distinct."""
    convs = cut(convs, "conversations")
    ordered = convs.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    parts = cut(ordered.mapInArrow(_in_trees(part_rows, _PARTS, lambda conv_id: conv_id), PARTS), "trie-parts")
    merged = parts.groupBy("hi", "lo").agg(F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.max("longest").alias("longest"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"))
    nodes = cut(merged, "trie-nodes")
    owners = cut(nodes.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max(F.col("longest") == F.col("depth")).alias("leaf")), "trie-owners")
    owned = convs.join(owners, "conv_id", "left").select("conv_id", F.coalesce("own", F.lit(NOWHERE)).alias("own"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "ids")
    sums = owned.mapInArrow(_in_trees(sum_rows, _SUMS, lambda *of: of), SUMS).groupBy("hi", "lo").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = parts.filter("ends is not null").select("hi", "lo", "first", "ends").repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(_hash_ends, "hi long, lo long, ends_sha256 string")
    children = nodes.groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    # a node's parent has another owner only where its own owner begins
    begins = nodes.join(owners, "conv_id").filter("depth = own and depth > 0").select("hi", "lo", "up_hi", "up_lo")
    parents = join_small(begins, nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("_parent")), ["up_hi", "up_lo"], "inner").select("hi", "lo", "_parent")
    key = ["hi", "lo"]
    whole = nodes.join(sums, key, "left").join(ends, key, "left").join(children, key, "left").join(parents, key, "left")
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
