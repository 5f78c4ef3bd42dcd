"""Prefix trie of conversations by adaptive radix trees over turn ids.

A turn's id is the first 16 bytes, big-endian, of the SHA-256 of its role and text, so that a conversation is a key of fixed-width
ids. Conversations are put together and cut into segments of ``SEGMENT`` turns; a segment's key begins with a digest of all turns
before it, so that one conversation is never held as a whole, however long it is. Tasks insert their segments into adaptive radix
trees (nodes of 4, 16, 48 and 256 children that grow as needed, chains as compressed paths), a bounded number at a time. Of a tree
only depths at whole turns are emitted, under a digest of their prefix: a prefix that a third of all conversations share leaves each
tree as one row, and groups of rows by digest are then the nodes.

A node's smallest member is its owner; what a node adds to its ancestors (saved tokens, whether it is a leaf) is put on its owner's
segments, and a second pass through such trees sums it over subtrees. Members that end at a node are listed in ascending order, in
blocks of ``BLOCK`` ids, and hashed block by block in a stream, so that a list isn't held as a whole either.

Turn order: null turns first, then by turn; equal turns by their id (role and text decide). Every conversation is rebuilt from the
first h turns of its head conversation (see ``rebuilt``).

Defined cases: null roles and texts are empty ones; rows without a conversation id take no part; repeated rows are turns of their
own; conversations without turns end at the root; an empty table has no nodes; further columns are ignored, whatever their names.
Different turns or prefixes have one digest with a chance of some n^2 / 2^129. Turns of one conversation and turn number are
ordered in one task (by a sort that spills); all other groups are bounded or summed before they are dealt out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize

#: Bytes of an id and of a digest, and turns of a segment.
WIDTH, SEGMENT = 16, 64
#: Turn numbers of one conversation that are ordered in one task, and conversation ids of a block of a list of members.
SPAN, BLOCK = 4096, 4096
#: Bytes of keys in a task's tree before it is emitted and another begun.
HELD = 4 << 20
#: Children that each layout of a node has room for.
LAYOUTS = (4, 16, 48, 256)
#: Turns that a conversation may take from its head, less one; the head's id is a multiple of this.
HEAD, EVERY = 6, 100
ROOT = bytes(WIDTH)


class Children:
    """Children by byte, in one of four layouts: sorted bytes beside nodes (4, 16), an index of 256 bytes into nodes (48), or 256 places."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self):
        self.room, self.keys, self.nodes = 4, bytearray(), []

    def get(self, byte: int) -> Tree | None:
        if self.room == 256:
            return self.nodes[byte]
        if self.room == 48:
            at = self.keys[byte]
            return self.nodes[at] if at != 255 else None
        at = self.keys.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Tree) -> None:
        """Adds a child, or takes another one in its place."""
        if self.get(byte) is None and self.room < 256 and len(self.nodes) == self.room:
            self.grow()
        if self.room == 256:
            self.nodes[byte] = node
        elif self.room == 48:
            if self.keys[byte] == 255:
                self.keys[byte] = len(self.nodes)
                self.nodes.append(node)
            else:
                self.nodes[self.keys[byte]] = node
        elif (at := self.keys.find(byte)) >= 0:
            self.nodes[at] = node
        else:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.nodes.insert(at, node)

    def grow(self) -> None:
        own = list(self.items())
        self.room = LAYOUTS[LAYOUTS.index(self.room) + 1]
        if self.room == 48:
            self.keys = bytearray(b"\xff" * 256)
            for at, (byte, _) in enumerate(own):
                self.keys[byte] = at
        elif self.room == 256:
            self.keys, self.nodes = bytearray(), [None] * 256
            for byte, node in own:
                self.nodes[byte] = node

    def items(self) -> Iterator[tuple[int, Tree]]:
        """Children in order of their bytes."""
        if self.room == 256:
            yield from ((b, n) for b, n in enumerate(self.nodes) if n is not None)
        elif self.room == 48:
            yield from ((b, self.nodes[at]) for b, at in enumerate(self.keys) if at != 255)
        else:
            yield from zip(self.keys, self.nodes, strict=True)


class Tree:
    """A node with the compressed path that leads to it.

    ``n`` and ``least`` are of the members that pass the path's end. ``sums`` has (leaves, saved) of each depth at whole turns
    within the path, in order, as far as members add to just that depth; ``chars`` the length of each such turn's text.
    """

    __slots__ = ("chars", "children", "least", "n", "path", "sums")

    def __init__(self, path: bytes, chars: list[int], sums: list[list[int]], n: int, least: int):
        self.path, self.chars, self.sums, self.n, self.least = path, chars, sums, n, least
        self.children: Children | None = None


def insert(root: Tree, key: bytes, chars: list[int], sums: list[tuple[int, int]], member: int) -> None:
    """Puts a member's key below ``root``; ``chars`` and ``sums`` have an entry for each whole turn of the key."""
    node, at = root, 0
    node.n, node.least = node.n + 1, min(node.least, member)
    while at < len(key):
        if node.children is None:
            node.children = Children()
        child = node.children.get(key[at])
        done = at // WIDTH
        if child is None:
            node.children.put(key[at], Tree(key[at:], chars[done:], [list(s) for s in sums[done:]], 1, member))
            return
        path, rest = child.path, key[at:]
        if rest.startswith(path):
            k = len(path)
        else:
            k = next((i for i, (a, b) in enumerate(zip(path, rest)) if a != b), min(len(path), len(rest)))  # noqa: B905
            # the path is cut: what it shares with the key becomes a node of its own
            turns = (at + k) // WIDTH - done
            upper = Tree(path[:k], child.chars[:turns], child.sums[:turns], child.n, child.least)
            child.path, child.chars, child.sums = path[k:], child.chars[turns:], child.sums[turns:]
            upper.children = Children()
            upper.children.put(child.path[0], child)
            node.children.put(key[at], upper)
            child = upper
        child.n, child.least = child.n + 1, min(child.least, member)
        for own, new in zip(child.sums, sums[done:], strict=False):
            own[0] += new[0]
            own[1] += new[1]
        node, at = child, at + k


def digest(start: bytes, ids: bytes) -> bytes:
    """Of a prefix: ``start`` is that of the segment's beginning, ``ids`` are the segment's turns up to here."""
    return start if not ids else hashlib.blake2b(start + hashlib.blake2b(ids, digest_size=WIDTH).digest(), digest_size=WIDTH).digest()


def nodes(root: Tree, start: bytes) -> Iterator[tuple[bytes, bytes, int, int, int, int, int, int]]:
    """(digest, parent's digest, turns, least, n, chars, leaves, saved) of each whole turn's depth below ``start``, itself first.

    ``leaves`` and ``saved`` are summed over the subtree. A node is seen before its children and closed after them.
    """
    found: list[list] = []
    todo: list[tuple[Tree, bytes, int] | tuple[Tree, int, int]] = [(root, b"", -1)]
    while todo:
        tree, before, above = todo.pop()
        if isinstance(before, int):  # all below is known: sums go up, turn by turn
            for row in range(above, before - 1, -1):
                if (up := found[row][8]) >= 0:
                    found[up][6] += found[row][6]
                    found[up][7] += found[row][7]
            continue
        ids, first, up = before + tree.path, len(found), above
        if tree is root:
            found.append([start, None, 0, tree.least, tree.n, 0, *(tree.sums[0] if tree.sums else (0, 0)), -1])
            up = 0
        for k, (chars, own) in enumerate(zip(tree.chars, tree.sums, strict=True), len(before) // WIDTH + 1) if tree is not root else ():
            found.append([digest(start, ids[: k * WIDTH]), found[up][0], k, tree.least, tree.n, chars, *own, up])
            up = len(found) - 1
        todo.append((tree, first, len(found) - 1))
        if tree.children is not None:
            todo += [(child, ids, up) for _, child in tree.children.items()]
    yield from (tuple(row[:8]) for row in found)


def turn_id(role: Column, text: Column) -> Column:
    part = F.coalesce(role, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(part).cast("string"), F.lit(":"), part, F.coalesce(text, F.lit(""))), 256), 1, 2 * WIDTH))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, chars, block, within) of every turn; ``within`` counts from 0 in its block of turn numbers."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / SPAN))
    own = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "id")
    return rows.withColumn("within", F.row_number().over(own) - 1)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, ids, chars, last): conversations by segments of SEGMENT turns; ``last`` tells a conversation's end.

    A conversation c takes the first h turns of c - c % EVERY, h = crc32(c) % HEAD, and goes on with its own ones after its first h.
    """
    rows = materialize(numbered(conversations), "turns")
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "blocks")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    sizes = counts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", h).withColumn("head", F.col("conv_id") - F.col("conv_id") % EVERY)
    # first turns of heads lie in the first blocks, and only there
    placed = rows.where(F.col("conv_id") % EVERY == 0).join(counts.select("conv_id", "block", "before").where(F.col("before") < HEAD - 1), (rows["conv_id"] == counts["conv_id"]) & rows["block"].eqNullSafe(counts["block"])).select(rows["conv_id"].alias("head"), (F.col("before") + F.col("within")).alias("pos"), "id", "chars").where(F.col("pos") < HEAD - 1)
    heads = placed.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "chars"))).alias("turns"))
    convs = sizes.join(heads, "head", "left").select("conv_id", "h", F.coalesce(F.slice("turns", 1, F.col("h")), F.array().cast("array<struct<pos:bigint,id:binary,chars:int>>")).alias("turns"), "n")
    convs = convs.withColumn("shift", F.size("turns") - F.col("h")).withColumn("length", F.size("turns") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs, "heads")
    # where a block's own turns go, and from which place on they count
    moves = counts.join(convs.select("conv_id", "h", "shift", "length"), "conv_id").select("conv_id", "block", "before", "h", "shift", "length")
    own = rows.join(moves, (rows["conv_id"] == moves["conv_id"]) & rows["block"].eqNullSafe(moves["block"])).select(rows["conv_id"].alias("conv_id"), (F.col("before") + F.col("within")).alias("pos"), "id", "chars", "h", "shift", "length").where(F.col("pos") >= F.col("h"))
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "id", "chars", "length")
    taken = convs.select("conv_id", "length", F.inline("turns")).select("conv_id", "pos", "id", "chars", "length")
    bare = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).alias("chars"), "length")
    turns = own.unionByName(taken).unionByName(bare).withColumn("segment", F.floor(F.col("pos") / SEGMENT))
    listed = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id", "chars"))))
    segments = turns.groupBy("conv_id", "segment").agg(listed.alias("turns"), F.max("length").alias("length"))
    ids = F.coalesce(F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")), F.lit(b""))
    last = F.col("segment") == F.floor((F.greatest(F.col("length"), F.lit(1)) - 1) / SEGMENT)
    return segments.select("conv_id", "segment", ids.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars"), last.alias("last"))


def started(segments: DataFrame) -> DataFrame:
    """``segments`` with ``start``, the digest of all turns before each; of long conversations only a digest for each segment meets."""
    longer = segments.where((F.col("segment") > 0) | ~F.col("last")).select("conv_id", "segment", "ids")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashlib.blake2b(x, digest_size=WIDTH).digest() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["segment"], pa.array(made, pa.binary())], names=["conv_id", "segment", "of"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for parts in batch["parts"].to_pylist():
                starts.append(list(accumulate((p["of"] for p in parts[:-1]), lambda a, b: hashlib.blake2b(a + b, digest_size=WIDTH).digest(), initial=ROOT)))
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(starts, pa.list_(pa.binary()))], names=["conv_id", "starts"])

    parts = longer.mapInArrow(own, "conv_id long, segment long, of binary").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "of"))).alias("parts"))
    chains = parts.mapInArrow(chained, "conv_id long, starts array<binary>").select("conv_id", F.posexplode("starts").alias("segment", "start"))
    out = segments.join(chains.withColumn("segment", F.col("segment").cast("long")), ["conv_id", "segment"], "left")
    return out.withColumn("start", F.coalesce("start", F.lit(ROOT)))


PARTIAL = "digest binary, parent binary, depth long, conv_id long, n long, chars long, leaves long, saved long"


def _emitted(segments: DataFrame, more: list[str]) -> DataFrame:
    """A row for each node of each task's trees. ``more``: columns of sums, (leaves, saved) by turn of the segment; or none."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[bytes, int], Tree] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            rows = []
            for (start, segment), tree in trees.items():
                # a later segment's beginning is the end of the one before, and known there
                rows += [(d, up, segment * SEGMENT + k, *rest) for d, up, k, *rest in islice(nodes(tree, start), int(segment > 0), None)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "segment", "start", "ids", "chars", *more)]
            for conv, segment, start, ids, chars, *given in zip(*columns, strict=True):
                root = trees.get((start, segment))
                if root is None:
                    root = trees[start, segment] = Tree(b"", [], [[0, 0]], 0, conv)
                sums = [(s["leaves"], s["saved"]) for s in given[0]] if given else [(0, 0)] * len(chars)
                insert(root, ids, chars, sums, conv)
                held += len(ids) + 200
                if held >= HELD:
                    yield from told()
                    trees, held = {}, 0
        yield from told()

    kinds = pa.schema([("digest", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "n", "chars", "leaves", "saved"))])
    return segments.mapInArrow(lean(grow), PARTIAL)


def _end_digests(segments: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end: of their ids, ascending and joined by commas."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [digest(s, i) for s, i in zip(batch["start"].to_pylist(), batch["ids"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch["conv_id"]], names=["digest", "conv_id"])

    rows = segments.where("last").select("start", "ids", "conv_id").mapInArrow(ends, "digest binary, conv_id long")
    blocks = rows.groupBy("digest", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("members"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, running = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, members in zip(batch["digest"].to_pylist(), batch["members"].to_pylist(), strict=True):
                if node == own:
                    running.update(b",")
                else:
                    if own is not None:
                        done.append((own, running.hexdigest()))
                    own, running = node, hashlib.sha256()
                running.update(members.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.binary(), pa.string()))], names=["digest", "ends_sha256"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([running.hexdigest()])], names=["digest", "ends_sha256"])

    ordered = blocks.repartition("digest").sortWithinPartitions("digest", "block")
    return ordered.mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``saved_tokens``: code points that a subtree's nodes would spare if each were read once and not once for each member.
    """
    segments = materialize(started(materialize(rebuilt(conversations), "segments")), "segments")
    partial = _emitted(segments.select("conv_id", "segment", "start", "ids", "chars"), [])
    found = materialize(partial.groupBy("digest", "parent", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")), "nodes")
    children = found.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    found = materialize(found.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # what a node adds, at its owner's turn; turns of other nodes add nothing
    place, sums = F.col("depth") - 1, lambda leaves, saved: F.struct(leaves.cast("long").alias("leaves"), saved.cast("long").alias("saved"))
    zero = sums(F.lit(0), F.lit(0))
    both = lambda a, b: sums(a["leaves"] + b["leaves"], a["saved"] + b["saved"])
    added = F.struct(place.alias("at"), sums(F.col("n_children") == 0, (F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    tails = found.where("depth > 0").groupBy("conv_id", F.floor(place / SEGMENT).alias("segment")).agg(F.transform(F.array_sort(F.collect_list(added)), lambda t: t["own"]).alias("tail"))
    tails = tails.withColumn("own", F.aggregate("tail", zero, both))
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    part = lambda c: F.coalesce(F.sum(F.col(f"own.{c}")).over(later), F.lit(0))
    tails = tails.withColumn("more", sums(part("leaves"), part("saved")))
    # owners' segments before their first tail pass on all that comes later
    first = tails.groupBy("conv_id").agg(F.min("segment").alias("from"), F.sum("own.leaves").alias("leaves"), F.sum("own.saved").alias("saved"))
    weighed = segments.select("conv_id", "segment", "start", "ids", "chars").join(tails.drop("own"), ["conv_id", "segment"], "left").join(first.select("conv_id", "from", sums(F.col("leaves"), F.col("saved")).alias("all")), "conv_id", "left")
    padded = F.when(F.col("tail").isNull(), F.array_repeat(zero, F.size("chars"))).otherwise(F.concat(F.array_repeat(zero, F.size("chars") - F.size("tail")), "tail"))
    extra = F.when(F.col("tail").isNotNull(), F.col("more")).when(F.col("segment") < F.col("from"), F.col("all")).otherwise(zero)
    weights = F.transform(padded, lambda s, i: F.when(i == F.size("chars") - 1, both(s, extra)).otherwise(s))
    again = _emitted(weighed.select("conv_id", "segment", "start", "ids", "chars", weights.alias("sums")), ["sums"])
    totals = again.groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    out = found.join(totals, "digest").join(_end_digests(segments), "digest", "left")
    out = materialize(out.select("digest", "parent", "conv_id", "depth", "n_convs", "n_children", F.when(F.col("n_children") + F.col("depth") == 0, F.lit(1)).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "nodes")
    parents = found.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", "ends_sha256")
