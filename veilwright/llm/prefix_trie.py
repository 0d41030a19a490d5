"""Conversations that share beginnings, as a trie kept in balanced parentheses, shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import col, staged

#: Conversations are regrouped in runs of so many ids, of which the first lends its beginning.
FAMILY = 20
#: At most so many turns less one are lent.
LENT = 4
#: Bytes of a turn's digest in a path.
TURN = 16
#: Turns of sorted paths in one shard, about; one path is never cut. It says where the work is done, not what is found.
SHARD_TURNS = 200_000
#: Ids joined at a time for the digest of those that end at a node.
IDS_AT_ONCE = 500
#: Positions of one block of the range min-max tree, and queries that look into blocks at a time.
BLOCK = 128
QUERIES_AT_ONCE = 1 << 16

SHARD = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, ends_sha256 string"
)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _conversations(turns: DataFrame, names: dict[str, str]) -> DataFrame:
    """(conv_id, turns): each conversation's turns as digests and word counts, in order; texts stay where they are read."""
    role, text = (F.coalesce(col(names[c]).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(
        col(names["conv_id"]).cast("long").alias("conv_id"),
        F.struct(
            col(names["turn"]).alias("turn"),
            F.substring(F.sha2(framed, 256), 1, 2 * TURN).alias("id"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("turn"),
    ).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(turns: DataFrame, family: int = FAMILY, lent: int = LENT, names: dict[str, str] | None = None) -> DataFrame:
    """(conv_id, key, path, words): every conversation with its family's beginning, its turns' digests as one binary.

    The first crc32(conv_id as text) % lent turns come from conversation conv_id - conv_id % family, or are none if that is not there.
    """
    names = {c: c for c in ("conv_id", "turn", "role", "text")} | (names or {})
    own = staged(_conversations(turns, names), "trie-conversations")
    lead = own.where(F.col("conv_id") % family == 0)
    lead = lead.select(F.col("conv_id").alias("lead_id"), F.slice("turns", 1, max(1, lent - 1)).alias("lead"))
    n = (F.crc32(F.col("conv_id").cast("string")) % lent).cast("int")
    joined = own.withColumn("lead_id", F.col("conv_id") - F.col("conv_id") % family).join(lead, "lead_id", "left")
    beginning = F.when(F.col("lead").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("lead", F.lit(1), n))
    whole = F.concat(beginning, F.slice("turns", n + 1, F.greatest(F.size("turns"), F.lit(1))))
    path = F.unhex(F.array_join(F.transform("whole", lambda t: t["id"]), ""))
    return joined.select("conv_id", whole.alias("whole")).select(
        "conv_id", path.alias("path"), F.transform("whole", lambda t: t["words"].cast("int")).alias("words")
    ).withColumn("key", _key(F.col("path")))


def _key(path: Column) -> Column:
    return F.substring(F.unhex(F.sha2(path, 256)), 1, TURN)


def ends(convs: DataFrame) -> DataFrame:
    """(key, conv_id, n, ends_sha256): of conversations with one path the smallest id, number, and digest of all ids.

    Ids are sorted and joined in pieces by range, so equal conversations are spread over tasks; a digest then
    reads its pieces in order, one at a time.
    """

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list) -> pa.RecordBatch:
            keys, firsts, counts, texts = zip(*rows)
            return pa.record_batch(
                {"key": pa.array(keys, pa.binary()), "first": pa.array(firsts, pa.int64()), "n": pa.array(counts, pa.int64()), "ids": pa.array(texts, pa.string())}
            )

        last, held, out = None, [], []
        for batch in batches:
            for key, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (key != last or len(held) == IDS_AT_ONCE):
                    out.append((last, held[0], len(held), ",".join(map(str, held))))
                    held = []
                    if len(out) == IDS_AT_ONCE:
                        yield given(out)
                        out = []
                last = key
                held.append(conv_id)
        if held:
            yield given([*out, (last, held[0], len(held), ",".join(map(str, held)))])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list) -> pa.RecordBatch:
            keys, firsts, counts, digests = zip(*rows)
            return pa.record_batch(
                {"key": pa.array(keys, pa.binary()), "conv_id": pa.array(firsts, pa.int64()), "n": pa.array(counts, pa.int64()), "ends_sha256": pa.array(digests, pa.string())}
            )

        last, first, total, running, out = None, 0, 0, hashlib.sha256(), []
        for batch in batches:
            for key, lo, n, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "ids"))):
                if key == last:
                    running.update(b"," + ids.encode())
                    total += n
                    continue
                if last is not None:
                    out.append((last, first, total, running.hexdigest()))
                last, first, total, running = key, lo, n, hashlib.sha256(ids.encode())
            if out:
                yield given(out)
                out = []
        if last is not None:
            yield given([(last, first, total, running.hexdigest())])

    ids = convs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = staged(ids.mapInArrow(join, "key binary, first long, n long, ids string"), "trie-ends")
    joined = joined.repartition("key").sortWithinPartitions("key", "first")
    return joined.mapInArrow(digest, "key binary, conv_id long, n long, ends_sha256 string")


class Parentheses:
    """A tree as balanced parentheses, with the least excess of blocks of positions and of pairs, pairs of pairs ... of blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int32)
        blocks = 1 << max(0, (-(-len(opens) // BLOCK) - 1)).bit_length()
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(opens)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        self.least = [self.blocks.min(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
        leaf = np.zeros(len(opens) + 1, np.int64)
        leaf[1:-1] = np.cumsum(opens[:-1] & ~opens[1:])
        leaf[-1] = leaf[-2]
        self.leaf_rank = leaf

    def _in_block(self, block: np.ndarray, after: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First position of a block, after a place in it, with an excess under a bound, or -1."""
        out = np.full(len(block), -1, np.int64)
        for k in range(0, len(block), QUERIES_AT_ONCE):
            part = slice(k, k + QUERIES_AT_ONCE)
            hit = (self.blocks[block[part]] < below[part, None]) & (np.arange(BLOCK) > after[part, None])
            at = hit.argmax(axis=1)
            found = hit[np.arange(len(at)), at]
            out[part] = np.where(found, block[part] * BLOCK + at, -1)
        return out

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Positions of the parentheses that close those opened at the given ones."""
        below = self.excess[at]
        close = self._in_block(at // BLOCK, at % BLOCK, below)
        far = np.flatnonzero(close < 0)
        node, level = at[far] // BLOCK, np.full(len(far), -1)
        for k, least in enumerate(self.least[:-1]):  # up, until the right neighbour holds the answer
            going = np.flatnonzero(level < 0)
            left = going[node[going] % 2 == 0]
            hit = left[least[node[left] + 1] < below[far[left]]]
            node[hit] += 1
            level[hit] = k
            rest = going[level[going] < 0]
            node[rest] //= 2
        for k in range(len(self.least) - 1, 0, -1):  # down, to the first block that holds it
            here = np.flatnonzero(level == k)
            node[here] *= 2
            node[here] += self.least[k - 1][node[here]] >= below[far[here]]
            level[here] = k - 1
        close[far] = self._in_block(node, np.full(len(far), -1), below[far])
        return close

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """How many `()` stand from `at` up to `close`."""
        return self.leaf_rank[close] - self.leaf_rank[at]


def _least_of_ranges(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Minimum of values[start : start + size], of two ranges of a power of two each."""
    out, level = np.empty(len(start), values.dtype), np.log2(size).astype(np.int64)
    table = values
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[start[here]], table[start[here] + size[here] - (1 << k)])
        table = np.minimum(table[: max(0, len(table) - (1 << k))], table[1 << k :])
    return out


def _shared(paths: list[bytes], depths: np.ndarray) -> np.ndarray:
    """How many turns each path shares with the one before it; the first: -1, so that it opens the root."""
    flat = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, TURN // 8)
    starts = np.cumsum(depths) - depths
    row = np.repeat(np.arange(len(paths)), depths)
    turn = np.arange(len(row)) - starts[row]
    before = np.maximum(row - 1, 0)
    both = (row > 0) & (turn < depths[before])
    same = both & (flat == flat[np.where(both, starts[before] + turn, 0)]).all(axis=1)
    out = depths.copy()
    np.minimum.at(out, row[~same], turn[~same])
    out[0] = -1
    return out


def shard(paths: list[bytes], words: list[np.ndarray], n: list[int], conv_ids: list[int], digests: list[str]) -> pa.RecordBatch:
    """The nodes of sorted distinct paths, in preorder.

    Nodes on the first and the last path may go on in other shards: they carry a key and what is known here, their
    savings and leaves without those of such nodes.
    """
    depths = np.fromiter((len(p) // TURN for p in paths), np.int64, len(paths))
    common = _shared(paths, depths)
    new = depths - common
    last = np.cumsum(new) - 1  # where paths end, in preorder
    total = int(new.sum())
    row = np.repeat(np.arange(len(paths)), new)
    depth = np.arange(total) - (last[row] - depths[row])
    offsets = np.cumsum(depths) - depths
    flat_words = np.concatenate([np.zeros(1, np.int64), *words])
    weight = np.where(depth > 0, flat_words[1 + np.minimum(offsets[row] + depth - 1, len(flat_words) - 2)], 0)

    runs = np.empty(2 * len(paths), np.int64)
    runs[0::2], runs[1:-1:2], runs[-1] = new, depths[:-1] - common[1:], depths[-1] + 1
    tree = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 0, runs))
    at = np.flatnonzero(tree.opens)
    close = tree.findclose(at)
    first, size = np.arange(total), (close - at + 1) // 2
    after = first + size

    def summed(values: np.ndarray) -> np.ndarray:
        running = np.r_[0, np.cumsum(values)]
        return running[after] - running[first]

    ending, least = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    ending[last], least[last] = n, conv_ids
    n_convs = summed(ending)
    conv_id = _least_of_ranges(least, first, size)
    # Nodes by depth, then preorder: the children of a node are those one deeper within its range.
    wide = total + 1
    by_depth = np.sort(depth * wide + first)
    n_children = np.searchsorted(by_depth, (depth + 1) * wide + after) - np.searchsorted(by_depth, (depth + 1) * wide + first)
    parent = by_depth[np.maximum(np.searchsorted(by_depth, (depth - 1) * wide + first) - 1, 0)] % wide

    spine = (first <= depths[0]) | (after == total)
    own = (n_convs - 1) * weight
    n_leaves = tree.leaves(at, close) - np.where(spine, summed(spine & (size == 1)), 0)
    saved = np.where(spine, summed(np.where(spine, 0, own)), summed(own))
    n_children = n_children - np.where(spine, np.bincount(parent[spine & (first > 0)], minlength=total), 0)

    keys = np.full(total, None, object)
    for path, nodes in ((paths[0], first[: depths[0] + 1]), (paths[-1], np.flatnonzero(after == total))):
        running = hashlib.sha256()
        for d, node in enumerate(nodes):
            running.update(path[TURN * (d - 1) : TURN * d] if d else b"")
            keys[node] = running.digest()[:TURN]
    hangs = spine[parent] & (first > 0)
    sha = np.full(total, None, object)
    sha[last] = digests
    return pa.record_batch(
        {
            "key": pa.array(keys, pa.binary()),
            "parent_key": pa.array(np.where(hangs, keys[parent], None), pa.binary()),
            "conv_id": pa.array(conv_id),
            "depth": pa.array(depth),
            "parent_conv_id": pa.array(conv_id[parent], mask=hangs | (first == 0)),
            "n_convs": pa.array(n_convs),
            "n_children": pa.array(n_children.astype(np.int64)),
            "n_leaves": pa.array(n_leaves),
            "saved_tokens": pa.array(saved),
            "words": pa.array(weight),
            "ends_sha256": pa.array(sha, pa.string()),
        }
    )


def _shards(batches: Iterable[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted rows of a partition, a shard of about shard_turns at a time."""
    held: list[list] = [[], [], [], [], []]
    turns = 0
    for batch in batches:
        words = batch.column("words")
        offsets, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = zip(*(batch.column(c).to_pylist() for c in ("path", "n", "conv_id", "ends_sha256")))
        for k, (path, n, conv_id, digest) in enumerate(rows):
            for column, value in zip(held, (path, flat[offsets[k] : offsets[k + 1]], n, conv_id, digest)):
                column.append(value)
            turns += len(path) // TURN + 1
            if turns >= shard_turns:
                yield shard(*held)
                held, turns = [[], [], [], [], []], 0
    if held[0]:
        yield shard(*held)


def _spines(nodes: DataFrame) -> DataFrame:
    """The nodes with a key, merged over shards: sums over shards, then what nodes with a key add to those above them.

    That sum is taken by doubling: after k rounds a node has what lies less than 2^k below it, and knows its ancestor at
    that distance. The rounds are a logarithm of the longest spine.
    """
    merged = nodes.where("key is not null").groupBy("key", "parent_key", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = staged(merged, "trie-spines")
    below = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    merged = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    merged = staged(merged, "trie-spines")
    sums = merged.select(
        "key", F.col("parent_key").alias("up"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
    )
    reach, deepest = 1, merged.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        added = sums.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        above = sums.select(F.col("key").alias("up"), F.col("up").alias("next"))
        sums = sums.join(added, "key", "left").join(above, "up", "left").select(
            "key", F.col("next").alias("up"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
        )
        sums, reach = staged(sums, "trie-sums"), 2 * reach
    return merged.join(sums.select("key", "saved", "leaves"), "key").withColumns(
        {"saved_tokens": F.col("saved_tokens") + F.col("saved"), "n_leaves": F.col("n_leaves") + F.col("leaves")}
    )


def prefix_trie(
    turns: DataFrame, family: int = FAMILY, lent: int = LENT, shard_turns: int = SHARD_TURNS, names: dict[str, str] | None = None
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    A node is a distinct beginning of rebuilt conversations (see rebuilt), of 0 turns or more; a turn is its role and text. conv_id is the
    smallest conversation that begins so, with depth it names the node. saved_tokens: over the subtree, words of a node's last turn times
    its conversations less one. Paths of digests are sorted and cut into shards, each encoded as balanced parentheses; the nodes that
    shards may share, on their first and last paths, are merged.

    A conversation's turns are in order of turn, null first; turns of one number in order of a digest of role and
    text. Null role or text: empty. Null conv_id: the row is no conversation's and is left out. Repeated rows: a turn each.
    No turns after the rebuilding: a member of the root. Empty table: no rows. Very long texts: in full; of a
    conversation one task holds some 40 bytes a turn. Other columns are ignored; names gives other column names.
    """
    convs = staged(rebuilt(turns, family, lent, names), "trie-paths")
    paths = ends(convs).join(convs.select("conv_id", "path", "words"), "conv_id").select("path", "words", "n", "conv_id", "ends_sha256")
    sorted_paths = paths.repartitionByRange("path").sortWithinPartitions("path")
    nodes = staged(sorted_paths.mapInArrow(lambda batches: _shards(batches, shard_turns), SHARD), "trie-nodes")
    spines = staged(_spines(nodes), "trie-merged")
    parents = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up_id"))
    named = spines.where("parent_key is not null").drop("parent_conv_id")
    hanging = nodes.where("key is null and parent_key is not null")

    def chosen(df: DataFrame, parent: Column) -> DataFrame:
        sha = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
        return df.withColumn("parent_conv_id", parent).withColumn("ends_sha256", sha).select(*RESULT)

    return (
        chosen(nodes.where("key is null and parent_key is null"), F.col("parent_conv_id"))
        .union(chosen(hanging.join(parents, "parent_key"), F.col("up_id")))
        .union(chosen(named.join(parents, "parent_key"), F.col("up_id")))
        .union(chosen(spines.where("parent_key is null"), F.lit(None).cast("long")))
    )
