"""SimHash fingerprints and a binary trie self-join within a Hamming distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import col, new_name, pieces, staged, texts_of
from veilwright.llm.components import components

SEED = 42
BITS = 64

#: A trie node pair with more fingerprints than this is taken apart by a further join instead of
#: being traversed in one task. It decides where the work is done, never what is found.
NODE_LIMIT = 2_000
#: Bits by which such a node is taken apart at a time.
DESCENT_BITS = 6
#: Node pairs are traversed together up to about this many at a time.
PAIRS_AT_ONCE = 2_000_000


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of one UTF-8 text; 0 without words."""
    words = text.lower().split()  # bytes: lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    width = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())),
        np.uint64,
        len(words) - width + 1,
    )
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): of every whole text a hash and the fingerprint, as signed longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            fps = np.array([fingerprint(t, words_per_shingle) for t in found], np.uint64).view(np.int64)
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "fp": pa.array(fps, pa.int64())}
            )

    return (
        texts_of(docs, id_col, text_col)
        .withColumn("text_key", F.xxhash64("text"))
        .mapInArrow(run, "doc_id long, text_key long, fp long")
    )


def trie_pairs(values: np.ndarray, groups: np.ndarray, sides: np.ndarray, spent: np.ndarray, budget: int):
    """Index pairs (i, j) of values at most budget bits apart, by traversing pairs of trie nodes.

    values: uint64, sorted by (groups, sides, values). A group whose rows are all of side 0 is joined with itself,
    any other pairs side 0 with side 1. spent: bits that a group has used up on its way.
    """
    n = len(values)
    ids = groups * 2 + sides
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    last = np.r_[first[1:], n]
    g, s = groups[first], sides[first]
    # Root pairs: (0, 0) of self-joined groups, (0, 1) of the others.
    crossed = np.zeros(len(first), bool)
    crossed[:-1] = (g[1:] == g[:-1]) & (s[:-1] == 0)
    alone = (s == 0) & ~crossed
    a = np.r_[np.flatnonzero(crossed), np.flatnonzero(alone)]
    b = np.r_[np.flatnonzero(crossed) + 1, np.flatnonzero(alone)]
    alo, ahi, blo, bhi, used = first[a], last[a], first[b], last[b], spent[first[a]].astype(np.int64)
    out_i, out_j = [], []
    for bit in range(BITS - 1, -2, -1):
        # A node with itself needs two members; two single members are compared at once.
        keep = (alo != blo) | (ahi - alo > 1)
        alo, ahi, blo, bhi, used = alo[keep], ahi[keep], blo[keep], bhi[keep], used[keep]
        single = (ahi - alo == 1) & (bhi - blo == 1) & (alo != blo)
        if single.any():
            i, j = alo[single], blo[single]
            # Bits above are equal or already counted: count those still to come.
            rest = values[i] ^ values[j]
            if bit < BITS - 1:
                rest &= np.uint64((1 << (bit + 1)) - 1)
            ok = used[single] + np.bitwise_count(rest) <= budget
            out_i.append(i[ok])
            out_j.append(j[ok])
            alo, ahi, blo, bhi, used = alo[~single], ahi[~single], blo[~single], bhi[~single], used[~single]
        if not len(alo):
            break
        if bit < 0:
            # Equal values below one node on either side.
            for x, y, u, v in zip(alo, ahi, blo, bhi):
                i, j = np.meshgrid(np.arange(x, y), np.arange(u, v), indexing="ij")
                ok = (i < j).ravel() if x == u else np.ones(i.size, bool)
                out_i.append(i.ravel()[ok])
                out_j.append(j.ravel()[ok])
            break
        ones = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        # Members of a node share the bits above, so those with a 0 come first.
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        children = [
            (alo, amid, blo, bmid, used),
            (amid, ahi, bmid, bhi, used),
            (alo, amid, bmid, bhi, used + 1),
            (amid[~same], ahi[~same], blo[~same], bmid[~same], used[~same] + 1),
        ]
        alo, ahi, blo, bhi, used = (np.concatenate(x) for x in zip(*children))
        keep = (ahi > alo) & (bhi > blo) & (used <= budget)
        alo, ahi, blo, bhi, used = alo[keep], ahi[keep], blo[keep], bhi[keep], used[keep]
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def spanning_links(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the pairs connect."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _blocks(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of distance + 2 blocks of the fingerprint, from the top."""
    n = distance + 2
    bounds = [BITS * k // n for k in range(n + 1)]
    return [(BITS - hi, hi - lo) for lo, hi in zip(bounds, bounds[1:])]


def _bits_of(value, low: int, width: int):
    if width == BITS:
        return value
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))


def _shift(value, by: int):
    return F.shiftleft(value, by) if by else value


def _roots(fps: DataFrame, distance: int) -> DataFrame:
    """Trie roots: (node, side, spent, value, fp) for every choice of two blocks that are put first.

    With distance + 2 blocks, two fingerprints within the distance agree on at least two blocks, so
    in one of the orders the walk from the root to those blocks' end spends no bit. value is the
    fingerprint with its bits in that order; a node is the order and the first two blocks.
    """
    blocks = _blocks(distance)
    rows = []
    for order, chosen in enumerate(combinations(range(len(blocks)), 2)):
        sequence = [*chosen, *(k for k in range(len(blocks)) if k not in chosen)]
        value, room = F.lit(0).cast("long"), BITS
        for k in sequence:
            low, width = blocks[k]
            room -= width
            value = value.bitwiseOR(_shift(_bits_of(F.col("fp"), low, width), room))
        first = sum(blocks[k][1] for k in chosen)
        node = F.xxhash64(F.lit(order), F.shiftrightunsigned(value, BITS - first))
        rows.append(F.struct(node.alias("node"), F.lit(first).alias("depth"), value.alias("value")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("r")).select(
        "r.node", F.lit(0).alias("side"), F.lit(0).alias("spent"), "r.depth", "r.value", "fp"
    )


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))


def _descend(nodes: DataFrame, distance: int) -> DataFrame:
    """Every node replaced by the pairs of its children DESCENT_BITS deeper that the budget allows."""
    fan = 1 << DESCENT_BITS
    by_cost = [
        [(d, d.bit_count()) for d in range(fan) if d.bit_count() <= distance - spent] for spent in range(distance + 1)
    ]
    nodes = nodes.withColumn(
        "child", F.shiftrightunsigned(F.expr("shiftleft(value, depth)"), BITS - DESCENT_BITS)
    ).withColumn(
        "flips",
        F.element_at(
            F.array(*[F.array(*[F.struct(F.lit(d).alias("d"), F.lit(c).alias("c")) for d, c in x]) for x in by_cost]),
            F.col("spent") + 1,
        ),
    )
    out = nodes.withColumn("flip", F.explode("flips")).withColumn("other", F.expr("child ^ flip.d"))
    # In a node joined with itself the smaller child is side 0, and a child meets itself once.
    mine = F.when(~F.col("crossed"), F.least("child", "other")).when(F.col("side") == 0, F.col("child"))
    mine = mine.otherwise(F.col("other"))
    theirs = F.when(~F.col("crossed"), F.greatest("child", "other")).when(F.col("side") == 0, F.col("other"))
    theirs = theirs.otherwise(F.col("child"))
    side = F.when(~F.col("crossed"), (F.col("child") > F.col("other")).cast("int")).otherwise(F.col("side"))
    crossed = F.col("crossed") | (F.col("flip.d") != 0)
    return out.select(
        F.xxhash64("node", mine, theirs).alias("node"),
        side.alias("side"),
        (F.col("spent") + F.col("flip.c")).cast("int").alias("spent"),
        (F.col("depth") + DESCENT_BITS).alias("depth"),
        "value",
        "fp",
        crossed.alias("crossed"),
    )


def _traverse(nodes: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) found below the nodes, a spanning forest per piece."""

    def finish(columns: list[np.ndarray]) -> pa.RecordBatch:
        node, side, spent, depth, value, fp, crossed = columns
        # Bits above the node's depth were counted on the way.
        below = np.where(depth >= BITS, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> depth.astype(np.uint64))
        rest = value.view(np.uint64) & below
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
        # Of a pair of different nodes both must have members, of a node with itself two.
        size, right = np.bincount(group), np.bincount(group, weights=side)
        keep = np.where(crossed[starts], (right > 0) & (right < size), size > 1)[group]
        group, side, spent, rest, fp = group[keep], side[keep], spent[keep], rest[keep], fp[keep]
        us, vs = [], []
        if len(group):
            order = np.lexsort((rest, side, group))
            group, side, spent, rest, fp = group[order], side[order], spent[order], rest[order], fp[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            load = np.cumsum(sizes * np.minimum(sizes, 1000))
            part = load // PAIRS_AT_ONCE
            cuts = [0, *starts[np.flatnonzero(np.diff(part)) + 1].tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):
                i, j = trie_pairs(rest[lo:hi], group[lo:hi], side[lo:hi], spent[lo:hi], distance)
                own, index = np.unique(fp[lo:hi], return_inverse=True)
                x, y = spanning_links(index[i], index[j], len(own))
                us.append(own[x])
                vs.append(own[y])
        u = np.concatenate(us) if us else np.zeros(0, np.int64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
        return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            node = columns[0]
            if not len(node):
                continue
            # The last node may go on in the next batch; no node is larger than NODE_LIMIT.
            cut = int(np.searchsorted(node, node[-1]))
            held = [c[cut:] for c in columns]
            if cut:
                yield finish([c[:cut] for c in columns])
        if held is not None:
            yield finish(held)

    return (
        nodes.select("node", "side", "spent", "depth", "value", "fp", "crossed")
        .repartition(F.col("node"))
        .sortWithinPartitions("node")
        .mapInArrow(run, "u long, v long")
    )


def hamming_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (u, v) that connect exactly what pairs of distinct fp at most distance bits apart connect.

    A binary trie self-join, level by level: two trie nodes are visited together, differing bits
    add up, and a pair beyond the budget is dropped. It starts below the prefixes on which two
    blocks agree (see _roots). Nodes of up to NODE_LIMIT fingerprints are traversed inside a task;
    larger ones are first taken apart by joining their children, as often as needed, so that a dense
    cluster is spread over tasks. fps must be distinct.
    """
    nodes = _roots(fps, distance).withColumn("crossed", F.lit(False))
    small = []
    while True:
        large = staged(_sizes(nodes).where(F.col("n") > NODE_LIMIT).select("node"), "large-nodes")
        if large.isEmpty():
            small.append(_traverse(nodes, distance))
            break
        small.append(_traverse(nodes.join(large, "node", "left_anti"), distance))
        deeper = _descend(nodes.join(large, "node", "left_semi"), distance)
        # Nodes that cannot have a pair are left out before the next step.
        both = _sizes(deeper.withColumn("side", F.when(F.col("crossed"), F.col("side")).otherwise(F.lit(2))))
        both = both.where("(hi = 2 and n > 1) or (lo = 0 and hi = 1)").select("node")
        nodes = staged(deeper.join(both, "node", "left_semi"), "trie-nodes")
    out = small[0]
    for part in small[1:]:
        out = out.union(part)
    return out


def simhash_components(
    docs: DataFrame, words_per_shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    fingerprint: 16 hex digits of the SimHash over lower-cased (A-Z) word shingles, repeats counted; the
    whole sequence if it has fewer words; zero without words. Fingerprints at most distance bits apart are
    linked, and equal ones are one node, so copies are never paired. component_id is the smallest
    doc_id that links lead to.

    Null or empty text: fingerprint zero, linked like any other. Null doc_id: a row of its own, ignored in the minimum
    (component_id is null if there is no other). Repeated rows: a row each. Very long texts: in full, in bounded pieces.
    Empty table: no rows. Other columns are ignored.
    """
    rows, names = _named(docs, words_per_shingle, distance, id_col, text_col)
    return rows.join(names, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _named(docs: DataFrame, words_per_shingle: int, distance: int, id_col: str, text_col: str):
    """The fingerprinted rows, and (fp, root, component_id) of every distinct fingerprint."""
    rows = staged(fingerprints(docs, words_per_shingle, id_col, text_col), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(staged(hamming_links(nodes.select("fp"), distance), "hamming-links"))
    rooted = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, rooted.join(smallest, "root").select("fp", "root", "component_id")


def simhash_dedup(
    docs: DataFrame, words_per_shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with one row of each component of simhash_components: the first by doc_id.

    All columns stay. Rows without doc_id come after all others; of rows equal in doc_id the one
    with the smallest text hash comes first, and of rows equal in both one stays. The text is moved once.
    """
    rows, names = _named(docs, words_per_shingle, distance, id_col, text_col)
    place = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text_key"))
    fields = ("no_id", "id", "text_key")
    first = F.min(F.struct(*[c.alias(n) for c, n in zip(place, fields)])).alias("first")
    kept = rows.join(names.select("fp", "root"), "fp").groupBy("root").agg(first).select("first.*")
    keys = [new_name(docs, n) for n in fields]
    row_id, text = col(id_col).cast("long"), F.coalesce(col(text_col), F.lit(""))
    named = docs.withColumns(dict(zip(keys, (row_id.isNull(), F.coalesce(row_id, F.lit(0)), F.xxhash64(text)))))
    return named.join(kept.toDF(*keys), keys, "left_semi").dropDuplicates(keys).drop(*keys)
