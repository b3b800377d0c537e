"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components.

A fingerprint has 64 bits. It is cut into ``blocks`` pieces; two fingerprints that differ in at most ``distance``
bits agree on at least ``blocks - distance`` pieces, so joining on every choice of that many pieces finds each pair.

``near_copies`` is the same method for a stated similarity of word shingles. A fingerprint of 64 bits cannot tell pairs
at a similarity of 0.8, which differ in 10 bits of them on average, from strangers; so fingerprints there have as many
blocks of ``WIDE_BLOCK`` bits as a close pair needs to share one with probability ``RECALL``, and what shares a block is
verified by the Hamming distance of further bits and then by the exact similarity.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other;
rows that repeat a doc_id are fingerprinted one by one and each is returned; a null doc_id never becomes a
component_id unless its component has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, combinations
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, join_counted, materialize, partitions
from cairn.llm.suffix_dedup import by_bucket, dealt, unpack

SEED = 42
#: Runs of one block key up to this length are compared by shifts, longer ones by peeling.
SHORT_RUN = 48
#: Components that are peeled from a long run before what is left is split by finer keys.
STRANGERS = 64
#: Fingerprints of one key that one task takes, and rows that are compared at a time.
MAX_RUN = 1 << 22
LINK_ROWS = 1 << 16
#: For ``near_copies``: words of a shingle, least similarity, probability that a pair at it is found, bits of one block,
#: cells that a text's shingles are counted in before they are projected, and bits by which block mates are verified.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
WIDE_BLOCK = 18
CELLS = 1024
CHECK_BITS = 128
#: Rows of one bucket of blocks.
BUCKET_KEYS = 1 << 20


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int = 4, chunk: int = 1 << 15) -> int:
    """The SimHash of one text; hashes are counted chunk by chunk, so a long text needs bounded memory."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    lasts = ends[-n:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, chunk):
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + chunk], lasts[at : at + chunk])]
        counts += bit_counts(np.array(hashes, np.uint64))
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """One long for each choice of blocks - distance pieces: the choice's number and the pieces' bits."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    offsets = [0, *accumulate(widths)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(number).cast("long")
        for i in chosen:
            piece = F.shiftrightunsigned(fp, offsets[i]).bitwiseAND(F.lit((1 << widths[i]) - 1))
            key = F.shiftleft(key, widths[i]).bitwiseOR(piece)
        keys.append(key)
    return F.array(*keys)


def differing(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which each row of words differs from one."""
    return np.bitwise_count(fps ^ one).sum(axis=1, dtype=np.int64)


def peel(fps: np.ndarray, distance: int, roots: int | None = None) -> np.ndarray:
    """For each of one run's fingerprints (rows of words) the index of the first one in its component; visited ones are
    compared no more. -1 for what is left after so many ``roots``: nothing of it is near what has a component."""
    label = np.full(len(fps), -1)
    left = np.arange(len(fps))
    found_roots = 0
    while len(left) and found_roots != roots:
        root, frontier, left = left[0], left[:1], left[1:]
        found_roots += 1
        label[root] = root
        while len(frontier) and len(left):
            step, frontier = frontier[:64], frontier[64:]
            near = np.zeros(len(left), bool)
            own = fps[left]
            for f in fps[step]:
                near |= differing(own, f) <= distance
            found, left = left[near], left[~near]
            label[found] = root
            frontier = np.concatenate([frontier, found])
    return label


def refined(fps: np.ndarray, mask: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints that agree on the mask's bits, under finer keys: the other bits are cut into distance + 2 pieces, two
    of which any near pair shares. For each choice of two: the keys, their masks, and the fingerprints' indices."""
    free = [i for i in range(64) if not mask >> i & 1]
    pieces = [sum(1 << i for i in free[j :: distance + 2]) for j in range(distance + 2)]
    keys, masks, index = [], [], []
    for one, two in combinations(pieces, 2):
        own = mask | one | two
        keys.append((fps & np.uint64(own)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(own * 0xD1342543DE82EF95 & (1 << 64) - 1))
        masks.append(np.full(len(fps), own, np.uint64))
        index.append(np.arange(len(fps)))
    return np.concatenate(keys), np.concatenate(masks), np.concatenate(index)


def run_links(keys: np.ndarray, fps: np.ndarray, distance: int, masks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of indices) that connect what is near within each run of one key, as many as fingerprints at most for
    long runs. fps: rows of words. With masks (the bits that a key stands for) long runs of strangers are split by finer
    keys instead of being compared one by one."""
    new = np.ones(len(keys) + 1, bool)
    new[1:-1] = keys[1:] != keys[:-1]
    if masks is not None:
        new[1:-1] |= masks[1:] != masks[:-1]
    edge = np.flatnonzero(new) if len(keys) else np.zeros(1, int)
    sizes = np.diff(edge)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    run_end = np.repeat(edge[1:], sizes)
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    for shift in range(1, int(min(SHORT_RUN, sizes.max(initial=0)))):
        i = np.flatnonzero(short & (np.arange(len(keys)) + shift < run_end))
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]).sum(axis=1, dtype=np.int64) <= distance]
        a.append(i)
        b.append(i + shift)
    for k in np.flatnonzero(sizes > SHORT_RUN):
        part = fps[edge[k] : edge[k + 1]]
        mask = None if masks is None else int(masks[edge[k]])
        splits = mask is not None and 64 - mask.bit_count() > 2 * distance + 2
        label = peel(part, distance, STRANGERS if splits else None)
        own = np.flatnonzero((label != np.arange(len(part))) & (label >= 0))
        a.append(label[own] + edge[k])
        b.append(own + edge[k])
        left = np.flatnonzero(label < 0)
        if len(left):
            finer, deeper, index = refined(part[left, 0], mask, distance)
            by = np.argsort(finer, kind="stable")
            x, y = run_links(finer[by], part[left[index[by]]], distance, deeper[by])
            a.append(left[index[by][x]] + edge[k])
            b.append(left[index[by][y]] + edge[k])
    return np.concatenate(a), np.concatenate(b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links' nodes but the least ones: what the links connect, by as few."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def key_masks(distance: int, blocks: int) -> list[int]:
    """The bits that each of ``block_keys`` stands for."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    offsets = [0, *accumulate(widths)]
    return [sum(((1 << widths[i]) - 1) << offsets[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def near_links(fps: DataFrame, distance: int = 4, blocks: int | None = None, max_run: int = MAX_RUN) -> DataFrame:
    """(src, dst) links between distinct fingerprints, src > dst, that connect all within ``distance`` bits.

    ``fps`` has one column fp without repeats. Blocks are chosen so that a key has at least as many values as there
    are fingerprints; every choice is exact, a larger one only costs more keys a row. A key's run is compared in one
    task; one of over ``max_run`` fingerprints goes on to a further round under finer keys, over all tasks.
    """
    spark = fps.sparkSession
    if blocks is None:
        n = fps.count()
        blocks = next((b for b in range(distance + 2, 9) if 1 << (64 * (b - distance) // b) >= n), 8)
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in key_masks(distance, blocks)])
    pairs = F.arrays_zip(block_keys(F.col("fp"), distance, blocks).alias("key"), masks.alias("mask"))
    keyed = fps.select(F.inline(pairs).alias("key", "mask"), "fp")

    def run(batches):
        def linked(held):
            keys, own, masks = (np.concatenate(c) for c in zip(*held))
            x, y = run_links(keys, own[:, None], distance, masks)
            x, y = own[x].view(np.int64), own[y].view(np.int64)
            none = pa.nulls(len(x), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), none, none], ["src", "dst", "key", "mask"])

        def passed_on(own, masks):
            parts = [refined(own[masks == m], int(m), distance) + (own[masks == m],) for m in np.unique(masks)]
            own = np.concatenate([f[i] for _, _, i, f in parts])
            keys, masks = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            none = pa.nulls(len(own), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), none, pa.array(keys.view(np.int64)), pa.array(masks.view(np.int64))], ["src", "dst", "key", "mask"])

        held, n, whole, over = [], 0, 0, None  # whole: rows of held that are of finished runs; over: the key passed on
        for b in batches:
            if not b.num_rows:
                continue
            keys, masks, own = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy().view(np.uint64)
            if over is not None:
                cut = int(np.searchsorted(keys, over, "right"))
                if cut:
                    yield passed_on(own[:cut], masks[:cut])
                keys, masks, own = keys[cut:], masks[cut:], own[cut:]
                if not len(keys):
                    continue
                over = None
            held.append((keys, own, masks))
            n += len(keys)
            if n < LINK_ROWS:
                continue
            keys, own, masks = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield linked([(keys[:cut], own[:cut], masks[:cut])])
            held, n = [(keys[cut:], own[cut:], masks[cut:])], len(keys) - cut
            if n > max_run and 64 - int(masks[-1]).bit_count() > 2 * distance + 2:
                over = keys[-1]
                yield passed_on(own[cut:], masks[cut:])
                held, n = [], 0
        if held:
            yield linked(held)

    found = None
    while True:
        keyed = keyed.select("key", "mask", "fp").repartition(partitions(spark), "key", "mask").sortWithinPartitions("key", "mask")
        out = materialize(keyed.mapInArrow(run, "src long, dst long, key long, mask long"), "near-links")
        links = out.where("key IS NULL").select("src", "dst")
        found = links if found is None else found.union(links)
        keyed = out.where("key IS NOT NULL").select("key", "mask", F.col("src").alias("fp"))
        if keyed.isEmpty():
            return found.distinct()


def _then_none(items):
    yield from items
    yield None


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """(src, dst) stars: dst is the least node of src's component; nodes without links and the least ones are absent.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    links = materialize(links.where("src <> dst"), name)
    before = None
    while True:
        both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        large = materialize(large, name)
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst"))
        links = materialize(small.where("src <> dst").distinct(), name)
        state = links.agg(F.count("*"), F.sum(F.hash("src", "dst").cast("long")), F.sum(F.hash("dst", "src").cast("long"))).first()
        if state == before:
            return links
        before = state


def differing_share(similarity: float) -> float:
    """The greatest share of a fingerprint's bits, on average, in which texts of at least that similarity differ: sets of
    shingles at Jaccard similarity J have a cosine of at least 2 J / (1 + J)."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def wide_blocks(similarity: float = SIMILARITY, recall: float = RECALL, bits: int = WIDE_BLOCK) -> int:
    """Blocks of which a pair at that similarity shares at least one with the given probability."""
    return max(1, ceil(log(1 - recall) / log(1 - (1 - differing_share(similarity)) ** bits)))


def check_distance(similarity: float = SIMILARITY) -> int:
    """Bits of CHECK_BITS in which all but about 1 in 5,000 of the pairs at that similarity differ at most."""
    p = differing_share(similarity)
    return int(CHECK_BITS * p + 3.6 * sqrt(CHECK_BITS * p * (1 - p)))


@lru_cache(maxsize=2)
def planes(bits: int) -> np.ndarray:
    """The random signs of each cell in each bit."""
    return np.random.default_rng(SEED).integers(0, 2, (CELLS, bits), np.int8).astype(np.float32) * 2 - 1


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    lasts = ends[-max(1, len(words) - shingle + 1) :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], lasts)), np.uint64, len(lasts)))


def name_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED)


def wide_fingerprints(sets: list[np.ndarray], bits: int, rows: int = 256) -> np.ndarray:
    """texts x bits, 0 or 1: on which side of each random plane the sum of a text's shingles lies."""
    out = np.zeros((len(sets), bits), np.uint8)
    for at in range(0, len(sets), rows):
        part = sets[at : at + rows]
        sizes = np.array([len(x) for x in part])
        own = np.concatenate(part)
        cell = np.repeat(np.arange(len(part)) * CELLS, sizes) + (own % np.uint64(CELLS)).astype(np.int64)
        sums = np.bincount(cell, 1.0 - 2.0 * (own >> np.uint64(63)), len(part) * CELLS)
        out[at : at + rows] = (sums.reshape(-1, CELLS).astype(np.float32) @ planes(bits)) > 0
    return out


def peel_sets(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the index of the first one in its component; visited ones are compared no more."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = [element[a:b] for a, b in zip(starts[:-1], starts[1:])]
    label = np.full(len(sets), -1)
    left = np.ones(len(sets), bool)
    kept = len(sets)
    flag = np.zeros(element.max(initial=0) + 1, bool)
    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root], left[root] = root, False
        frontier = [root]
        while frontier and left.any():
            i = frontier.pop()
            if 2 * int(left.sum()) < kept:  # what is settled goes
                still = left[owner]
                owner, element, kept = owner[still], element[still], int(left.sum())
            flag[own[i]] = True
            both = np.bincount(owner[flag[element]], minlength=len(sets))
            flag[own[i]] = False
            found = np.flatnonzero(left & (both >= similarity * (sizes + sizes[i] - both) - 1e-9))
            label[found], left[found] = root, False
            frontier.extend(found.tolist())
    return label


def block_mates(nodes: DataFrame, blocks: int, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): links that connect all nodes (name, bits) that share a block and are near by their check bits; each task
    gives a forest of what it has found, so that a family's links don't grow with its blocks."""
    buckets = max(8, -(-nodes.count() * blocks // BUCKET_KEYS))
    least = check_distance(similarity)
    weight = 1 << np.arange(WIDE_BLOCK, dtype=np.int64)

    def keys(batches):
        for b in batches:
            bits = np.unpackbits(np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(1)]), axis=1) if b.num_rows else np.zeros((0, CHECK_BITS), np.uint8)
            n = len(bits)
            check = np.packbits(bits[:, :CHECK_BITS], axis=1).view(np.uint64)
            own = bits[:, CHECK_BITS : CHECK_BITS + blocks * WIDE_BLOCK].reshape(n, -1, WIDE_BLOCK) @ weight + (np.arange(blocks) << WIDE_BLOCK)
            key = own.reshape(-1)
            row = np.repeat(np.arange(n), own.shape[1])
            bucket = (key * 0x9E3779B1 % (1 << 31) % buckets).astype(np.int64)
            names = b.column(0).to_numpy()
            out = list(dealt(bucket, [key, names[row], *(check[row, i] for i in range(check.shape[1]))])) if n else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "blob"])

    def mates(table):
        key, name, *check = unpack((x.as_buffer() for x in table.column("blob")), "qq" + "Q" * (CHECK_BITS // 64))
        by = np.lexsort((name, key))
        x, y = run_links(key[by], np.stack(check, axis=1)[by], least)
        x, y = forest(name[by][x], name[by][y])  # a family shares many blocks; one link for each member is enough
        return pa.table([pa.array(x), pa.array(y)], ["src", "dst"])

    return by_bucket(nodes.mapInArrow(keys, "bucket long, blob binary"), buckets).applyInArrow(mates, "src long, dst long").distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, recall: float = RECALL) -> DataFrame:
    """(doc_id, component_id) for every row of docs; component_id is the least doc_id of those linked at the similarity.

    Texts with the same shingles are one node. Nodes that share a block of their fingerprints and are near by their check
    bits make clusters; within a cluster each pair, unless it is connected already, is held against its exact
    similarity. A cluster is one task's work: its different texts, of one family, must fit there.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = wide_blocks(similarity, recall)

    def sketch(batches):
        for b in batches:
            own = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            names = np.array([name_of(s) for s in own], np.uint64).view(np.int64)
            bits = np.packbits(wide_fingerprints(own, CHECK_BITS + blocks * WIDE_BLOCK), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array([x.tobytes() for x in bits], pa.binary())], ["doc_id", "name", "bits"])

    sketches = materialize(texts.mapInArrow(sketch, "doc_id long, name long, bits binary"), "sketches")
    nodes = materialize(sketches.groupBy("name").agg(F.min("doc_id").alias("low"), F.first("bits").alias("bits"), F.count("*").alias("copies")), "shingle-nodes")
    stars = connected_components(block_mates(nodes.select("name", "bits"), blocks, similarity), "shingle-links")
    clusters = stars.union(stars.select(F.col("dst").alias("src"), "dst").distinct()).join(nodes.select(F.col("name").alias("src"), "low"), "src")
    asked = texts.join(clusters, texts.doc_id == clusters.low).select("dst", "src", "text")

    def cut(batches):
        for b in batches:
            own = [shingle_set(t.as_py(), shingle) for t in b.column(2)]
            same = np.array([name_of(s) for s in own], np.uint64).view(np.int64) == b.column(1).to_numpy()
            keep = pa.array(np.flatnonzero(same))  # a doc_id may be there again with another text
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array([s.astype("<u8").tobytes() for s in own], pa.binary()).take(keep)], ["root", "name", "own"])

    def verify(batches):
        held: list[tuple] = []  # of the cluster that may go on in the next batch
        root = None
        for b in _then_none(batches):
            names, labels = [], []
            rows = [(None, None, None)] if b is None else zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            for r, name, own in rows:
                if r != root and held:
                    held.sort()
                    label = peel_sets([np.frombuffer(s, "<u8") for _, s in held], similarity)
                    names += [n for n, _ in held]
                    labels += [held[i][0] for i in label.tolist()]
                    held = []
                root = r
                if own is not None:
                    held.append((name, own))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(labels, pa.int64())], ["name", "root"])

    parts = asked.mapInArrow(cut, "root long, name long, own binary").repartition(partitions(spark), "root").sortWithinPartitions("root")
    settled = materialize(parts.mapInArrow(verify, "name long, root long").distinct(), "shingle-components")
    rooted = nodes.select("name", "low", "copies").join(settled, "name", "left").select("name", "low", "copies", F.coalesce("root", "name").alias("root"))
    classes = materialize(lows_of(rooted, "name"), "classes")
    return join_counted(sketches.select("doc_id", "name"), classes, "name", "copies", [F.col("doc_id")]).select("doc_id", "component_id")


def lows_of(rooted: DataFrame, key: str) -> DataFrame:
    """(key, copies, component_id): the least doc_id of all nodes with the same root."""
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    return join_counted(rooted.select(key, "copies", "root"), materialize(lows, "lows"), "root", "members", [F.col(key)]).select(key, "copies", "component_id")


def simhash_components(docs: DataFrame, distance: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; see the module's text for the defined cases."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "fp-nodes")
    stars = connected_components(near_links(nodes.select("fp"), distance, blocks), "fp-links")
    rooted = nodes.join(stars, nodes.fp == stars.src, "left").select("fp", "low", "copies", F.coalesce("dst", "fp").alias("root"))
    classes = materialize(lows_of(rooted, "fp"), "classes")
    return join_counted(fps, classes, "fp", "copies", [F.col("doc_id")]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
