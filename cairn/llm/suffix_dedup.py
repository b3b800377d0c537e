"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier (smaller doc_id, or same document and
earlier start) is removed; strings are judged on the input and never cross documents.

1. Homes. The texts are written once, in shares ("homes") of ``SHARE_BYTES``, as a table that Spark reads home by home
   without moving it again.
2. Suffix buckets. A position's suffix belongs to the bucket of its anchor: the leftmost least hash of the ``GRAM``-byte
   strings within its first LENGTH bytes. Equal strings have equal anchors at equal distances, so each bucket holds all
   that could be equal, and the positions of one anchor are one stretch, whose bytes are its context. Only hashes of
   anchors and contexts move. Different hashes prove that strings differ; equal ones only propose.
3. Copies. Contexts with equal hashes are proposed as copies of the earliest one. Each is held byte by byte against
   another member of its group, ``FAN`` of them against one, so that a group of any size is spread over its members'
   homes. Neighbouring stretches go together as one run. Where a proposal turns out false, all is done again under
   other hashes.
4. Blockwise sorting. The different contexts of one anchor send their bytes to its bucket. A task concatenates its
   buckets' contexts. The suffixes at a difference cover's residues (period ``PERIOD``) are ranked first. Then one block
   of suffixes at a time, by their first bytes, is sorted: by PERIOD bytes directly, and longer ties by the cover-sample
   ranks, as for any two suffixes some shift below PERIOD takes both to sampled places. Neighbours that share LENGTH
   bytes are one class, whose first member stays. Memory is bounded by the block, the task's text and its sample ranks.
   An anchor that seems to hold over ``HOT_SHARE`` of a task's anchors (counted on one document in ``SAMPLE_EVERY``) is
   split by its longest prefix: each of its strings is a bucket of its own, which step 3 settles.

Before anything moves, each task drops what it has seen to be a copy among its own documents; that splits hot groups.

Defined cases: a null or empty text has 0 bytes and the digest of nothing; texts under LENGTH bytes stay whole; rows
that repeat a doc_id, with the same or other texts, count as that document (a string is earlier only if its doc_id or
its start is smaller) and are returned one by one; a null doc_id comes after all others; very long texts are hashed in
segments; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, materialize, scratch_path

LENGTH = 100
GRAM = 28
PERIOD = 31
#: Residues whose differences give every residue of PERIOD.
COVER = (1, 5, 11, 24, 25, 27)
#: Text bytes of one home, and of one task's share of anchors and contexts.
SHARE_BYTES = 8 << 20
#: The most shares: Spark takes no table of over 100,000 buckets, and shuffles have the square of their number in blocks.
#: Beyond 420 GB of text a share grows with it (2 GB at 100 TB), and with it a task's memory.
MOST_SHARES = 50_000
#: Anchors held by one task before they are passed on, and window starts hashed at a time.
HELD = 400_000
SEGMENT = 1 << 21
#: Suffixes of one block.
BLOCK = 1 << 20
#: Members of a group of copies that are held against one other.
FAN = 8
HOT_SHARE = 0.25
SAMPLE_EVERY = 16
LAST_ID = (1 << 63) - 1
#: Seeds that are tried where two different contexts have equal hashes.
SEEDS = (5, 17, 29, 41)
FALSE_PROPOSAL = "contexts with equal hashes differ"
U64 = np.uint64

BASE = [U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)]


def byte_values(seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.integers(1, 1 << 63, 256, np.int64).astype(U64) * U64(2) + U64(1) for _ in range(2)]


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


_held_powers: dict = {}


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if k not in _held_powers or len(_held_powers[k][0]) < n:
        _held_powers[k] = _powers(BASE[k], max(n, 1 << 16))
    return _held_powers[k]


class Hashed:
    """Prefix sums of one segment's polynomial hash, from which any stretch's hash follows."""

    def __init__(self, data: np.ndarray, k: int, values: np.ndarray) -> None:
        up, self.down = powers(k, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def anchors(data: np.ndarray, values: list[np.ndarray], hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of one document's bytes: for each anchor its hash, its context's hash, and the first and last window start.

    The strings of the anchors in ``hot`` (sorted) come one by one, each as an anchor of its own.
    """
    out = []
    for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        n = len(part) - LENGTH + 1
        one, two = Hashed(part, 0, values[0]), Hashed(part, 1, values[1])
        places = np.arange(len(part) - GRAM + 1)
        grams = one.of(places, places + GRAM)
        low = U64((1 << 24) - 1)
        least = (grams & ~low) | places.astype(U64)
        width = LENGTH - GRAM + 1
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        step = width - 64
        least = np.minimum(least[:-step], least[step:])
        anchor = (least[:n] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        p = anchor[first]
        shape = ((p - first) << 8 | (last - first)).astype(U64)
        a, c = grams[p] >> U64(16), mix(two.of(first, last + LENGTH) + shape * U64(0x2545F4914F6CDD1D))
        if hot is not None and len(hot):
            split = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
            each = np.concatenate([np.zeros(0, np.int64), *(np.arange(f, l + 1) for f, l in zip(first[split], last[split]))])
            a = np.concatenate([a[~split], mix(one.of(each, each + LENGTH)) >> U64(16)])
            c = np.concatenate([c[~split], mix(two.of(each, each + LENGTH))])
            first, last = np.concatenate([first[~split], each]), np.concatenate([last[~split], each])
        out.append((a, c, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length as byte planes, which the shuffle's compression shortens."""
    head = np.array([len(columns[0])], "<i8").tobytes()
    return head + b"".join(c.astype("<" + c.dtype.str[1:]).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)


def unpack(blobs, kinds: str) -> list[np.ndarray]:
    """The arrays of all blobs, one after the other; kinds: numpy's letters, such as QQq."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, "<i8", 1)[0]), 8
        for out, k in zip(parts, kinds):
            size = np.dtype(k).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(k).reshape(n))
            at += n * size
    return [np.concatenate(p) for p in parts]


def runs_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns sorted together."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def later(group: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by group, doc and start; and for each row in it whether its group has an earlier one."""
    by = np.lexsort((start, doc, *group[::-1]))
    begin = runs_of(*(g[by] for g in group))
    first = np.repeat(begin, np.diff(np.append(begin, len(by))))
    return by, (doc[by] != doc[by][first]) | (start[by] != start[by][first])


def removed_runs(starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs of window starts from starts to ends, inclusive."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    a, b = starts[by], np.maximum.accumulate(ends[by] + length)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[new], b[np.append(new[1:], len(a)) - 1]


def kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, maximal runs, and the digest of what stays."""
    a, b = removed_runs(starts, ends)
    digest, at = hashlib.sha256(), 0
    view = memoryview(data)
    for x, y in zip(a.tolist(), b.tolist()):
        digest.update(view[at:x])
        at = y
    digest.update(view[at:])
    return int((b - a).sum()), len(a), digest.hexdigest()


def difference_cover(period: int) -> np.ndarray:
    """Residues such that any two positions have a common shift below period to residues among them."""
    if period == PERIOD:
        return np.array(COVER)
    root = int(np.ceil(np.sqrt(period)))
    return np.array(sorted({*range(root), *range(root, period, root)}))


def shifts(period: int, cover: np.ndarray) -> np.ndarray:
    """By two positions' residues the least such shift."""
    inside = np.isin(np.arange(period), cover)
    d = np.arange(period)
    both = inside[(d[:, None, None] + d) % period] & inside[(d[None, :, None] + d) % period]
    return both.argmax(axis=2)


def word_names(text: np.ndarray) -> np.ndarray:
    """By position the rank of the eight bytes there among all such words; 7 positions fewer than bytes."""
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    words = np.ascontiguousarray(words).view(">u8").reshape(-1).astype(U64)
    by = np.argsort(words)
    new = np.zeros(len(by), np.int64)
    held = words[by]
    new[1:] = held[1:] != held[:-1]
    names = np.empty(len(by), np.int64)
    names[by] = np.cumsum(new)
    return names


def grouped_order(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by group, then key: both are whole numbers from 0. One sort of single numbers where they fit."""
    n = len(group)
    a, b, c = (int(x).bit_length() for x in (group.max(initial=0), key.max(initial=0), n))
    if a + b + c > 64:
        return np.lexsort((key, group))
    packed = (group.astype(U64) << U64(b + c)) | (key.astype(U64) << U64(c)) | np.arange(n, dtype=U64)
    packed.sort()
    return (packed & U64((1 << c) - 1)).astype(np.int64)


def offsets_to(depth: int) -> list[int]:
    """Where words of eight bytes begin that cover depth bytes, the last one within them if depth allows."""
    return [0] if depth <= 8 else [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]


def refine(names: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by depth bytes, eight at a time and only where tied; and where each tie of them begins."""
    order, group = places.copy(), np.zeros(len(places), np.int64)
    for offset in offsets_to(depth):
        begin = runs_of(group)
        size = np.diff(np.append(begin, len(group)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        own = order[tied]
        dense = np.repeat(np.arange((size > 1).sum()), size[size > 1])
        key = names[own + offset]
        by = grouped_order(dense, key)
        order[tied] = own[by]
        key = key[by]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (dense[1:] != dense[:-1])  # dense is sorted, by keeps it
        group[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, runs_of(group)


def sample_ranks(names: np.ndarray, n: int, period: int, depth: int) -> np.ndarray:
    """By position the rank of the sampled suffixes by depth bytes, equal for equal ones; -1 elsewhere."""
    places = np.flatnonzero(np.isin(np.arange(n) % period, difference_cover(period)))
    order, begin = refine(names, places, depth)
    rank = np.full(len(names), -1, np.int64)
    new = np.zeros(len(order), np.int64)
    new[begin] = 1
    rank[order] = np.cumsum(new)
    return rank


def sort_ties(order: np.ndarray, begin: np.ndarray, rank: np.ndarray, period: int, table: np.ndarray) -> np.ndarray:
    """Sort what is tied after period bytes by the cover-sample ranks: three-way partition by pivots, all ties at once."""
    order = order.copy()
    size = np.diff(np.append(begin, len(order)))
    begin, size = begin[size > 1], size[size > 1]
    while len(begin):
        group = np.repeat(np.arange(len(begin)), size)
        slots = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        own = order[slots]
        pivot = np.repeat(order[begin + size // 2], size)
        shift = table[own % period, pivot % period]
        side = np.sign(rank[own + shift] - rank[pivot + shift])
        by = grouped_order(group, side + 1)
        order[slots] = own[by]
        side = side[by]
        new = runs_of(group, side)
        sizes = np.diff(np.append(new, len(group)))
        go_on = (side[new] != 0) & (sizes > 1)  # what equals the pivot is in its place
        begin, size = slots[new[go_on]], sizes[go_on]
    return order


def blockwise_classes(text: np.ndarray, places: np.ndarray, length: int = LENGTH, period: int = PERIOD, block: int = BLOCK):
    """Yield, block by block, (places, where classes begin): the places in suffix order, equal LENGTH-byte strings
    together. text ends in length + period + 8 zeros."""
    n = len(text) - length - period - 8
    names = word_names(text)
    rank = sample_ranks(names, n, period, length)
    table = shifts(period, difference_cover(period))
    head = text[places].astype(np.int64) << 8 | text[places + 1]
    counts = np.bincount(head, minlength=1 << 16)
    total, low = 0, 0
    for high in range(1 << 16):
        total += counts[high]
        if total and (high == (1 << 16) - 1 or total + counts[high + 1] > block):
            own = places[(head >= low) & (head <= high)]
            order, begin = refine(names, own, period)
            order = sort_ties(order, begin, rank, period, table)
            new = np.ones(len(order), bool)
            new[1:] = False
            for offset in offsets_to(length):
                w = names[order + offset]
                new[1:] |= w[1:] != w[:-1]
            yield order, np.flatnonzero(new)
            total, low = 0, high + 1


def context_classes(contexts: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """contexts: (bytes, doc, first window start). For each, which of its windows also start earlier in another."""
    by = sorted(range(len(contexts)), key=lambda i: contexts[i][1:])
    text = np.frombuffer(b"".join([*(contexts[i][0] for i in by), bytes(LENGTH + PERIOD + 8)]), np.uint8)
    sizes = np.array([len(contexts[i][0]) for i in by])
    windows = sizes - LENGTH + 1
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    slot = np.concatenate([[0], np.cumsum(windows)[:-1]])
    inner = np.arange(windows.sum()) - np.repeat(slot, windows)
    places = np.repeat(at, windows) + inner
    doc = np.repeat(np.array([contexts[i][1] for i in by]), windows)
    start = np.repeat(np.array([contexts[i][2] for i in by]), windows) + inner
    number = np.zeros(len(text), np.int64)
    number[places] = np.arange(len(places))
    dup = np.zeros(len(places), bool)
    for order, begin in blockwise_classes(text, places):
        own = number[order]  # ascending numbers are ascending (doc, start)
        first = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(own))))
        dup[own] = (doc[own] != doc[first]) | (start[own] != start[first])
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(contexts)
    for i, s, w in zip(by, slot, windows):
        out[i] = dup[s : s + w]
    return out


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


#: A row to a home or to an anchor's bucket. Kinds: anchors, what a bucket says of them, contexts, runs to verify, removed runs.
ANCHORS, SAID, CONTEXTS, VERIFY, REMOVED = range(5)
ROW = "bucket long, kind int, one binary, two binary"
ANCHOR = "QQqqqqB"  # anchor, context, doc, home, slot, first and last start
CHILD = "qqqqqqB"  # slot, first and last start; home, slot and first start of whom it copies; whether that is earlier
WANTED = "qqqQ"  # slot, first and last start, anchor
RUN = "qqq"  # slot, first and last start


def packed_rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "kind", "one", "two"])


def dealt(bucket: np.ndarray, columns: list[np.ndarray]):
    """For each bucket its number and its part of the columns."""
    by = np.argsort(bucket, kind="stable")
    begin = runs_of(bucket[by])
    for s, e in zip(begin, np.append(begin[1:], len(by))):
        yield int(bucket[by[s]]), pack([c[by[s:e]] for c in columns])


def merged(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """columns: slot, first, last; and home, slot and first of whom each copies. Stretches of one text that copy
    neighbouring stretches of another at the same distance become one. Returns the same columns and each row's run."""
    slot, first, last, home, pslot, pfirst = columns
    by = np.lexsort((first, pfirst - first, pslot, home, slot))
    slot, first, last, home, pslot, pfirst = (c[by] for c in (slot, first, last, home, pslot, pfirst))
    shift = pfirst - first
    new = np.ones(len(by), bool)
    if len(by):
        # within one slot, other and shift the starts ascend, and so do the ends, as stretches don't hold one another
        new[1:] = (slot[1:] != slot[:-1]) | (home[1:] != home[:-1]) | (pslot[1:] != pslot[:-1]) | (shift[1:] != shift[:-1]) | (first[1:] > last[:-1] + LENGTH)
    begin = np.flatnonzero(new)
    run = np.empty(len(by), np.int64)
    run[by] = np.cumsum(new) - 1
    ends = np.maximum.reduceat(last, begin) if len(begin) else last
    return slot[begin], first[begin], ends, home[begin], pslot[begin], pfirst[begin], run


def homed(docs: DataFrame, share_bytes: int) -> DataFrame:
    """(home, slot, doc_id, data, copies): the texts in homes of about share_bytes; equal rows of a home are one."""
    schema = "home long, slot long, doc_id long, data binary, copies long"

    def batch(home, held):
        columns = [[home] * len(held), range(len(held)), [k[0] for k in held], [k[1] for k in held], held.values()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split(" ")[0] for c in schema.split(", ")])

    def run(batches):
        home, held, n = None, {}, 0
        for b in batches:
            for row, doc, data in zip(*(c.to_pylist() for c in b.columns)):
                if home is None:
                    home = row  # its first row's number
                held[doc, data] = held.get((doc, data), 0) + 1
                n += len(data)
                if n >= share_bytes:
                    yield batch(home, held)
                    home, held, n = None, {}, 0
        if held:
            yield batch(home, held)

    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc_id"), data.alias("data")).mapInArrow(run, schema)


def hot_anchors(texts: DataFrame, buckets: int, values: list[np.ndarray], share: float = HOT_SHARE, every: int = SAMPLE_EVERY) -> np.ndarray:
    """Anchors that seem to hold over ``share`` of one bucket's mean number, so at most buckets / share of them.

    They are counted on one document in ``every``; it only decides how a bucket is split, never a result.
    """

    def run(batches):
        for b in batches:
            found = [anchors(np.frombuffer(t.as_buffer(), np.uint8), values)[0] for t in b.column(0)]
            a, n = np.unique(np.concatenate([np.zeros(0, U64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["a", "n"])

    drawn = texts.where(F.pmod(F.xxhash64("home", "slot"), F.lit(every)) == 0).select("data")
    total = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    least = share * total * 2 / (LENGTH - GRAM + 2) / buckets / every
    counts = drawn.mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return np.sort(np.array([r["a"] for r in counts.collect()], np.int64).view(U64))


def anchor_rows(texts: DataFrame, buckets: int, values: list[np.ndarray], hot: np.ndarray) -> DataFrame:
    """Anchors by bucket. What copies an earlier text of the same batch, byte for byte, is only told to its home."""
    sent = texts.sparkSession.sparkContext.broadcast((values, hot))

    def flush(held, texts):
        own, a, c, doc, home, slot, first, last = (np.concatenate(x) for x in zip(*held))
        by, dup = later([a, c], doc, first)
        own, a, c, doc, home, slot, first, last = (x[by] for x in (own, a, c, doc, home, slot, first, last))
        begin = runs_of(a, c)
        head = np.repeat(begin, np.diff(np.append(begin, len(a))))
        known = np.flatnonzero(dup)
        s, f, e, _, p, pf, run = merged(own[known], first[known], last[known], np.zeros(len(known), np.int64), own[head[known]], first[head[known]])
        same = np.array([texts[i][x : y + LENGTH] == texts[j][z : z + y - x + LENGTH] for i, x, y, j, z in zip(*(v.tolist() for v in (s, f, e, p, pf)))], bool)
        sure = same[run]
        gone = known[sure]
        left = np.ones(len(a), bool)
        left[gone] = False
        out = [(b, ANCHORS, blob, None) for b, blob in dealt((a[left] % U64(buckets)).astype(np.int64), [*(x[left] for x in (a, c, doc, home, slot, first)), (last - first)[left].astype(np.uint8)])]
        none = np.zeros(len(gone), np.int64)
        s, f, e, h, _, _, _ = merged(slot[gone], first[gone], last[gone], home[gone], none, first[gone])
        # A bucket passes these on, spread by their homes.
        out += [(i % buckets, REMOVED, blob, i.to_bytes(8, "little")) for i, blob in dealt(h, [s, f, e])]
        return packed_rows(out)

    def run(batches):
        values, hot = sent.value
        held, n, texts = [], 0, []
        for b in batches:
            for home, slot, doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                raw = data.as_buffer()
                a, c, first, last = anchors(np.frombuffer(raw, np.uint8), values, hot)
                if len(a):
                    held.append((np.full(len(a), len(texts)), a, c, np.full(len(a), doc), np.full(len(a), home), np.full(len(a), slot), first, last))
                    texts.append(data.as_py())
                    n += len(a)
                if n >= HELD:
                    yield flush(held, texts)
                    held, n, texts = [], 0, []
        if held:
            yield flush(held, texts)

    return texts.select("home", "slot", "doc_id", "data").mapInArrow(run, ROW)


def by_bucket(rows: DataFrame, buckets: int):
    """Rows of one bucket together, a task for each bucket whatever the session's number of shuffle partitions is."""
    return rows.repartition(buckets, "bucket").groupBy("bucket")


def spread_anchors(blobs) -> list[np.ndarray]:
    a, c, doc, home, slot, first, span = unpack(blobs, ANCHOR)
    return [a, c, doc, home, slot, first, first + span]


def judge_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """To the homes: of whom a stretch is a copy by hash, and whose bytes are wanted."""

    def run(table: pa.Table) -> pa.Table:
        a, c, doc, home, slot, first, last = spread_anchors(blobs_of(table, "one", ANCHORS))
        known = zip(blobs_of(table, "two", REMOVED), blobs_of(table, "one", REMOVED))
        known = [(int.from_bytes(memoryview(h), "little"), REMOVED, memoryview(blob), None) for h, blob in known]
        by, dup = later([a, c], doc, first)
        a, c, doc, home, slot, first, last = (x[by] for x in (a, c, doc, home, slot, first, last))
        begin = runs_of(a, c)
        head = np.repeat(begin, np.diff(np.append(begin, len(a))))
        place = np.arange(len(a)) - head
        child = np.flatnonzero(place)
        parent = head[child] + (place[child] - 1) // FAN
        children = dict(dealt(home[child], [slot[child], first[child], last[child], home[parent], slot[parent], first[parent], dup[child].astype(np.uint8)]))
        group = runs_of(a)
        size = np.diff(np.append(group, len(a)))
        several = np.repeat(c[group] != c[np.append(group[1:], len(a)) - 1], size) if len(a) else dup
        w = np.flatnonzero(several & ~dup)
        wanted = dict(dealt(home[w], [slot[w], first[w], last[w], a[w]]))
        return pa.Table.from_batches([packed_rows(known + [(h, SAID, children.get(h), wanted.get(h)) for h in sorted({*children, *wanted})])])

    return by_bucket(rows, buckets).applyInArrow(run, ROW)


def blobs_of(table: pa.Table, column: str, kind: int) -> list:
    return [x.as_buffer() for x, k in zip(table.column(column), table.column("kind").to_pylist()) if k == kind and x.is_valid]


def first_pass(texts: DataFrame, said: DataFrame, buckets: int) -> DataFrame:
    """Each home answers: runs' bytes to the homes of whom they copy, contexts to their anchors' buckets."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        at = dict(zip(left.column("slot").to_pylist(), left.column("data").to_pylist()))
        out = [(key[0].as_py(), REMOVED, memoryview(x), None) for x in blobs_of(right, "one", REMOVED)]
        *child, gone = unpack(blobs_of(right, "one", SAID), CHILD)
        if len(gone):
            s, f, e, h, p, pf, _ = merged(*child)
            by = np.argsort(h, kind="stable")
            s, f, e, h, p, pf = (x[by] for x in (s, f, e, h, p, pf))
            begin = runs_of(h)
            for x, y in zip(begin, np.append(begin[1:], len(h))):
                data = b"".join(at[i][u : v + LENGTH] for i, u, v in zip(s[x:y].tolist(), f[x:y].tolist(), e[x:y].tolist()))
                out.append((int(h[x]), VERIFY, pack([p[x:y], pf[x:y], e[x:y] - f[x:y] + LENGTH]), data))
            g = np.flatnonzero(gone)
            if len(g):
                none = np.zeros(len(g), np.int64)
                s, f, e, *_ = merged(child[0][g], child[1][g], child[2][g], none, none, child[1][g])
                out.append((key[0].as_py(), REMOVED, pack([s, f, e]), None))
        slot, first, last, a = unpack(blobs_of(right, "two", SAID), WANTED)
        if len(slot):
            doc = dict(zip(left.column("slot").to_pylist(), left.column("doc_id").to_pylist()))
            bucket = (a % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            slot, first, last, bucket = slot[by], first[by], last[by], bucket[by]
            begin = runs_of(bucket)
            for x, y in zip(begin, np.append(begin[1:], len(slot))):
                own = slot[x:y].tolist()
                data = b"".join(at[i][u : v + LENGTH] for i, u, v in zip(own, first[x:y].tolist(), last[x:y].tolist()))
                cols = [np.array([doc[i] for i in own]), np.full(y - x, key[0].as_py()), slot[x:y], first[x:y], last[x:y] - first[x:y] + LENGTH]
                out.append((int(bucket[x]), CONTEXTS, pack(cols), data))
        return pa.Table.from_batches([packed_rows(out)])

    return texts.groupBy("home").cogroup(by_home(said)).applyInArrow(run, ROW)


def by_home(rows: DataFrame):
    return rows.withColumnRenamed("bucket", "home").groupBy("home")


def sort_contexts(rows: DataFrame, buckets: int) -> DataFrame:
    """Runs that the suffix sort has found to start earlier elsewhere, told to their homes."""

    def run(table: pa.Table) -> pa.Table:
        contexts, home, slot = [], [], []
        for blob, text in zip(table.column("one"), table.column("two")):
            doc, h, s, first, size = unpack([blob.as_buffer()], "qqqqq")
            ends = np.cumsum(size)
            raw = memoryview(text.as_buffer())
            contexts += [(raw[e - n : e], d, f) for e, n, d, f in zip(ends.tolist(), size.tolist(), doc.tolist(), first.tolist())]
            home.append(h)
            slot.append(s)
        home, slot = np.concatenate(home), np.concatenate(slot)
        spans = [stretches(dup) for dup in context_classes(contexts)]
        n = np.array([len(s) for s, _ in spans])
        first = np.repeat(np.array([c[2] for c in contexts]), n)
        none = [np.zeros(0, np.int64)]
        start, end = (np.concatenate([*none, *(s[k] for s in spans)]) + first for k in (0, 1))
        own = np.repeat(slot, n)
        return pa.Table.from_batches([packed_rows([(h, REMOVED, blob, None) for h, blob in dealt(np.repeat(home, n), [own, start, end])])])

    return by_bucket(rows.where(F.col("kind") == CONTEXTS), buckets).applyInArrow(run, ROW)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def second_pass(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The result of each text; first, other texts' runs are held against what they are said to copy."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        slots = left.column("slot").to_pylist()
        at = dict(zip(slots, left.column("data").to_pylist()))
        for blob, data in zip(blobs_of(right, "one", VERIFY), blobs_of(right, "two", VERIFY)):
            slot, first, size = (c.tolist() for c in unpack([blob], RUN))
            whole, end = data.to_pybytes(), 0
            for s, f, n in zip(slot, first, size):
                if at[s][f : f + n] != whole[end : end + n]:
                    raise ValueError(FALSE_PROPOSAL)
                end += n
        slot, first, last = unpack(blobs_of(right, "one", REMOVED), RUN)
        by = np.argsort(slot, kind="stable")
        slot, first, last = slot[by], first[by], last[by]
        out = []
        for s, doc, copies in zip(slots, left.column("doc_id").to_pylist(), left.column("copies").to_pylist()):
            x, y = np.searchsorted(slot, s), np.searchsorted(slot, s, "right")
            out += [(doc, len(at[s]), *kept(at[s], first[x:y], last[x:y]))] * copies
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], [c.split(" ")[0] for c in RESULT.split(", ")])

    return texts.groupBy("home").cogroup(by_home(rows)).applyInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, share_bytes: int = SHARE_BYTES, hot_share: float = HOT_SHARE, seeds: tuple[int, ...] = SEEDS, most_shares: int = MOST_SHARES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    share_bytes = max(share_bytes, -(-total // most_shares))
    buckets = max(8, -(-total // share_bytes))
    name = f"cairn_homes_{uuid.uuid4().hex}"
    # A table in buckets by home: the two passes over the texts read it where it is.
    homed(docs, share_bytes).write.format("parquet").option("path", scratch_path(spark, "homes")).option("compression", "zstd").bucketBy(buckets, "home").saveAsTable(name)
    try:
        texts = spark.table(name)
        for i, seed in enumerate(seeds):
            values = byte_values(seed)
            said = judge_anchors(anchor_rows(texts, buckets, values, hot_anchors(texts, buckets, values, hot_share)), buckets)
            answers = materialize(first_pass(texts, said, buckets), "answers")
            sorted_runs = sort_contexts(answers, buckets)
            try:
                result = materialize(second_pass(texts, answers.where(F.col("kind") != CONTEXTS).union(sorted_runs)), "repeats")
                break
            except PySparkException as error:
                if FALSE_PROPOSAL not in str(error) or i == len(seeds) - 1:
                    raise
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return result.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


#: Every string of LENGTH bytes by its digest, its first place, and runs of what starts later.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, h, unnest(range(n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH}),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS g FROM w),
f AS (SELECT g, min(doc_id::HUGEINT * 4294967296 + i) AS first FROM s GROUP BY g HAVING count(*) > 1),
dup AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s JOIN f USING (g) WHERE doc_id::HUGEINT * 4294967296 + i <> first),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM dup),
span AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span),
cut AS (SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS kept FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
