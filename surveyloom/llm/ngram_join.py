"""N-gram Jaccard join: sets in one global order, joined in prefix trees, linked into components.

A document's n-grams are ordered by one rule for all: rare before frequent (by counts over all documents' first n-grams),
then by hash. Two sets that are similar enough share one of their first ``n - ceil(0.8 n) + 1`` n-grams; most n-grams have
one document and go nowhere. What shared ones connect is a family, and links are only within families. Equal sets are one
class from the start.

Sets are searched in prefix trees: a probe walks a tree once, shares the overlap counted so far, and leaves subtrees whose
remaining lengths can't reach the bound, or whose sets are in its component already. What is found is a star for each
component, never all pairs. A family of bounded size is one tree, to which each of its sets is sent once. In a larger one:

1. sets with an equal least hash are searched together, in blocks of bounded size, under some hash functions;
2. blocks of sets of near sizes are searched in pairs, but for two blocks of the same component and for blocks whose sizes are
   too far apart. After that every two sets of a family are in one component, can't be linked by their sizes or have been
   compared, so no link between components is missed. Pairs are searched in rounds, so that the sets sent to them, of which
   there are more than the input has, never lie on disk together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import common, wordhash
from surveyloom.llm.components import components

WIDTH = 5
#: n-grams that more documents than this share among their first are ordered last, the most frequent of all at the end;
#: so many of them at most, then the bar is higher.
HOT, MOST_HOT = 3, 1 << 22
#: Counted are so many times the n-grams that are first by hash, because what is ordered last makes room for others.
COUNTED = 2
#: Classes of a family that is one tree, of a block of a larger one, and n-grams of the former in all.
FAMILY, BLOCK, FAMILY_NGRAMS = 1024, 256, 1 << 21
#: Postings of one n-gram that meet in one place; more frequent ones are dealt to several.
SALT_ROWS = 1 << 15
SEEDS = (1, 2)
SLICE_BYTES = 1 << 20
#: N-grams that are packed by bucket at a time, so that a bucket's row holds many however many buckets there are.
PACKED = 1 << 19
#: N-grams sent to pairs of blocks in a round: so many, or this part of all that there are.
ROUND, ROUND_SHARE = 1 << 24, 4
MOST_BITS = 1 << 28
_TOP, _MAYBE_BITS = np.uint64(1 << 63), 22


def needed(a: np.ndarray | int, b: np.ndarray | int):
    """Least common n-grams of sets of sizes a and b: 100 * common >= 80 * union."""
    return -(-4 * (a + b) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


class Order:
    """The global order: an n-gram's key is half its hash, or, if it is frequent, above all of those by its rank.

    What is frequent is told by the lower bits of the hash, as many as ``space`` (a power of two) has; the upper ones stay in the
    key, so that the keys of two n-grams are equal only if their hashes are.
    """

    def __init__(self, hot: np.ndarray, counts: np.ndarray, salt_rows: int = SALT_ROWS, space: int = 1 << 63):
        by = np.argsort(hot)
        self.mask, self.bits, self.salt_rows = np.uint64(space - 1), np.uint64(space.bit_length() - 1), salt_rows
        self.shift = np.uint64(63) - self.bits  # room for the upper bits
        self.hot, self.rank, self.by_rank = hot[by], by.astype(np.uint32), np.minimum(counts, (1 << 31) - 1).astype(np.int32)
        # Most n-grams are not frequent, which a small table tells of nearly all without a search.
        bits = max(_MAYBE_BITS, (8 * len(hot) - 1).bit_length())
        self.few = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.hot & self.few] = True

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        halves = hashes >> np.uint64(1)
        if not len(self.hot):
            return halves
        own = np.flatnonzero(self.maybe[halves & self.mask & self.few])
        short = halves[own] & self.mask
        at = np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)
        found = self.hot[at] == short
        own, at = own[found], at[found]
        out = halves.copy()
        out[own] = _TOP | self.rank[at].astype(np.uint64) << self.shift | halves[own] >> self.bits
        return out

    def salts(self, keys: np.ndarray) -> np.ndarray:
        """How many places the postings of each key are dealt to."""
        out = np.ones(len(keys), np.int64)
        frequent = keys >= _TOP
        out[frequent] = -(-self.by_rank[((keys[frequent] ^ _TOP) >> self.shift).astype(np.int64)] // self.salt_rows)
        return out


def ngram_sets(texts: list[bytes], order: Order | None = None, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted keys of each text's distinct n-grams; a text of fewer words is one n-gram, one without words has none."""
    words, counts = wordhash.word_hashes(texts, wordhash.SPACED)
    windows = wordhash.window_hashes(words, width)
    if order is not None:
        windows = order.keys(windows)
    else:
        windows = windows >> np.uint64(1)
    out, start = [], 0
    for n in counts.tolist():
        if n >= width:
            own = np.sort(windows[start : start + n - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            whole = wordhash.mix(wordhash.window_hashes(words[start : start + n], n) + np.uint64(n * 7919))
            out.append(order.keys(whole) if order is not None else whole >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def set_ids(keys: np.ndarray, shared: frozenset[int] = frozenset()) -> tuple[int, int]:
    """The set's id, and another 64 bits that tell sets of one id apart; an id in ``shared`` is known to be that of several."""
    digest = hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
    one, two = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
    return (one ^ two if one in shared else one), two


def _packed(buckets: np.ndarray, columns: list[np.ndarray], narrow: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of each bucket, as bytes of each column."""
    if not len(buckets):
        return
    by = np.argsort(buckets, kind="stable")
    buckets, columns = buckets[by], [c[by] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(buckets)], strict=True):
        yield int(buckets[a]), [_narrowed(c[a:b]) if narrow else c[a:b].tobytes() for c in columns]


def _narrowed(a: np.ndarray) -> bytes:
    """Nothing if all are -1, two bytes each where they fit, else as they are."""
    if a.dtype == np.int32:
        return b"" if (a == -1).all() else a.tobytes()
    return (a.astype(np.uint16) if a.dtype == np.uint32 and a.max() < 1 << 16 else a).tobytes()


def _widened(raw: list[bytes], dtypes: list) -> list[np.ndarray]:
    """What ``_narrowed`` made, the first column being of eight bytes each."""
    n = len(raw[0]) // 8
    return [np.full(n, -1, t) if not r else np.frombuffer(r, np.uint16).astype(t) if len(r) == 2 * n else np.frombuffer(r, t) for r, t in zip(raw, dtypes, strict=True)]


def _by_bucket(batches: Iterator[pa.RecordBatch], dtypes: list) -> Iterator[list[np.ndarray]]:
    """Columns of each bucket, put together again; rows arrive sorted by bucket."""
    now, held = None, [[] for _ in dtypes]
    for batch in batches:
        for b, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != now and now is not None:
                yield [np.concatenate(h) for h in held]
                held = [[] for _ in dtypes]
            now = b
            for h, r in zip(held, _widened(raw, dtypes), strict=True):
                h.append(r)
    if now is not None:
        yield [np.concatenate(h) for h in held]


def frequent_ngrams(docs: DataFrame, buckets: int, hot_from: int = HOT, salt_rows: int = SALT_ROWS) -> Order:
    """Counts of what is first by hash alone, and as much again, over all documents; the most frequent, ``MOST_HOT`` at most, come to the driver.

    An n-gram is counted by 32 bits of its hash and those that name its bucket (``buckets`` is a power of two): four bytes in its
    bucket. Each run of slices sends it once, with its count if it is there more often.
    """
    space = buckets << 32

    def packed_counts(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        short, n = np.unique(np.concatenate(keys) & np.uint64(space - 1), return_counts=True)
        bucket, rest = (short & np.uint64(buckets - 1)).astype(np.int64), (short >> np.uint64(buckets.bit_length() - 1)).astype(np.uint32)
        for several in (False, True):
            own = (n > 1) == several
            rows = list(_packed(bucket[own], [rest[own], n[own].astype(np.uint32)]))
            if rows:
                counts = [r[1] if several else b"" for _, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([r[0] for _, r in rows], pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "keys", "counts"])

    @common.gives_back
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for part in (part for batch in batches for part in common.slices(batch, "text", SLICE_BYTES)):
            own = [s[: COUNTED * prefix_length(len(s))] for s in ngram_sets(common.text_bytes(part.column("text"))) if len(s)]
            held += own and [np.concatenate(own)]
            total += sum(map(len, own))
            if total >= PACKED:
                yield from packed_counts(held)
                held, total = [], 0
        if held:
            yield from packed_counts(held)

    @common.gives_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(bucket: int, keys: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
            values, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(n), len(values)).astype(np.int64)
            hot = total > hot_from
            return pa.RecordBatch.from_arrays([pa.array(values[hot].astype(np.int64) * buckets + bucket), pa.array(total[hot])], names=["key", "n"])

        now, keys, n = -1, [], []
        for batch in batches:
            for bucket, raw, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and keys:
                    yield summed(now, keys, n)
                    keys, n = [], []
                now = bucket
                keys.append(np.frombuffer(raw, np.uint32))
                n.append(np.frombuffer(counts, np.uint32) if counts else np.ones(len(keys[-1]), np.uint32))
        if keys:
            yield summed(now, keys, n)

    packed = common.long_rows(docs).mapInArrow(first, "bucket int, keys binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = common.materialize(packed.mapInArrow(count, "key long, n long"), "ngram-counts")
    bar, total = hot_from, 0
    # k different counts need k * (k + 1) / 2 occurrences, so they are few; a limit would have every task make room for as many rows as it names.
    for n, tokens in sorted(counts.groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):
        total += tokens
        if total > MOST_HOT:
            bar = n
            break
    top = counts.where(F.col("n") > bar).toArrow()
    common.discard(counts)
    by = np.lexsort((top["key"].to_numpy(), top["n"].to_numpy()))
    return Order(top["key"].to_numpy()[by].astype(np.uint64), top["n"].to_numpy()[by], salt_rows, space)


def _stars(key: np.ndarray, salt: np.ndarray, cls: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, key) edges from the least class of each n-gram's postings to the others; key is 0 where these are all of its postings.

    Classes that no other can match by size and place are left out, where that is cheap to tell.
    """
    by = np.lexsort((cls, salt, key))
    key, salt, cls, n, place = key[by], salt[by], cls[by], n[by], place[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (cls[1:] != cls[:-1])  # equal sets are one class
    key, salt, cls, n, place = key[new], salt[new], cls[new], n[new].astype(np.int64), place[new].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    rest = n - place
    two = start[(size == 2) & (salt[start] < 0)]
    two = two[np.minimum(rest[two], rest[two + 1]) >= needed(n[two], n[two + 1])]
    a, b, k = [cls[two]], [cls[two + 1]], [np.zeros(len(two), np.int64)]
    for i, m in zip(start.tolist(), size.tolist(), strict=True):
        salted = bool(salt[i] >= 0)
        if m < 3 and not salted:
            continue
        own = cls[i : i + m]
        if m <= BLOCK and not salted:
            left, sizes = rest[i : i + m], n[i : i + m]
            fits = np.minimum.outer(left, left) >= needed(sizes[:, None], sizes[None, :])
            np.fill_diagonal(fits, False)
            own = own[fits.any(axis=1)]
        if len(own) > salted ^ 1:
            a.append(np.full(len(own), own[0]))
            b.append(own)
            k.append(np.full(len(own), key[i].view(np.int64) if salted else 0))
    edges = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b), np.concatenate(k)]), axis=0)
    return edges[:, 0], edges[:, 1], edges[:, 2]


class Tree:
    """Prefix tree of ordered sets: nodes are runs of the sorted sets, edges the n-grams that a run shares."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())  # big-endian bytes sort as the keys do
        self.sets = [sets[i] for i in self.order]
        self.sizes = [len(s) for s in self.sets]
        self.root = self._build()

    def _common(self, a: int, b: int, start: int) -> int:
        x, y = self.sets[a], self.sets[b]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[start:m] != y[start:m])
        return start + int(differ[0]) if len(differ) else m

    def _build(self) -> tuple:
        """The root: (depth before, depth after, first, end, least size, largest size, children). Sets that hold each other nest as deep
        as there are sets, so the stack is a list: runs are split on the way down and put together on the way up.
        """
        done: list[tuple] = []
        stack: list[tuple[int, int, int, int, int]] = [(0, len(self.sets), 0, -1, 0)]  # first, end, depth; depth after and children, once split
        while stack:
            low, high, depth, after, n = stack.pop()
            if high - low == 1:
                done.append((depth, self.sizes[low], low, high, self.sizes[low], self.sizes[low], ()))
            elif after < 0:
                after, i, parts = self._common(low, high - 1, depth), low, []
                while i < high:
                    j = i + 1
                    if self.sizes[i] > after:
                        head = self.sets[i][after]
                        while j < high and self.sets[j][after] == head:
                            j += 1
                    parts.append((i, j, after, -1, 0))
                    i = j
                stack.append((low, high, depth, after, len(parts)))
                stack += parts[::-1]
            else:
                children = tuple(done[-n:])
                del done[-n:]
                done.append((depth, after, low, high, min(c[4] for c in children), max(c[5] for c in children), children))
        return done[0]

    def links(self, component: list[int]) -> list[int]:
        """``component`` with the components of linked sets joined. Pairs that are joined already are not compared."""
        names, label = np.unique(np.array([component[i] for i in self.order], np.int64), return_inverse=True)
        for i, x in enumerate(self.sets):
            size = len(x)
            stack = [(self.root, 0)]
            while stack:
                (before, after, low, high, least, largest, children), overlap = stack.pop()
                if high <= i + 1 or 5 * min(size, largest) < 4 * max(size, least):
                    continue  # seen from the other side, or of no fitting size
                if (label[max(low, i + 1) : high] == label[i]).all():
                    continue
                bound = int(needed(size, least))
                if after > before:
                    edge = self.sets[low][before:after]
                    past = int(np.searchsorted(x, edge[0]))
                    if overlap + min(largest - before, size - past) < bound:
                        continue
                    rest = x[past:]
                    at = np.searchsorted(rest, edge)
                    at[at == len(rest)] = 0
                    overlap += int((rest[at] == edge).sum()) if len(rest) else 0
                    past = int(np.searchsorted(x, edge[-1], side="right"))
                    if overlap + min(largest - after, size - past) < bound:
                        continue
                if high - low == 1:
                    if 100 * overlap >= 80 * (size + self.sizes[low] - overlap):
                        label[label == label[low]] = label[i]
                else:
                    stack += [(c, overlap) for c in children]
        out = np.empty(len(label), np.int64)
        out[self.order] = names[label]
        return out.tolist()


def link_blocks(items: DataFrame, order=None) -> DataFrame:
    """(a, b) edges: for each item, each class and the least class of its component, where the trees' search joined them.

    ``items``: (item, cls, comp, keys), or with the broadcast ``order`` (item, cls, comp, text).
    """

    @common.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: dict[int, tuple[int, bytes]]) -> list[tuple[int, int]]:
            cls = list(rows)
            before = [c for c, _ in rows.values()]
            sets = [np.frombuffer(k, np.uint64) for _, k in rows.values()] if order is None else ngram_sets([t for _, t in rows.values()], order.value)
            after = Tree(sets).links(before)
            least: dict[int, int] = {}
            for c, old, new in zip(cls, before, after, strict=True):
                least[new] = min(least.get(new, c), c, old)
            # one edge for each old component that has been joined to another, and for each class to its component
            return sorted({(old, least[new]) for old, new in zip(before, after, strict=True) if old != least[new]} | {(c, least[new]) for c, new in zip(cls, after, strict=True) if c != least[new]})

        now, held = None, {}
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for item, cls, comp, held_as in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item != now:
                    edges += solve(held) if len(held) > 1 else []
                    now, held = item, {}
                held[cls] = (comp, held_as)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])
        edges = solve(held) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    held_as = F.col("keys") if order is None else F.col("text").cast("binary").alias("keys")
    return common.long_rows(items.select("item", "cls", "comp", held_as).repartition("item").sortWithinPartitions("item")).mapInArrow(run, "a long, b long")


def placed_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hot_from: int = HOT, salt_rows: int = SALT_ROWS, family_size: int = FAMILY, block: int = BLOCK, hot_rows: int = common.HOT_ROWS) -> DataFrame:
    """(doc_id, text_key, n, comp) for each row of ``docs``: a hash of its text, the size of its set, and its component's class, null without words."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)["doc_id"]
    buckets = 1 << (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    order = frequent_ngrams(docs.select("text"), buckets, hot_from, salt_rows)
    handle = spark.sparkContext.broadcast(order)  # MOST_HOT keys at most

    @common.gives_back
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                sets = ngram_sets(common.text_bytes(part.column("text")), handle.value)
                first = [s[: prefix_length(len(s))].tobytes() if len(s) else b"" for s in sets]
                ids = [set_ids(s) if len(s) else (None, None) for s in sets]
                cols = [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(c, pa.int64()) for c in zip(*ids, strict=True)], pa.array(first, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *cols], names=["doc_id", "text_key", "n", "cls", "other", "first"])

    described = common.long_rows(docs).mapInArrow(describe, f"doc_id {id_type}, text_key long, n long, cls long, other long, first binary")
    described = common.materialize(described, "ngram-sets")
    # Ids that several sets have: some in all at 10 ** 10 sets.
    twice = described.groupBy("cls").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b")
    shared = frozenset(r[0] for r in twice.select("cls").collect())
    if shared:
        described = described.withColumn("cls", F.when(F.col("cls").isin(list(shared)), F.col("cls").bitwiseXOR(F.col("other"))).otherwise(F.col("cls")))

    def postings(known: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
        arrays = [np.frombuffer(f, np.uint64) for _, f in known.values()]
        lengths = np.array([len(a) for a in arrays])
        key = np.concatenate(arrays)
        cls = np.repeat(np.array(list(known), np.int64), lengths)
        n = np.repeat(np.array([n for n, _ in known.values()], np.uint32), lengths)
        place = (np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
        times = handle.value.salts(key)
        salt = np.where(times > 1, (wordhash.mix(cls.view(np.uint64)) % times.astype(np.uint64)).astype(np.int64), -1).astype(np.int32)
        spot = wordhash.mix(key + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        packed = list(_packed((spot & np.uint64(buckets - 1)).astype(np.int64), [key, salt, cls, n, place], narrow=True))
        cols = [pa.array([b for b, _ in packed], pa.int32()), *[pa.array([r[i] for _, r in packed], pa.binary()) for i in range(5)]]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "key", "salt", "cls", "n", "place"])

    @common.gives_back
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, bytes]] = {}
        total = 0
        for batch in batches:
            for n, cls, first in zip(*(batch.column(c).to_pylist() for c in ("n", "cls", "first")), strict=True):
                if n and cls not in known:  # copies within a run of batches post once
                    known[cls] = (n, first)
                    total += len(first) // 8
            if total >= PACKED:
                yield postings(known)
                known, total = {}, 0
        if known:
            yield postings(known)

    @common.gives_back
    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _by_bucket(batches, [np.uint64, np.int32, np.int64, np.uint32, np.uint32]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _stars(*columns)], names=["a", "b", "key"])

    posted = described.select("n", "cls", "first").mapInArrow(post, "bucket int, key binary, salt binary, cls binary, n binary, place binary")
    stars = posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(star, "a long, b long, key long")
    stars = common.materialize(stars.distinct(), "ngram-stars")
    # The first n-grams are not read any more: only the rows stay.
    rows = common.materialize(described.select("doc_id", "text_key", "n", "cls"), "ngram-rows")
    made = [rows]  # what the last table makes superfluous
    common.discard(described)
    common.sweep(spark)
    dealt = stars.where("key <> 0 and a = b").select("key", "a")  # the roots of one n-gram's places are connected too
    across = dealt.join(dealt.groupBy("key").agg(F.min("a").alias("root")), "key").select("root", "a")
    family = components(stars.select("a", "b").union(across))

    def placed(labels: DataFrame) -> DataFrame:
        found = common.join_frequent(rows, labels.select(F.col("node").alias("cls"), "label"), "cls", common.frequent(rows, "cls", hot_rows), "left").select("doc_id", "text_key", "n", F.coalesce("label", "cls").alias("comp"))
        out = common.materialize(found, "ngram-placed")
        handle.unpersist()
        chosen.unpersist()
        common.discard(*made)
        common.sweep(spark)
        return out

    # The texts of classes that are in a family, from the least document of each, found by a bit table of their ids.
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least"), F.max("n").alias("n"))
    classes = classes.select("cls", "least.doc_id", "least.text_key", "n")
    wanted = common.materialize(classes.join(family.select(F.col("node").alias("cls"), F.col("label").alias("family")), "cls"), "ngram-wanted")
    bits = common.BitTable.of(wanted, "doc_id", MOST_BITS)
    chosen = spark.sparkContext.broadcast(bits)

    @common.gives_back
    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(pa.array(chosen.value.may_hold(batch.column("spot").to_numpy())))
            yield pa.RecordBatch.from_arrays(held.columns[:3], names=["doc_id", "text_key", "text"])

    @common.gives_back
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                sets = ngram_sets(common.text_bytes(part.column("text")), handle.value)
                least = [[int(wordhash.mix(s ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))).min().view(np.int64)) for seed in SEEDS] for s in sets]
                cols = [part.column("cls"), part.column("family"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(least, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["cls", "family", "keys", "least"])

    probe = bits.probed(docs.select("doc_id", "text_key", "text"), "doc_id", "spot")
    texts = common.long_rows(probe).mapInArrow(may_be, f"doc_id {id_type}, text_key long, text string")

    # A small family is searched whole. Texts travel, not sets, which are larger.
    small = wanted.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where((F.col("m") <= family_size) & (F.col("total") <= FAMILY_NGRAMS))
    members = wanted.select("cls", "doc_id", "text_key", "family").join(small.select("family", F.lit(True).alias("small")), "family", "left")
    mine = F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.text_key") == F.col("m.text_key"))
    whole = common.materialize(texts.alias("t").join(members.alias("m"), mine).select("cls", "family", "small", "text"), "ngram-families")
    made += [stars, wanted]
    common.sweep(spark)
    edges = common.materialize(link_blocks(whole.where("small").select(F.col("family").alias("item"), "cls", F.col("cls").alias("comp"), "text"), handle), "ngram-edges")
    rest = whole.where("small is null").select("cls", "family", "text")
    sets = common.materialize(common.long_rows(rest).mapInArrow(gather, "cls long, family long, keys binary, least array<long>").dropDuplicates(["cls"]), "ngram-large")
    made += [edges, sets]
    common.discard(whole)
    common.sweep(spark)
    large = sets.select("cls", "family")
    if not large.limit(1).collect():
        return placed(components(edges))

    # 1: those of a larger family that share a least hash. Sets of a family stay side by side, so that what they share packs well.
    spread = common.materialize(sets.select("family", "cls", F.posexplode("least").alias("seed", "value")), "ngram-spread")
    counts = spread.groupBy("seed", "value").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    salt = F.pmod(F.xxhash64("cls", "seed"), F.ceil(F.col("m") / block))
    likely = spread.join(counts, ["seed", "value"]).select("seed", F.xxhash64("seed", "value", salt).alias("item"), "family", "cls", F.col("cls").alias("comp"))
    for seed in range(len(SEEDS)):
        found = link_blocks(likely.where(F.col("seed") == seed).join(sets, ["family", "cls"]))
        made.append(common.materialize(found, "ngram-edges"))
        edges = edges.union(made[-1])
        common.sweep(spark)
    labels = components(edges)

    # 2: blocks of sets of near sizes in pairs. A component of many sets has blocks of its own, the others share theirs.
    named = large.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").select("cls", "family", F.coalesce("label", "cls").alias("comp"))
    named = common.materialize(named.join(wanted.select("cls", "n"), "cls"), "ngram-named")
    held = named.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= block).select("family", "comp", F.col("comp").alias("own"))
    named = named.join(held, ["family", "comp"], "left").withColumn("step", F.floor(F.log("n") / math.log(1.25)))
    sized = named.groupBy("family", "own", "step").agg(F.count(F.lit(1)).alias("m"))
    named = named.alias("c").join(sized.alias("s"), (F.col("c.family") == F.col("s.family")) & F.col("c.own").eqNullSafe(F.col("s.own")) & (F.col("c.step") == F.col("s.step")))
    place = F.xxhash64("c.family", F.coalesce("c.own", F.lit(0)), F.col("c.own").isNull(), "c.step", F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / block)))
    named = common.materialize(named.select("cls", "c.family", "comp", "c.own", "n", place.alias("block")), "ngram-blocks")
    blocks = common.materialize(named.groupBy("family", "block", "own").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("ngrams")), "ngram-block-list")
    others = blocks.select("family", *[F.col(c).alias(f"other_{c}") for c in ("block", "own", "least", "most", "ngrams")])
    near = "5 * least(most, other_most) >= 4 * greatest(least, other_least)"  # else no two sets of theirs are similar enough
    pairs = blocks.join(others, "family").where("block <= other_block and (own is null or other_own is null or own <> other_own)").where(near)
    pairs = common.materialize(pairs.select(F.xxhash64("block", "other_block").alias("item"), "block", "other_block", (F.col("ngrams") + F.col("other_ngrams")).alias("ngrams")), "ngram-pairs")
    made += [spread, named, blocks, pairs]
    sent, there = (df.agg(F.sum(c)).first()[0] or 0 for df, c in ((pairs, "ngrams"), (rows, "n")))
    rounds = max(1, -(-sent // max(ROUND, there // ROUND_SHARE)))
    ends = pairs.select("item", F.explode(F.array_distinct(F.array("block", "other_block"))).alias("block"))
    last = []
    for k in range(rounds):
        asked = named.select("family", "cls", "comp", "block").join(ends.where(F.pmod("item", F.lit(rounds)) == k), "block")
        last.append(common.materialize(link_blocks(asked.join(sets.select("family", "cls", "keys"), ["family", "cls"])), "ngram-edges"))
        common.sweep(spark)
    made += last
    found = reduce(DataFrame.union, last)
    if not found.limit(1).collect():
        return placed(labels)
    return placed(components(edges.union(found)))


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hot_rows: int = common.HOT_ROWS, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``.

    Words are what stands between space and U+0009 to U+000D after lower-casing A-Z; a set is the distinct runs of five, or
    the whole of a shorter text. Two sets are linked when 100 * common >= 80 * union; component_id is the smallest id that
    links reach. Null texts and texts without words have no set and are linked with nothing; their component is their id.
    Rows that repeat are one class; a null id is never the smallest, and a component of null ids only has a null one. An
    empty table gives an empty result. Columns other than id and text are not read.
    """
    placed = placed_rows(docs, text_col, id_col, hot_rows=hot_rows, **sizes)
    smallest = placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return common.join_frequent(placed, smallest, "comp", common.frequent(placed, "comp", hot_rows), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hot_rows: int = common.HOT_ROWS, **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay when of each component only the row with the least id (null last), then the least text hash, does.

    Of rows that repeat one stays; rows without words all stay. Columns are those of ``docs``. Only rows whose id may be one
    that goes, by a bit table, are joined with the ids that go; the others pass by.
    """
    placed = placed_rows(docs, text_col, id_col, hot_rows=hot_rows, **sizes)
    best = placed.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best"), F.count(F.lit(1)).alias("members"))
    members = common.join_frequent(placed, best.where("members > 1"), "comp", common.frequent(placed, "comp", hot_rows))
    gone = members.where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))))
    twice = members.where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))
    twice = twice.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(True).alias("_stays"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(False).alias("_stays")).distinct()
    touched = common.materialize(gone.unionByName(twice), "ngram-gone")
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    row_id, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    flagged = common.BitTable.of(touched, "_id").flag(own, row_id, "_may")
    clear = flagged.where(~F.col("_may")).select(*own.columns)
    asked = flagged.where("_may").withColumn("_text_key", F.xxhash64(text))
    joined = asked.join(touched, F.col("_id").eqNullSafe(F.col(row_id)) & (F.col("_key") == F.col("_text_key")), "left").where(F.coalesce("_stays", F.lit(True)))
    alone = F.when(F.col("_stays").isNull(), F.monotonically_increasing_id())  # only rows that are known to repeat are made one
    return clear.unionByName(joined.withColumn("_alone", alone).dropDuplicates([row_id, "_text_key", "_alone"]).select(*own.columns)).toDF(*names)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


OP6_SQL = f"""
with recursive d as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents
),
grams as (
    select distinct doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') as gram
    from (select doc_id, w, unnest(range(1, greatest(2, len(w) - {WIDTH - 2}))) as i from d where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common.n >= 80 * (x.n + y.n - common.n)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
least_of as (select a, min(b) as m from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
from d left join sizes on d.doc_id = sizes.doc_id left join least_of on d.doc_id = least_of.a
"""
