"""Best-fit packing by patterns: few-document patterns of length classes, repeat counts by non-negative least squares.

The documents are tokenized and cut once; what the driver sees is the histogram of piece lengths, ``capacity`` numbers at
most whatever the size of the corpus. From it comes a plan: for each length, which ranks of its pieces go to which
sequences at which offset. Pieces get their ranks from per-task counts, so no task ever holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm import common
from surveyloom.llm.word_encoder import word_encoder

CAPACITY = 4096
#: Length classes of the patterns, documents in a pattern at most, and how often what is left is fitted again at most.
CLASSES, MOST_PARTS, FITS = 32, 6, 8
#: Share of the shorter classes' pieces that patterns leave for the room that is left in sequences.
RESERVE = 0.05


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each piece of each document: its ids, then ``end_id``; only what is longer than ``capacity`` is cut.

    ``task`` and ``nth``: the task that made the piece, and how many pieces of its length that task made before.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tail = np.array([end_id], "<u4").tobytes()
    id_type = pa.int64() if dict(docs.dtypes)["doc_id"] == "bigint" else None

    @common.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = word_encoder(tokenizer_path(name)).encode, TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                rows: list[tuple] = []
                for i, ids in enumerate(encode(common.text_bytes(part.column("text")))):
                    n = len(ids) + 1
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        crc = zlib.crc32(ids[start : start + length])
                        rows.append((i, k, start, length, zlib.crc32(tail, crc) if start + length == n else crc, task, int(made[length])))
                        made[length] += 1
                at, *cols = zip(*rows, strict=True)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                own = part.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [own if id_type is None else own.cast(id_type), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return common.long_rows(docs).mapInArrow(run, _PIECES.format(dict(docs.dtypes)["doc_id"]))


def patterns(means: list[float], slack: float, capacity: int = CAPACITY, parts: int = MOST_PARTS) -> list[tuple[int, ...]]:
    """All ways to fill the capacity, give or take ``slack``, with ``parts`` classes at most, larger first; ``means`` ascend."""

    def grow(left: float, most: int, n: int) -> Iterator[tuple[int, ...]]:
        if abs(left) <= slack:
            yield ()
        for c in range(most if n else -1, -1, -1):
            if means[c] * n < left - slack:
                return
            if means[c] <= left + slack:
                for rest in grow(left - means[c], c, n - 1):
                    yield (c, *rest)

    return [way for way in grow(float(capacity), len(means) - 1, parts) if way]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with x >= 0, by active sets."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active.append(j)
        while active:
            s = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[active] = s
                break
            old = x[active]
            falling = s <= 0
            step = np.min(old[falling] / np.maximum(old[falling] - s[falling], 1e-300))
            x[active] = old + step * (s - old)
            dropped = [i for i, v in zip(active, x[active], strict=True) if v <= 1e-12]
            if not dropped:
                dropped = [active[int(np.argmin(x[active]))]]
            x[dropped] = 0
            active = [i for i in active if i not in set(dropped)]
    return x


class Plan:
    """``slots``: (length, first rank, ranks, first sequence, offset) for all pieces; ``sequences``: their number.

    Length classes are told by their mean. Least squares fits the patterns' repeat counts to the histogram, and they are
    rounded down to what is there. Each pattern is filled with real lengths: the commonest of its classes, and for the last two
    the pair that fills the sequence best. What is left is fitted again, until no pattern is placed; then room in open
    sequences takes the longest pieces that fit, and what is still left is packed longest first.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, parts: int = MOST_PARTS):
        self.capacity, self.parts = capacity, parts
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.in_patterns = 0
        unit = -(-capacity // classes)
        self.classes = [(a, min(a + unit, capacity + 1)) for a in range(1, capacity + 1, unit)]
        self.slack = unit / 2
        reserve = np.array([RESERVE if c < len(self.classes) // 4 else 0.0 for c in range(len(self.classes))])
        self.kept = np.ceil(reserve * self._heights()).astype(np.int64)
        opened: list[tuple[list[int], int]] = []
        for _ in range(FITS):
            new = self._place()
            opened += new
            if not new:
                break
        self.in_patterns = sum(len(chosen) * n for chosen, n in opened)
        for chosen, n in sorted(opened, key=lambda o: sum(o[0])):
            self._close(chosen, n)
        while length := self._longest(capacity):
            n, most = int(self.left[length]), capacity // length
            self.left[length] = 0
            if n >= most:
                self._close([length] * most, n // most)
            if n % most:
                self._close([length] * (n % most), 1)

    def _heights(self) -> np.ndarray:
        return np.array([self.left[a:b].sum() for a, b in self.classes])

    def _longest(self, most: int) -> int:
        found = np.flatnonzero(self.left[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def _close(self, chosen: list[int], repeats: int) -> None:
        """``repeats`` sequences that begin with the chosen lengths, whose pieces are taken already."""
        room = self.capacity - sum(chosen)
        while length := self._longest(room):
            if self.left[length] < repeats:  # the first of them get one each, the others go on without
                some = int(self.left[length])
                self.left[length] = 0
                self._close([*chosen, length], some)
                repeats -= some
            else:
                each = min(room // length, int(self.left[length]) // repeats)
                self.left[length] -= each * repeats
                chosen = [*chosen, *[length] * each]
                room -= each * length
        place = 0
        for length in chosen:
            self.slots.append((length, int(self.used[length]), repeats, self.sequences, place))
            self.used[length] += repeats
            place += length
        self.sequences += repeats

    def _place(self) -> list[tuple[list[int], int]]:
        """One fit of patterns to what is left: the lengths chosen for each, and how often."""
        supply = np.maximum(0, self._heights() - self.kept)
        weights = [self.left[a:b] @ np.arange(a, b) for a, b in self.classes]
        means = [w / n if n else 0.0 for w, n in zip(weights, self._heights().tolist(), strict=True)]
        own = [c for c, m in enumerate(means) if m]
        ways = [tuple(own[c] for c in way) for way in patterns([means[c] for c in own], self.slack, self.capacity, self.parts)]
        if not ways:
            return []
        takes = np.zeros((len(means), len(ways)), np.int64)
        for j, way in enumerate(ways):
            np.add.at(takes[:, j], list(way), 1)
        long = np.array(means) / self.capacity  # a long piece that is left over costs more
        wanted = nnls(takes * long[:, None], supply * long)
        out = []
        for j in sorted(np.flatnonzero(wanted > 0), key=lambda j: ways[j], reverse=True):
            need = takes[:, j]
            repeats = int(min(wanted[j] + 1e-6, (supply[need > 0] // need[need > 0]).min()))
            supply -= repeats * need
            while repeats and (chosen := self._lengths(ways[j])):
                now = min(repeats, *(int(self.left[x]) // chosen.count(x) for x in chosen))
                for x in chosen:
                    self.left[x] -= now
                out.append((chosen, now))
                repeats -= now
        return out

    def _lengths(self, way: tuple[int, ...]) -> list[int]:
        """Lengths of the pattern's classes that fit together; none if there are none left."""
        chosen: list[int] = []
        room = self.capacity

        def there(c: int) -> np.ndarray:
            a, b = self.classes[c]
            own = self.left[a:b].copy()
            for x in chosen:
                if a <= x < b:
                    own[x - a] -= 1
            return own

        for i, c in enumerate(way[:-2]):
            own = there(c)
            least = sum(self.classes[d][0] for d in way[i + 1 :])
            own = own[: max(0, room - least - self.classes[c][0] + 1)]
            if not len(own) or own.max() <= 0:
                return []
            chosen.append(self.classes[c][0] + int(own.argmax()))
            room -= chosen[-1]
        first = there(way[-2]) if len(way) > 1 else np.array([1])
        second = there(way[-1])
        a = self.classes[way[-2]][0] + np.flatnonzero(first > 0) if len(way) > 1 else np.zeros(1, np.int64)
        b = self.classes[way[-1]][0] + np.flatnonzero(second > 0)
        if not len(a) or not len(b):
            return []
        at = np.searchsorted(b, room - a, side="right") - 1
        if len(way) > 1 and way[-2] == way[-1]:  # the one piece of a length isn't taken twice
            at = np.where((at >= 0) & (b[at] == a) & (second[b[at] - self.classes[way[-1]][0]] < 2), at - 1, at)
        total = np.where(at >= 0, a + b[at], -1)
        best = np.flatnonzero(total == total.max())
        if total.max() < 0:
            return []
        spare = second[b[at[best]] - self.classes[way[-1]][0]]
        if len(way) > 1:
            spare = np.minimum(spare, first[a[best] - self.classes[way[-2]][0]])
        k = best[spare.argmax()]  # of equally good pairs, the one that repeats most
        return [*chosen, *([int(a[k])] if len(way) > 1 else []), int(b[at[k]])]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, parts: int = MOST_PARTS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    made = Plan(histogram, capacity, classes, parts)
    return made.slots, made.sequences


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A null or empty text is its end id alone. Rows that repeat, and null ids, are packed each. An empty table gives an
    empty result. Columns other than id and text are not read.
    """
    found = common.materialize(pieces(docs, name, end_id, capacity, text_col, id_col), "pieces")
    # A table of tasks by lengths: ``capacity`` rows at most for each task.
    own = common.materialize(found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in own.groupBy("length").agg(F.sum("n")).collect()}
    order = sorted(plan(histogram, capacity)[0])
    lengths = np.array([s[0] for s in order], np.int64)
    first = np.array([s[1] for s in order], np.int64)
    sequence = np.array([s[3] for s in order], np.int64)
    offset = np.array([s[4] for s in order], np.int64)
    handle = docs.sparkSession.sparkContext.broadcast(((lengths << 45) + first, first, sequence, offset))  # some slots for each of ``capacity`` lengths
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = own.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(base.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, start, into, place = handle.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 45) + rank, side="right") - 1
            cols = [*batch.columns[:5], pa.array(into[at] + rank - start[at]), pa.array(place[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(found.dtypes)["doc_id"]
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
