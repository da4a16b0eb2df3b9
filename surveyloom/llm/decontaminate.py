"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for every phrase of the test items.

A shard is a run of documents of about ``SHARD_BYTES`` of text, as an executor reads them. Its words are numbered by the
phrases' own vocabulary: a word that no phrase holds can be in no occurrence, so all such words are one separator. Runs
between separators that are shorter than the shortest phrase are left out of the index for the same reason. Phrases are
searched backwards through wavelet-tree ranks, occurrences located by sampled suffix positions, and their words merged
into removal spans. Documents are never shuffled; only the phrases travel, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm import common, wordhash
from surveyloom.llm.fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 16 << 20
PIECE_BYTES = 2 << 20
#: Text of the items that are searched in one pass; larger benchmarks take more passes.
BLOCK_BYTES = 4 << 20


class Phrases:
    """The distinct windows of a block of items, over their own vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        texts = [(t or "").encode() for _, t in items]
        words, counts = wordhash.word_hashes(texts, wordhash.ALNUM)
        self.vocabulary = np.unique(words)
        numbers = np.searchsorted(self.vocabulary, words) + 1
        windows: dict[tuple[int, ...], set[str]] = {}
        end = np.cumsum(counts)
        for (name, _), b, n in zip(items, end, counts, strict=True):
            own = numbers[b - n : b].tolist()
            for i in range(max(1, n - window + 1) if n else 0):
                windows.setdefault(tuple(own[i : i + window]), set()).add(name)
        keys = sorted(windows)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.matrix = np.zeros((len(keys), window), np.int64)
        for row, k in zip(self.matrix, keys, strict=True):
            row[window - len(k) :] = k
        self.names = sorted({name for own in windows.values() for name in own})
        place = {name: i for i, name in enumerate(self.names)}
        self.owners = [np.array(sorted(place[x] for x in windows[k]), np.int64) for k in keys]
        self.shortest = int(self.lengths.min()) if keys else 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _symbols(numbers: np.ndarray, counts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's sequence: runs of phrase words, each closed by one 0, and the place of each symbol among the shard's words."""
    n = len(numbers)
    ends = np.zeros(n + 1, bool)
    ends[np.concatenate([[0], np.cumsum(counts)])] = True
    inside = numbers > 0
    start = np.flatnonzero(inside & (ends[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stop = np.flatnonzero(inside & (ends[1:] | ~np.append(inside[1:], False))) + 1
    kept = stop - start >= shortest
    start, stop = start[kept], stop[kept]
    lengths = stop - start + 1
    at = np.repeat(start, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols = numbers[np.minimum(at, n - 1)] if n else np.zeros(0, np.int64)
    symbols[np.cumsum(lengths) - 1] = 0
    return symbols, at


def find(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[str]]]:
    """Words of each text, hit flag of each word of the shard, first word of each text, and the items found in each text."""
    numbers, counts, piece, size = [], [], [], 0
    for i, t in enumerate(texts):
        piece.append(t)
        size += len(t)
        if size >= PIECE_BYTES or i == len(texts) - 1:
            h, c = wordhash.word_hashes(piece, wordhash.ALNUM)
            numbers.append(phrases.numbers(h))
            counts.append(c)
            piece, size = [], 0
    words = np.concatenate([*numbers, np.zeros(0, np.int64)])
    per_text = np.concatenate([*counts, np.zeros(0, np.int64)])
    begins = np.cumsum(per_text) - per_text
    hit = np.zeros(len(words), bool)
    items: dict[int, list[str]] = {}
    if not len(phrases.lengths):
        return per_text, hit, begins, items
    symbols, at = _symbols(words, per_text, phrases.shortest)
    if not len(symbols):
        return per_text, hit, begins, items
    index = FMIndex(symbols, len(phrases.vocabulary))
    low, high = index.search(phrases.matrix)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    if not len(found):
        return per_text, hit, begins, items
    phrase = np.repeat(found, times)
    rows = np.repeat(low[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    place = at[index.locate(rows)]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + phrases.lengths[phrase], -1)
    hit = np.cumsum(edge[:-1]) > 0
    owner = np.searchsorted(begins, place, side="right") - 1
    pairs = np.unique(owner * np.int64(len(phrases.lengths)) + phrase)
    names: dict[int, set[int]] = {}
    for text, p in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist(), strict=True):
        names.setdefault(text, set()).update(phrases.owners[p].tolist())
    items = {k: [phrases.names[i] for i in sorted(v)] for k, v in names.items()}
    return per_text, hit, begins, items


def hit_runs(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the runs of hit words; the gaps between two hit words that follow each other are inside."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], wordhash.ALNUM[wordhash.LOWER[raw]], [False]])
    words = np.flatnonzero(inside[1:] != inside[:-1])  # begin and end of each in turn
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    return list(zip(points[words[2 * first]].tolist(), points[words[2 * last + 1]].tolist(), strict=True))


def _shards(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    held, texts, size = [], [], 0
    for batch in batches:
        for part in common.slices(batch, column, PIECE_BYTES):
            own = common.text_bytes(part.column(column))
            held.append(part)
            texts += own
            size += sum(map(len, own))
            if size >= SHARD_BYTES:
                yield held, texts
                held, texts, size = [], [], 0
    if texts:
        yield held, texts


_FOUND = "n_words long, spans array<struct<start: int, end: int>>, n_hit long, items array<string>"


def _scan(docs: DataFrame, phrases: Phrases, text: str) -> DataFrame:
    """``docs`` with the columns of _FOUND at its end; columns are c0, c1, ... whatever their names were."""
    text = f"c{docs.columns.index(text)}"
    docs = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    handle = docs.sparkSession.sparkContext.broadcast(phrases)  # at most BLOCK_BYTES of items' text
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(_FOUND).fields)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    @common.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for held, texts in _shards(batches, text):
            counts, hit, begins, items = find(texts, handle.value)
            total = np.concatenate([[0], np.cumsum(hit)])
            hits = total[begins + counts] - total[begins]
            spans = [[{"start": a, "end": b} for a, b in hit_runs(t, hit[s : s + n])] if h else [] for t, s, n, h in zip(texts, begins, counts, hits, strict=True)]
            names = [items.get(i, []) for i in range(len(texts))]
            done = 0
            for part in held:
                now = slice(done, done + part.num_rows)
                done += part.num_rows
                new = [pa.array(counts[now], pa.int64()), pa.array(spans[now], span), pa.array(hits[now], pa.int64()), pa.array(names[now], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return common.long_rows(docs).mapInArrow(run, schema)


def item_blocks(benchmark: DataFrame, text_col: str, id_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The distinct items, in blocks that hold about ``block_bytes`` of text each; a null id is named "null"."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield sorted((r[0], r[1]) for r in block.collect())


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, then ``_n_words``, ``_hit_spans``, ``_n_hit``, ``_items``.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A phrase is ten words of an item that
    follow each other, or the whole of a shorter item; an item without words has none. A word inside any occurrence of a
    phrase is hit; spans are code points of the runs of hit words. Null and empty texts have no words. Rows that repeat are
    reported each. Names in ``docs`` may be any but those four. An empty benchmark hits nothing.
    """
    own = list(docs.columns)
    out, passes = docs, 0
    for block in item_blocks(benchmark, item_text, item_id, block_bytes):
        found = _scan(out, Phrases(block), text_col)
        k = len(out.columns)
        c = [F.col(f"c{i}") for i in range(k + 4)]
        if not passes:
            cols = [*[c[i].alias(own[i]) for i in range(k)], c[k].alias("_n_words"), c[k + 1].alias("_hit_spans"), c[k + 2].alias("_n_hit"), c[k + 3].alias("_items")]
            out = found.select(*cols)
        else:
            cols = [c[i].alias(own[i]) for i in range(len(own))]
            spans = F.concat(c[k - 3], c[k + 1])
            out = found.select(*cols, c[k].alias("_n_words"), spans.alias("_hit_spans"), c[k + 2].alias("_n_hit"), F.array_union(c[k - 1], c[k + 3]).alias("_items"))
            out = _merge(out, text_col)
        passes += 1
        if passes > 1:
            out = common.materialize(out, "decontaminate")
    return out


def _merge(df: DataFrame, text: str) -> DataFrame:
    """Spans of several passes, merged where they meet; the hit words are counted again."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, hits = [], []
            for own, t in zip(batch.column("_hit_spans").to_pylist(), batch.column(text).to_pylist(), strict=True):
                merged: list[dict] = []
                words = [(m.start(), m.end()) for m in re.finditer("[0-9a-zA-Z\x80-\U0010ffff]+", t or "")] if own else []
                starts = np.array([a for a, _ in words], np.int64)
                marked = np.zeros(len(words), bool)
                for span in own:
                    marked[np.searchsorted(starts, span["start"]) : np.searchsorted(starts, span["end"])] = True
                for (a, b), m, before in zip(words, marked.tolist(), [False, *marked.tolist()][: len(words)], strict=True):
                    if m and before:
                        merged[-1]["end"] = b
                    elif m:
                        merged.append({"start": a, "end": b})
                spans.append(merged)
                hits.append(int(marked.sum()))
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols["_hit_spans"] = pa.array(spans, batch.schema.field("_hit_spans").type)
            cols["_n_hit"] = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.mapInArrow(run, schema)


def cut(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The result of ``scan`` with the hit spans cut out of the texts, a space in the place of each; nothing else changes."""
    names = df.columns
    c = F.col(text_col)
    kept = F.expr(
        f"""concat_ws(' ', transform(sequence(0, size(_hit_spans)), i -> substring(`{text_col}`,
            if(i = 0, 0, _hit_spans[greatest(i - 1, 0)].end) + 1,
            if(i = size(_hit_spans), char_length(`{text_col}`), _hit_spans[least(i, size(_hit_spans) - 1)].start)
            - if(i = 0, 0, _hit_spans[greatest(i - 1, 0)].end))))"""
    )
    return df.withColumn(text_col, F.when(F.col("_n_hit") > 0, kept).otherwise(c)).select(*names)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, common.table(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort("_items"), ",")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select distinct coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as w from benchmark where text is not null),
phrases as (
    select item, array_to_string(w[i : i + {WINDOW - 1}], ' ') as phrase, least(len(w), {WINDOW}) as n
    from (select item, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) as i from b where len(w) > 0)
),
sizes as (select distinct n from phrases),
windows as (
    select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as phrase
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
),
found as (select w.doc_id, w.i, w.n, p.item from windows w join phrases p on w.phrase = p.phrase and w.n = p.n),
hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits on d.doc_id = hits.doc_id left join items on d.doc_id = items.doc_id
"""
