"""Language ID by mixtures: EM estimates each document's language proportions from n-gram likelihoods of its words.

Each language has a table of byte-trigram log-probabilities; a word's likelihood is the product over its letters. A
document is a mixture of words from some languages; proportions come from EM, and of the sets {best}, {best two}, ... the
one with the best penalised likelihood is kept; sets grow until two sizes in a row bring no improvement. All documents of a
slice are estimated at once, in numpy, the tables searched in blocks of ``BLOCK`` languages; a text longer than a slice is
gone through in runs of words, again for each round, so memory is bounded by ``SLICE_BYTES`` times ``BLOCK``.

The tables come from a bounded sample of rows with a known language (``PER_LANGUAGE`` documents each, ``TRAIN_BYTES`` of
text in all, but one text of each language at least; parameters). Every language is learned, and every document is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm import common

PER_LANGUAGE = 1500
TRAIN_BYTES = 16 << 20
BLOCK = 64
BUCKETS = 1 << 16
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
#: Rounds of EM, and the weight of half the logarithm of the number of words for each language more.
ROUNDS, PENALTY = 6, 3.0

#: Letters stay; the bytes of non-ASCII characters count as letters; all else is one separator.
_LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, and the letters' places. ``data`` is letters and separators."""
    at = np.flatnonzero(data != 32)
    padded = np.concatenate([np.array([32], np.uint8), data, np.array([32], np.uint8)]).astype(np.uint32)
    key = padded[at] << np.uint32(16) | padded[at + 1] << np.uint32(8) | padded[at + 2]
    return (key * np.uint32(2654435761)) >> np.uint32(16), at


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and separators of all texts, each text closed by a separator, and where each begins; the last is the end."""
    raw = [(t or "").lower().encode(errors="replace") for t in texts]
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    return _LETTER[data], begins


class _Run:
    """A run of words of a slice: the text and the letters of each. Its trigrams are made anew whenever they are needed, but
    for the only run of a slice, whose likelihoods are kept.
    """

    def __init__(self, data: np.ndarray, begin: int, end: int, begins: np.ndarray):
        self.data, self.begin, self.end = data, begin, end
        _, at = _trigrams(data[begin:end])
        starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, np.int64)
        self.starts, self.letters = starts, np.diff(np.append(starts, len(at)))
        text = np.searchsorted(begins, at[starts] + begin, side="right") - 1
        self.first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
        self.texts = text[self.first]  # texts that have a word here, in order
        self.words = np.diff(np.append(self.first, len(text)))
        self.of = np.repeat(np.arange(len(self.texts)), self.words)

    def buckets(self) -> np.ndarray:
        return _trigrams(self.data[self.begin : self.end])[0]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each text's words here."""
        return np.add.reduceat(values, self.first, axis=0)


def _runs(data: np.ndarray, begins: np.ndarray, most: int) -> list[_Run]:
    """Runs of about ``most`` bytes that end at separators, one where there are less than twice as many; a longer word is in one run."""
    ends = [len(data)]
    if len(data) > 2 * most:
        gaps = np.flatnonzero(data == 32)
        ends = sorted({int(gaps[i]) + 1 for i in np.searchsorted(gaps, np.arange(most, len(data), most)).clip(max=len(gaps) - 1)} | {len(data)})
    found = [_Run(data, a, b, begins) for a, b in zip([0, *ends], ends, strict=False)]
    return [r for r in found if len(r.texts)]


class Languages:
    """Trigram tables of the learned languages."""

    def __init__(self, texts: dict[str, list[str]], smoothing: float = 0.2):
        self.names = sorted(texts)
        count = lambda n: np.bincount(_trigrams(_bytes(texts[n])[0])[0], minlength=BUCKETS)
        seen = sum((count(n) for n in self.names), np.zeros(BUCKETS))
        share = (seen + 1) / (seen.sum() + BUCKETS)  # what no language has seen is no evidence
        weight = smoothing * BUCKETS / 8
        self.table = np.empty((BUCKETS, len(self.names)), np.float32)  # a row for each bucket
        for j, n in enumerate(self.names):
            own = count(n)
            self.table[:, j] = np.log((own + weight * share) / (own.sum() + weight))

    def estimate(self, texts: list[str | None], rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages for each text (rows of 0 where nothing can be told), and whether it has a letter."""
        return self._estimate(texts, rounds, penalty)[:2]

    def _words(self, run: _Run, buckets: np.ndarray, languages: slice) -> np.ndarray:
        """Log-likelihood of each word of the run in the languages of the slice."""
        return np.add.reduceat(self.table[:, languages][buckets], run.starts, axis=0).astype(np.float64)

    def _among(self, run: _Run, live: np.ndarray, order: np.ndarray, held: np.ndarray | None, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of live texts: their texts, where each text begins, and likelihoods in the text's languages of ``order``."""
        mine = np.flatnonzero(live[run.texts][run.of])
        own = run.texts[run.of[mine]]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        if held is not None:
            return own, first, held[mine[:, None], order[own]]
        near = np.empty((len(mine), order.shape[1]))
        if len(mine):
            buckets, word = run.buckets(), np.repeat(np.arange(len(run.starts)), run.letters)
            for j in range(order.shape[1]):
                lang = order[run.texts[run.of], j]
                near[:, j] = np.add.reduceat(self.table[buckets, lang[word]], run.starts)[mine] - top[mine]
        return own, first, np.exp(near)

    def _estimate(self, texts: list[str | None], rounds: int = ROUNDS, penalty: float = PENALTY, run_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``estimate``; the mean log-probability of a trigram under the mixture (0 where nothing can be told); and how much
        more likely the set is than the best language that isn't its first one (log-likelihoods; infinite if there is none).
        """
        n, k = len(texts), len(self.names)
        out, fit, margin = np.zeros((n, k)), np.zeros(n), np.zeros(n)
        data, begins = _bytes(texts)
        runs = _runs(data, begins, run_bytes)
        if not runs or not k:
            return out, np.array([any(c.isalpha() for c in t or "") for t in texts], bool), fit, margin
        spans = [slice(a, a + BLOCK) for a in range(0, k, BLOCK)]
        kept = len(runs) == 1 and len(spans) == 1
        total, letters, ceiling, single = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, k))
        tops: list[np.ndarray] = []
        for run in runs:
            buckets, top = run.buckets(), np.full(len(run.starts), -np.inf)
            for own in spans:
                found = self._words(run, buckets, own)
                np.maximum(top, found.max(axis=1), out=top)
                single[run.texts, own] += run.sums(found)
            tops.append(top)
            ceiling[run.texts] += run.sums(top)
            total[run.texts] += run.words
            letters[run.texts] += run.sums(run.letters)
        held = np.exp(found - top[:, None]) if kept else None  # likelihoods, the best language's of each word as 1

        def joint(i: int, buckets: np.ndarray, share: np.ndarray, own: slice) -> np.ndarray:
            run = runs[i]
            near = held if kept else np.exp(self._words(run, buckets, own) - tops[i][:, None])
            return share[run.texts][:, own][run.of] * near

        best = np.argmax(single, axis=1)
        rows = np.arange(n)
        score = single[rows, best]
        likely, real = score.copy(), total > 0
        chosen = np.zeros((n, k))
        chosen[rows[real], best[real]] = 1
        cost = lambda size: penalty * (size - 1) * 0.5 * np.log(total + 1) + size - 1
        # No mixture is likelier than each word in its best language: where that doesn't pay for a second one, there is none.
        mixed = real & (ceiling - score > cost(2)) & (k > 1)
        full = np.zeros((n, k))
        full[mixed] = 1.0 / k
        for _ in range(rounds if mixed.any() else 0):
            new = np.zeros_like(full)
            for i, run in enumerate(runs):
                if not mixed[run.texts].any():
                    continue
                buckets = None if kept else run.buckets()
                whole, one = np.zeros(len(run.starts)), None
                for own in spans:
                    one = joint(i, buckets, full, own)
                    whole += one.sum(axis=1)
                scale = np.maximum(whole, 1e-300)[:, None]
                for own in spans:
                    one = one if len(spans) == 1 else joint(i, buckets, full, own)
                    new[run.texts, own] += run.sums(one / scale)
            full = np.where(mixed[:, None], new / np.maximum(total, 1)[:, None], 0.0)
        order = np.argsort(-full, axis=1, kind="stable")
        grown = np.where(mixed, 1, -2)  # the size that improved last
        for size in range(2, k + 1):
            live = (grown >= size - 2) & (ceiling - score > cost(size))
            if not live.any():
                break
            share = np.take_along_axis(full, order[:, :size], axis=1) + 1e-9
            share /= share.sum(axis=1, keepdims=True)
            only = self._among(runs[0], live, order[:, :size], held) if kept else None
            found = np.zeros(n)
            for step in range(rounds // 2 + 1):
                last = step == rounds // 2
                new, found = np.zeros_like(share), ceiling.copy()
                for i, run in enumerate(runs):
                    own, first, near = only or self._among(run, live, order[:, :size], None, tops[i])
                    if not len(own):
                        continue
                    one = share[own] * near
                    whole = np.maximum(one.sum(axis=1), 1e-300)
                    if last:
                        found[own[first]] += np.add.reduceat(np.log(whole), first)
                    else:
                        new[own[first]] += np.add.reduceat(one / whole[:, None], first, axis=0)
                if not last:
                    share = new / np.maximum(total, 1)[:, None]
            penalised = found - cost(size)
            took = np.flatnonzero(live & (penalised > score))
            score[took], likely[took], grown[took] = penalised[took], found[took], size
            chosen[took] = 0
            chosen[took[:, None], order[took, :size]] = share[took]
        out[real] = chosen[real]
        fit[real] = likely[real] / letters[real]
        other = single.copy()
        other[rows, out.argmax(axis=1)] = -np.inf
        margin[real] = likely[real] - other[real].max(axis=1)
        lettered = real.copy()
        for i in np.flatnonzero(real).tolist():  # a non-ASCII character need not be a letter
            if not texts[i].isascii():
                lettered[i] = any(c.isalpha() for c in texts[i])
        return out, lettered, fit, margin

    def name(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]], list[float]]:
        """Language, score, the chosen set with proportions, and the mean log-probability of a trigram, for each text.

        The score is the language's proportion times the probability that the set explains the text better than the best other
        language alone does; a letter is in three trigrams, so a third of the evidence counts.
        """
        shares, letters, fit, margin = self._estimate(texts)
        best = shares.argmax(axis=1) if len(self.names) else np.zeros(len(texts), int)
        sure = 1 / (1 + np.exp(-np.clip(margin / 3, -30, 30)))
        names, scores, sets = [], [], []
        for row, b, ok, p in zip(shares, best, letters, sure.tolist(), strict=True):
            if not ok or not len(self.names) or row.max() <= 0:
                names.append(UNKNOWN)
                scores.append(0.0)
                sets.append([])
            else:
                names.append(self.names[b])
                scores.append(float(min(1.0, row[b]) * p))
                sets.append([{"lang": self.names[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0])
        return names, scores, sets, fit.tolist()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, train_bytes: int = TRAIN_BYTES) -> Languages:
    """From rows with an id, a text and a language; which of them are in the sample depends on their ids alone."""
    ids = common.sample_ids(docs.where(F.col(text_col).isNotNull()).select(id_col, lang_col), lang_col, per_language, id_col, None)
    return Languages(common.fetch_texts(docs, ids, train_bytes, text_col, id_col, True))


def identify(docs: DataFrame, model: Languages, text_col: str = "text", fit_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, then ``_lang``, ``_lang_score`` and ``_lang_set``, and the mixture's fit as ``fit_col``.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learned. Rows that
    repeat are told alike; names in ``docs`` may be any but those three.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a number for each language
    extra = T._parse_datatype_string("_lang string, _lang_score double, _lang_set array<struct<lang: string, share: double>>" + (f", `{fit_col}` double" if fit_col else ""))
    schema = T.StructType(docs.schema.fields + extra.fields)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    @common.gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text_col, SLICE_BYTES):
                names, scores, sets, fit = handle.value.name(part.column(text_col).to_pylist())
                extra = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind), pa.array(fit, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra[: None if fit_col else 3]], names=schema.names)

    return common.long_rows(docs).mapInArrow(run, schema)


def op7_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.id_remainder("doc_id", 3) == 1, F.lit(False))
    model = train(docs.select("doc_id", "text", "lang").where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"), F.col("_lang_set").alias("languages"))
