"""Ids of whole texts by a tokenizer that splits at white space: each distinct run of letters of a block is looked up once.

Runs are told apart in numpy. Bytes 1 to 8, bytes 9 to 16, the length and, of longer ones, a number of their own name a
run exactly; a hash of these only brings equal ones together. What a worker hasn't met before goes to the tokenizer many
words at a time.
"""

from __future__ import annotations

import os
import re

import numpy as np

from surveyloom.llm import wordhash

#: What a worker remembers the ids of at most.
REMEMBERED = 700_000
#: Bytes whose words are told apart at once. A longer text is cut for that, at white space only.
BLOCK_BYTES = 2 << 20
#: ASCII and Latin-1 letters in composed form: one run of letters to the tokenizer.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: White space, letters (and what may be one, or be taken with letters), all else.
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or b == 39 or chr(b).isalpha() else 2 for b in range(256)], np.uint8)
_CONTROL = np.array([b < 32 and not 9 <= b <= 13 or b in (39, 127) for b in range(256)])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for the tokenizer file at ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _odd(data: bytes, raw: np.ndarray) -> np.ndarray:
    """Places of what makes a word one that only the tokenizer can split: apostrophes, controls, special tokens, and all
    that is neither ASCII nor a Latin-1 letter.
    """
    found = [np.flatnonzero(_CONTROL[raw])]
    high = np.flatnonzero(raw >= 128)
    if len(high):
        b, before, after = raw[high], raw[high - 1], raw[high + 1]
        lead = (b == 0xC3) & (after >= 128) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
        found.append(high[~lead & ~((b < 0xC0) & (b != 0x97) & (b != 0xB7) & (before == 0xC3))])
    if b"<|" in data:
        found.append(np.array([m.start() for m in re.finditer(rb"<\|", data)], np.int64))
    return np.concatenate(found)


def _segments(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of what the tokenizer takes apart without looking at what stands around: runs of letters and of other
    characters; a word with anything odd is one segment. ``data`` begins and ends with white space.
    """
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    real = kind[edges] > 0
    start, stop = edges[real], np.append(edges[1:], len(data))[real]
    odd = _odd(data, raw)
    if len(odd) and len(start):
        heads = kind[start - 1] == 0
        word = np.cumsum(heads) - 1
        first = np.flatnonzero(heads)
        marked = np.zeros(len(first), bool)
        marked[np.searchsorted(start[first], odd, side="right") - 1] = True
        end = stop[np.append(first[1:], len(start)) - 1]
        whole = marked[word]
        kept = heads | ~whole
        start, stop = start[kept], np.where(whole, end[word], stop)[kept]
    return start, stop


def distinct_segments(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where each segment of ``data`` begins, which of the distinct ones it is, and these."""
    data = b" " + data + b" " * 16
    start, stop = _segments(data)
    if not len(start):
        return start, start, []
    size = stop - start
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    first = eight[start] & _FIRST[np.minimum(size, 8)]
    second = eight[start + 8] & _FIRST[np.clip(size - 8, 0, 8)]
    key = first * _MIX[0] ^ (second + size.astype(np.uint64)) * _MIX[1]
    long = np.flatnonzero(size > 16)
    if len(long):
        number: dict[bytes, int] = {}
        own = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)], np.uint64)
        first[long], second[long] = own, np.uint64(0)
        key[long] = own * _MIX[2]
    key ^= key >> np.uint64(29)
    order = np.argsort(key)
    key, first, second, kind = key[order], first[order], second[order], np.minimum(size, 17)[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (kind[1:] != kind[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    return start - 1, which, [data[a:b] for a, b in zip(start[one].tolist(), stop[one].tolist(), strict=True)]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u4")


class WordEncoder:
    """For tokenizers that split at white space and drop it (``word_bpe_49k.json``): ids of what stands between ASCII white
    space do not depend on what stands around.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")
        # A run of letters needs none of the normalisation and splitting that the others do, but for its case.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the ofstration élève ÉTÉ größe q naïveté internationalisation"
        if self.letters.encode(probe, add_special_tokens=False).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.letters = self.tokenizer
        self.known: dict[bytes, bytes] = {}

    def _each(self, new: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in new], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, new: list[bytes]) -> None:
        """A run of letters is one piece to the tokenizer, and only its last id ends a word: many are encoded as one text."""
        runs = [w for w in new if w.isalpha() or _RUN.fullmatch(w)]
        if len(runs) < len(new):
            other = list(set(new).difference(runs))
            self.known.update(zip(other, self._each(other), strict=True))
        parts = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        found = self.letters.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found, strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(part):
                raw, stops = ids.tobytes(), cuts.tolist()
                self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
            else:  # not a tokenizer of that kind
                self.known.update(zip(part, self._each(part), strict=True))

    def ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each segment of ``data`` begins, how many ids it has, and the ids of all."""
        start, which, segments = distinct_segments(data)
        if len(self.known) > REMEMBERED:  # frequent words are in any block of text
            self.known = {w: self.known[w] for w in segments if w in self.known}
        self._learn([w for w in segments if w not in self.known])
        own = list(map(self.known.__getitem__, segments))
        sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        table = np.frombuffer(b"".join(own), "<u4")
        begin = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        at = np.repeat(begin[which] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return start, counts, table[at]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as little-endian 32-bit numbers."""
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for t in texts:
            if len(t) > BLOCK_BYTES:
                out += self._together(held)
                held, size = [], 0
                out.append(joined([self._together([part])[0] for part in _cut(t)]))
                continue
            if size + len(t) > BLOCK_BYTES:
                out += self._together(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        return out + self._together(held)

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        # The tokenizer lower-cases; only its special tokens, matched before that, are told by case.
        data = b" ".join(texts)
        data = b" ".join([t if b"<|" in t else t.lower() for t in texts]) if b"<|" in data else data.lower()
        start, counts, ids = self.ids(data)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        last = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, np.cumsum(sizes))]
        return [ids[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


def _cut(text: bytes) -> list[bytes]:
    """Parts of about ``BLOCK_BYTES`` that end before white space; a longer word is in one part."""
    out, start = [], 0
    while len(text) - start > BLOCK_BYTES:
        m = _SPACE.search(text, start + BLOCK_BYTES)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]
