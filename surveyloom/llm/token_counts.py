"""Token counts: greedy longest-match word pieces, counted by one pass of an automaton that never builds a piece.

The vocabulary is a trie. Each node has a failure link, to where matching goes on when no child fits, and the number of
tokens that are popped on the way; both come from the vocabulary alone. A word then costs one step for each character and,
in all, as many failure steps at most. A worker remembers the counts of words it has seen, up to ``REMEMBERED``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import common

REMEMBERED = 500_000
MARK = "▁"


class Automaton:
    """Counts the pieces that greedy longest match cuts a string into.

    A character that is no piece itself counts as its UTF-8 bytes, as byte fallback has it, unless a longer piece takes it.
    """

    def __init__(self, pieces: Iterable[str]):
        vocabulary = {p for p in pieces if p}
        cost = dict.fromkeys(vocabulary, 1)
        for c in {c for p in vocabulary for c in p}:
            cost.setdefault(c, len(c.encode(errors="replace")))
        self.children: list[dict[str, int]] = [{}]
        whole: list[int] = [0]  # cost of the piece that ends here, or 0
        for piece, n in cost.items():
            node = 0
            for c in piece:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    whole.append(0)
                node = nxt
            whole[node] = n
        self.fail, self.popped = [0] * len(whole), [0] * len(whole)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.children[u].items():
                    below.append(v)
                    if whole[v]:
                        self.fail[v], self.popped[v] = 0, whole[v]
                        continue
                    # Depth 1 is always whole, so u is not the root, and the root has every character of the vocabulary.
                    z, n = self.fail[u], self.popped[u]
                    while c not in self.children[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = self.children[z][c], n
            level = below

    def count(self, text: str) -> int:
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for c in text:
            nxt = children[node].get(c)
            while nxt is None and node:
                total += popped[node]
                node = fail[node]
                nxt = children[node].get(c)
            if nxt is None:
                total += len(c.encode(errors="replace"))
            else:
                node = nxt
        while node:
            total += popped[node]
            node = fail[node]
        return total


def pieces_of(name: str = "piece_bpe_32k.model") -> list[str]:
    """The pieces of a public sentencepiece file, without control, unknown and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_ready: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def counter(name: str) -> tuple[Automaton, dict[bytes, int]]:
    if name not in _ready:
        _ready[name] = Automaton(pieces_of(name)), {}
    return _ready[name]


def count(docs: DataFrame, name: str = "piece_bpe_32k.model", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words and n_tokens for each row. A word is what stands between ASCII white space, with the word mark before it.

    Null and empty texts have neither. Rows that repeat are counted each, ids may be null, other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = counter(name)
        for batch in batches:
            for part in common.slices(batch, "text"):
                n_words, n_tokens = [], []
                for text in common.text_bytes(part.column("text")):
                    words = text.split()
                    for w in set(words).difference(known):
                        known[w] = automaton.count(MARK + w.decode(errors="replace"))
                    n_words.append(len(words))
                    n_tokens.append(sum(map(known.__getitem__, words)))
                    if len(known) > REMEMBERED:
                        known.clear()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return common.long_rows(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count(common.table(spark, sf_dir, "documents"))
