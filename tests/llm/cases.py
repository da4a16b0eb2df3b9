"""Tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "n_hit string, rank int, shard string, cls double, line string, w int"


def words(rng: random.Random, n: int, vocabulary: int = 300, prefix: str = "w") -> list[str]:
    return [f"{prefix}{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(spark, seed: int = 0, more: list[tuple] = ()):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, odd characters, clashing columns."""
    rng = random.Random(seed)
    long = " ".join(words(rng, 30_000))
    texts = [None, "", " \n\t ", "one", "Ünï çödé 東京 ½ \x1c x y", long, "same text here " * 9, "same text here " * 9, "a\n\nb\n \nb", "x" * 5000, "!!! ### 123", "<|endoftext|> <|ENDOFTEXT|>"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id at all", None, None, None), (None, None, None, None, None), (3, "another text of the same id", "de", "s9", 4)]
    rows += list(more)
    extra = ("a", 1, "b", 2.0, "c", 3)
    names = SCHEMA + ", " + CLASH
    return spark.createDataFrame([(*r, *extra) for r in rows], names).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row: tuple) -> str:
    return repr(row)
