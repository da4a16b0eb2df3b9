"""Personal data: high-recall generators propose spans, boosted trees judge them by format and context, thresholds choose.

Base spans are found by exact patterns and checks, and always stay. The generators also propose what the patterns miss:
addresses whose sign and dots are written otherwise, phones without a plus, cards and addresses with other separators; of a
run of digit groups, every part that has as many digits as the kind may have, so that a number beside other digits is proposed
alone too. No row is labelled, so the trees learn from what the checks say and from rewriting: base spans, as they are and
rewritten in their own context, are examples; proposals of the corpus that fail the checks (a wrong check digit, a part over
255, too few digits) and digit runs of other shapes are counterexamples, and so are parts of phones, and phones with digits
beside them. The threshold of each kind is the least score that keeps the share of counterexamples accepted, of a half that the
trees haven't seen, within ``MOST_WRONG``; those that overlap a real span only teach which of two overlapping spans is better.

All distinct examples of all documents are learned from. What the trees see of an example are small whole numbers, so the driver
gets each vector of them once, with the number of its examples: the trees and thresholds are those of all examples. So that no
kind and side outweighs the others, each weighs as many examples as ``EXAMPLES`` (a parameter) at most; thresholds count each
as one. Finding has no bounds but the kinds' own numbers of digits.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import common
from surveyloom.llm.boosting import Boosted

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 2000
#: Proposals of a text that are judged at a time, and examples that are sent at a time.
BATCH = 1 << 14
#: A feature above this is told as this.
MOST = 255
#: The side of what overlaps a real span and isn't it: the trees learn to rank it below, and no threshold is set by it.
PART = 2
MOST_WRONG = 0.002
CONTEXT = 24

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The look-behinds only skip starts inside a run of digits, from which the pattern cannot match when it fails from the run's first.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A run of what a local part may hold, and the sign after it; the part after is looked at only there.
AT = re.compile(r"@")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

#: What may stand for the sign, and after it for the dots; the words alone only together, and all with or without spaces around.
_SIGN = re.compile(r"(?P<bare>\x20(?:at|AT)\x20)|\x20?(?:@|&#64;|[(\[{<](?:at|AT|At)[)\]}>])\x20?")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?+"
_WIDE_DOMAIN = re.compile(rf"{_LABEL}(?:\x20?(?:\.|[(\[{{<](?:dot|DOT|Dot)[)\]}}>])\x20?{_LABEL}|\x20(?:dot|DOT)\x20{_LABEL})+")
_BARE_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\x20(?:dot|DOT)\x20|\.){_LABEL})+")
_LABELS = re.compile(_LABEL)
_DOTS = ("dot", "DOT", "Dot")
_GROUP = re.compile(r"[0-9]+")
#: Of each kind of number: what may stand between two groups, and least and most digits.
_MARKS = r"[\x20\xa0()./,:;_*|\u2010-\u2015\u00b7-]{1,3}"
_BETWEEN = {"ip": re.compile(r"\x20?[./,:;_*|\u2010-\u2015\u00b7-]\x20?|[(\[{](?:\.|dot)[)\]}]|\x20dot\x20"), "card": re.compile(_MARKS), "phone": re.compile(_MARKS)}
_WIDEST = 5
_DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][^A-Za-z0-9\n]{0,3}\Z"), re.compile(r"[^A-Za-z0-9\n]{0,3}[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    """What EMAIL finds, without rescanning each word of the text: from every @, the run before it and the domain after."""
    out, free = [], 0
    for m in AT.finditer(text):
        at = m.start()
        if at < free:
            continue
        start = at
        while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at)):
            out.append((start, d.end()))
            free = d.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that the exact patterns find and the checks pass, by start, then kind; a failing match is dropped, no other is tried in its place."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if _octets(m[0])]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _email_splits(text: str) -> Iterator[tuple[int, int]]:
    """From each sign, the run before it and the labels after it, up to each label from the second on."""
    free = 0
    for m in _SIGN.finditer(text):
        start = m.start()
        while start > free and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        domain = (_BARE_DOMAIN if m["bare"] else _WIDE_DOMAIN).match(text, m.end()) if start < m.start() else None
        if not domain or m["bare"] and not any(f" {d} " in domain[0] for d in _DOTS):
            continue
        free = m.end()
        ends = [x.end() for x in _LABELS.finditer(text, m.end(), domain.end()) if x[0] not in _DOTS]
        yield from ((start, e) for e in ends[1:])


def _number_splits(text: str, groups: list[tuple[int, int]], kind: str) -> Iterator[tuple[int, int]]:
    """Every run of adjacent digit groups that has as many digits as the kind may have; an address has four groups. What is
    glued to a letter is part of a name or a code.
    """
    least, most = _DIGITS[kind]
    alone = lambda a, b: not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum()
    between = _BETWEEN[kind].fullmatch
    joined = [0 < b - a <= _WIDEST and between(text, a, b) is not None for (_, a), (b, _) in zip(groups, groups[1:])]
    for i, (start, end) in enumerate(groups):
        if end - start < least and not (i < len(joined) and joined[i]):
            continue
        first, total, j = start, 0, i
        limit = most + 2 * (kind == "phone" and text.startswith("00", start))
        if kind == "phone":
            first -= first > 0 and text[first - 1] == "("
            first -= first > 0 and text[first - 1] == "+"
        while True:
            a, b = groups[j]
            total += b - a
            if total > limit or kind == "ip" and b - a > 3:
                break
            if (j - i == 3 if kind == "ip" else total >= least) and alone(first, b):
                yield first, b
            if j - i == 3 and kind == "ip" or j >= len(joined) or not joined[j]:
                break
            j += 1


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of all generators; they may overlap each other and the base's."""
    if _SIGN.search(text):
        yield from (("email", *p) for p in _email_splits(text))
    if DIGIT.search(text):
        groups = [m.span() for m in _GROUP.finditer(text)]
        for kind in ("ip", "card", "phone"):
            yield from ((kind, *p) for p in _number_splits(text, groups, kind))


def proposals(text: str) -> list[tuple[str, int, int]]:
    return list(proposed(text))


def cover(text: str, spans: list[tuple[str, int, int]]) -> bytearray:
    """1 at each character that a span holds: overlaps are then told without comparing spans pairwise."""
    out = bytearray(len(text))
    for _, a, b in spans:
        out[a:b] = b"\x01" * (b - a)
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, and of ``CONTEXT`` characters on either side; whole numbers up to ``MOST``."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = "".join(c for c in span if c in "0123456789")
    groups = re.findall("[0-9]+", span)
    parts = re.split(r"[^0-9]+", span) if kind == "ip" else []
    runs = len(set(digits))
    found = [
        float(KINDS.index(kind)), float(len(span)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(luhn(digits)) if digits else 0.0, float(len(parts) == 4 and all(p and int(p) <= 255 for p in parts)), float(span.startswith("+")), float("(" in span), float(span.count(" ")), float(span.count("-")), float(span.count(".")),
        float("@" in span), float(sum(c.isalpha() for c in span)), float(runs), float(bool(before) and before[-1].isalnum()), float(bool(after) and after[0].isalnum()),
        float(sum(c.isalpha() for c in before)), float(sum(c.isalpha() for c in after)), float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)), float(sum(c in "#$%&*|<>=" for c in before + after)),
        float(len(set(re.sub("[0-9]+", " ", span).split()) | set(c for c in span if c == " "))), float(len(set(map(len, groups)))),
        float(len(groups[0])) if groups else 0.0, float(len(groups[-1])) if groups else 0.0, float(bool(_DIGIT_BEFORE.search(before))), float(bool(_DIGIT_AFTER.match(after))),
    ]
    return [min(x, float(MOST)) for x in found] if len(span) > MOST else found


def rewritten(kind: str, span: str, seed: int) -> str:
    """A base span as people write it to get past a pattern."""
    if kind == "email":
        sign, dot = [(" (at) ", "."), ("[at]", "[dot]"), (" @ ", "."), ("(at)", "(dot)"), (" at ", " dot ")][seed % 5]
        local, _, domain = span.partition("@")
        return local + sign + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", ["[.]", "(.)", " . ", "-"][seed % 4])
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "card":
        mark = [".", "_", "/", "  ", ":"][seed % 5]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return ["00" + digits, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"1 ({a}) {b}-{c}"][seed % 5]


def _examples(text: str) -> Iterator[tuple[str, int, str, int, int]]:
    """(kind, 1, 0 or PART, context, start, end) of all examples and counterexamples in a text."""
    base = base_spans(text)
    cut = lambda a, b: (text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT])
    for kind, a, b in base:
        before, after = cut(a, b)
        yield kind, 1, before + text[a:b] + after, len(before), len(before) + b - a
        new = rewritten(kind, text[a:b], zlib.crc32(text[a:b].encode()))
        yield kind, 1, before + new + after, len(before), len(before) + len(new)
        if kind in ("card", "phone"):
            yield from _beside(kind, new, before, after, zlib.crc32(text[a:b].encode()) // 3)
    covered: bytearray | None = None
    for kind, a, b in proposed(text):
        if kind == "email":
            continue  # it has no checks to fail
        if covered is None:
            covered = cover(text, base)
        if 1 not in covered[a:b]:
            before, after = cut(a, b)
            failed = (kind == "ip" and not features(text, kind, a, b)[7]) or (kind == "card" and not features(text, kind, a, b)[6])
            plain = kind == "phone" and text[a:b].isdigit()
            if failed or plain:
                yield kind, 0, before + text[a:b] + after, len(before), len(before) + b - a
    for kind, a, b in base:  # the same contexts around digits that are no such thing
        if kind == "email":
            continue
        digits = "".join(c for c in text[a:b] if c in "0123456789")
        before, after = cut(a, b)
        for own, new in _impostors(kind, text[a:b], digits):
            yield own, 0, before + new + after, len(before), len(before) + len(new)


def _beside(kind: str, new: str, before: str, after: str, seed: int) -> Iterator[tuple[str, int, str, int, int]]:
    """A rewritten number beside a house number, year, date or expiry: the number alone is an example, other splits are not."""
    left = ["", f"{1 + seed % 98} ", f"{1950 + seed % 90} ", f"{1950 + seed % 90}-{1 + seed % 12:02}-{1 + seed % 28:02} ", f"{1000 + seed % 9000} "][seed % 5]
    right = ["", f" {1 + seed % 12:02}/{20 + seed % 20}", f" {1950 + seed % 90}", f" {1 + seed % 98}"][seed // 5 % 4]
    text, own = before + left + new + right + after, (len(before) + len(left), len(before) + len(left) + len(new))
    yield kind, 1, text, *own
    middle = left + new + right
    for other, a, b in proposals(middle):
        a, b = a + len(before), b + len(before)
        if (a, b) != own and b > own[0] and a < own[1] and not (other == "card" and luhn("".join(c for c in text[a:b] if c in "0123456789"))) and not (a > own[0] and b == own[1] and kind == "phone" and new.startswith("00")):
            yield other, PART, text, a, b


def _impostors(kind: str, span: str, digits: str) -> list[tuple[str, str]]:
    """What isn't personal though it looks like it: wrong check digits, parts over 255, dates, times, amounts, serial numbers."""
    d = (digits * 4)[:16]  # an address has four digits at least
    date, time = f"{1900 + int(d[:3]) % 200}", f"{int(d[3:5]) % 24:02}:{d[5]}0"
    month, day = f"{1 + int(d[6]) % 12:02}", f"{1 + int(d[7:9]) % 28:02}"
    out = [("phone", f"{date}{c}{month}{c}{day}") for c in "-./"] + [("phone", f"{day}{c}{month}{c}{date}") for c in "-./"]
    out += [("phone", f"{date}-{month}-{day} {time}"), ("phone", d[:8]), ("phone", d[:11]), ("phone", "00" + d[:14]), ("phone", f"{d[0]}.{d[1:3]}.{d[3:6]}"), ("phone", f"{d[:3]} {d[3:6]} {d[6:9]} {d[9:12]}"), ("phone", f"{d[:4]}-{d[4:8]}")]
    out += [("ip", f"{d[0]}.{d[1]}.{d[2]}.{3 + int(d[3:6]) % 997 + 256}"), ("ip", f"{d[0]},{d[1:4]},{d[4:7]},{d[7:10]}")]
    mixed = [f"{d[0]} {date}-{month}-{day} {d[1]}.{d[2]}.{d[3]} {d[4:6]}", f"{d[:2]} {d[2]}.{d[3]}.{d[4]} {d[5:7]} {d[7:12]}", f"{date}-{month}-{day} {d[1]}.{d[2]}.{d[3]} {d[4:6]}", f"{d[:3]} {date}/{month}/{day} {time[:2]} {d[9:13]}"]
    out += [(own, new) for own in ("phone", "card") for new in mixed]
    if kind == "ip":
        out.append(("ip", span.replace(".", "9.", 2)))
    wrong = d[:15] + str((int(d[15]) + 1 + int(d[0])) % 10)
    if not luhn(wrong):
        out += [("card", wrong), *[("card", c.join(wrong[i : i + 4] for i in range(0, 16, 4))) for c in "-. "]]
    return [(own, new) for own, new in out if not base_spans(new)]


def vector(kind: str, label: int, text: str, a: int, b: int) -> bytes:
    """All that is learned from an example: its features, its side, and whether it is of the half that the trees see."""
    return bytes([*map(int, features(text, kind, a, b)), label, zlib.crc32(text.encode(errors="replace")) % 2 == 0])


class Model:
    """The trees and a threshold for each kind; of a kind with few counterexamples it is that of all kinds together."""

    def __init__(self, rows: list[tuple[str, int, str, int, int]]):
        counts = Counter(vector(*row) for row in set(rows))
        self._learn(np.array([list(v) for v in sorted(counts)], np.uint8), np.array([counts[v] for v in sorted(counts)], np.int64))

    @staticmethod
    def of(vectors: np.ndarray, counts: np.ndarray, examples: int) -> Model:
        """From rows of ``vector``, each that of so many examples; of each kind and side they weigh as ``examples`` at most."""
        model = Model([])
        model._learn(vectors, counts, examples)
        return model

    def _learn(self, vectors: np.ndarray, counts: np.ndarray, examples: int | None = None) -> None:
        self.trees: Boosted | None = None
        self.least = dict.fromkeys(KINDS, 2.0)
        if not len(vectors):
            return
        x, label, half = vectors[:, :-2], vectors[:, -2], vectors[:, -1] == 1
        y, apart, weight = (label == 1).astype(float), label == 0, counts.astype(float)
        if len(set(y[half])) < 2:
            return
        if examples is not None:
            side = x[:, 0].astype(np.int64) * (PART + 1) + label
            total = np.bincount(side, weight, len(KINDS) * (PART + 1))
            weight *= np.minimum(1.0, examples / np.maximum(total, 1))[side]
        self.trees = Boosted(x[half], y[half], None if examples is None and (counts == 1).all() else weight[half])
        scores, n = self.trees.probability(x[~half]), counts[~half]
        for k, kind in enumerate(KINDS):
            no = apart[~half]
            own = no & (x[~half][:, 0] == k)
            own = own if n[own].sum() >= 20 else no
            by = np.argsort(-scores[own], kind="stable")
            above = np.cumsum(n[own][by])
            allowed = int(above[-1] * MOST_WRONG) if len(by) else 0
            bar = float(scores[own][by][np.searchsorted(above, allowed, side="right")]) if len(by) else 0.5
            self.least[kind] = float(np.nextafter(bar, 2.0))

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all: the base's and the accepted proposals that overlap none of the spans taken before, best first."""
        base = base_spans(text)
        new = proposed(text) if self.trees else iter(())
        covered: bytearray | None = None
        good: list[tuple[float, tuple[str, int, int]]] = []
        while own := list(islice(new, BATCH)):  # of a text of digits there are many, of which few are kept
            if covered is None:
                covered = cover(text, base)
            own = [p for p in own if 1 not in covered[p[1] : p[2]]]
            if own:
                scores = self.trees.probability(np.array([features(text, *p) for p in own]))
                good += [(s, p) for s, p in zip(scores.tolist(), own, strict=True) if s >= self.least[p[0]]]
        taken: list[tuple[str, int, int]] = []
        for _, p in sorted(good, key=lambda s: (-s[0], s[1][1] - s[1][2], s[1][1], KINDS.index(s[1][0]))):
            if 1 not in covered[p[1] : p[2]]:
                taken.append(p)
                covered[p[1] : p[2]] = b"\x01" * (p[2] - p[1])
        return base, ordered(base + taken) if taken else base


def train(docs: DataFrame, examples: int = EXAMPLES, text_col: str = "text") -> Model:
    """From all distinct examples in all documents; those of a kind and side weigh as ``examples`` at most."""
    docs = docs.select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.binary())], names=["example", "vector"])
        for t in (t for batch in batches for part in common.slices(batch, "text") for t in part.column(0).to_pylist()):
            for row in _examples(t or ""):
                name = hashlib.blake2b(f"{row}".encode(errors="replace"), digest_size=16).digest()
                if name not in held:
                    held[name] = vector(*row)
                if len(held) >= BATCH:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    found = common.long_rows(docs).mapInArrow(run, "example binary, vector binary").distinct()
    gathered = found.groupBy("vector").agg(F.count(F.lit(1)).alias("n")).orderBy("vector").toArrow()
    if not gathered.num_rows:
        return Model([])
    vectors = np.frombuffer(b"".join(gathered["vector"].to_pylist()), np.uint8).reshape(gathered.num_rows, -1)
    return Model.of(vectors, gathered["n"].to_numpy(), examples)


def find(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, counts of base spans, the base's digest, and all spans as text and their number, a row for each row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. Null and empty texts have none. Rows that
    repeat are told alike; ids may be null; columns other than id and text are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    handle = docs.sparkSession.sparkContext.broadcast(model)
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            rows = [handle.value.spans(t or "") for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            spans = [pa.array([joined(s) for _, s in rows], pa.string()), pa.array([len(s) for _, s in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, *spans], names=names)

    return common.long_rows(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced, named by the first."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs))
