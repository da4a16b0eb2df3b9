import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyloom.llm import compression_quality, decontaminate, language_mixture, packing, personal_data, quality_rules, token_counts, wordhash
from surveyloom.llm.fm_index import FMIndex
from tests.llm import cases

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# word hashes


@given(st.lists(st.text(max_size=200), max_size=6))
def test_equal_words_have_equal_hashes(texts):
    for pattern, kind in ((ALNUM, wordhash.ALNUM), (SPACED, wordhash.SPACED)):
        found, counts = wordhash.word_hashes([t.encode(errors="replace") for t in texts], kind)
        words = [pattern.findall(low(t.encode(errors="replace").decode())) for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        flat = [w for own in words for w in own]
        assert len(set(flat)) == len(set(found.tolist())) == len(set(zip(flat, found.tolist(), strict=True)))


def test_long_words_differ():
    found, _ = wordhash.word_hashes([b"a" * 64 + b" " + b"a" * 65 + b" " + b"a" * 128 + b" " + b"a" * 64 + b"b" + b" " + b"b" + b"a" * 64], wordhash.SPACED)
    assert len(set(found.tolist())) == 5


# benchmark decontamination


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 8), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=8))
def test_fm_index_finds_what_is_there(symbols, sample, patterns):
    text = [*symbols, 0]
    index = FMIndex(np.array(text), 3, sample)
    matrix = np.zeros((len(patterns), 5), np.int64)
    for row, p in zip(matrix, patterns, strict=True):
        row[5 - len(p) :] = p
    start, end = index.search(matrix)
    for p, a, b in zip(patterns, start, end, strict=True):
        want = [i for i in range(len(text)) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def brute_hits(text, items):
    w = ALNUM.findall(low(text or ""))
    hit, names = set(), set()
    for name, t in items:
        own = ALNUM.findall(low(t or ""))
        for k in range(max(1, len(own) - 9) if own else 0):
            window = own[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    names.add(name)
                    hit.update(range(i, i + len(window)))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def benchmark_case(spark):
    rng = random.Random(5)
    passage = cases.words(rng, 25, prefix="p")
    items = [("1", " ".join(passage)), ("10", "Short Item, of-six words"), ("2", None), ("3", "..."), ("4", "alone"), ("null", "an item that has no id at all and is long enough"), ("5", " ".join(passage[:12]))]
    rows = [(100 + i, t, "en", "s", 0) for i, t in enumerate([
        "before " + " ".join(passage[3:15]).upper() + " after", " ".join(passage), " ".join(passage[:9]), "x short item of six words y short ITEM... of six words", "Alone! not alonely alone", " ".join(passage[:14] + ["gap"] + passage[14:]), "an item that has no id at all and is long enough",
    ])]
    docs, rows = cases.awkward(spark, 1, rows)
    bench = spark.createDataFrame([(None if n == "null" else int(n), t) for n, t in [*items, items[0]]], "item_id long, text string")
    return docs, rows, items, bench


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontamination(spark, block_bytes):
    docs, rows, items, bench = benchmark_case(spark)
    found = decontaminate.scan(docs, bench, block_bytes=block_bytes)
    got = sorted((cases.key((r["doc_id"], r["text"])), r["_n_words"], r["_n_hit"], len(r["_items"]), decontaminate.digest(r["_items"])) for r in found.collect())
    assert got == sorted((cases.key(r[:2]), *brute_hits(r[1], items)) for r in rows)
    assert found.columns[:-4] == docs.columns
    cut = decontaminate.cut(found)
    again = decontaminate.scan(cut.select("doc_id", "text"), bench).agg({"_n_hit": "sum"}).first()[0]
    assert again == 0
    untouched = {cases.key((r["doc_id"], r["text"])) for r in cut.where("_n_hit = 0").collect()}
    assert untouched == {cases.key(r[:2]) for r in rows if not brute_hits(r[1], items)[1]}
    kept = [r["text"] for r in cut.where("doc_id = 100").collect()]
    assert kept[0].split() == ["before", "after"]


def test_decontamination_of_nothing(spark):
    docs, rows = cases.awkward(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, none).agg({"_n_hit": "sum"}).first()[0] == 0
    assert decontaminate.scan(cases.empty(spark), none).count() == 0


# packing


def test_packing(spark):
    docs, rows = cases.awkward(spark, 2)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs).toPandas()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[str(i), k, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    ids = [str(None) if x != x else str(int(x)) for x in got["doc_id"]]
    assert Counter(zip(ids, got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    got = got.sort_values(["sequence_id", "offset"])
    end = got["offset"] + got["length"]
    assert (end.groupby(got["sequence_id"]).shift(1).fillna(0) == got["offset"]).all() and end.max() <= 4096
    assert packing.pack(cases.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_hold_every_piece_once(histogram):
    slots, n = packing.plan(histogram, 64, 8, 3)
    ranks, room = Counter(), Counter()
    for length, first, repeats, sequence, offset in slots:
        for k in range(repeats):
            ranks[length, first + k] += 1
            room[sequence + k] += length
            assert offset + length <= 64
    assert ranks == Counter({(length, k): 1 for length, m in histogram.items() for k in range(m)})
    assert len(room) == n and max(room.values(), default=0) <= 64
    assert n <= max(1, 2 * sum(k * v for k, v in histogram.items()) / 64 + 1)


def test_patterns_place_most_pieces_and_reach_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6.4, 0.8, 20_000).astype(int), 1, 4096)
    made = packing.Plan(Counter(lengths.tolist()))
    assert made.in_patterns > 0.5 * len(lengths)
    assert made.sequences <= 1.001 * -(-lengths.sum() // 4096) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzAÉéß '\u2019sStTrR.,;|<>-12\n\t\x1c\xa0×ñ中́e"), max_size=40), max_size=4), st.integers(4, 60))
def test_word_encoder_gives_the_tokenizers_ids(texts, block):
    from surveyloom.llm import word_encoder

    encoder = word_encoder.word_encoder(packing.tokenizer_path())
    before, word_encoder.BLOCK_BYTES = word_encoder.BLOCK_BYTES, block
    try:
        got = [x.tolist() for x in encoder.encode([t.encode() for t in texts])]
    finally:
        word_encoder.BLOCK_BYTES = before
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_takes_special_tokens_and_long_words():
    from surveyloom.llm import word_encoder

    encoder = word_encoder.word_encoder(packing.tokenizer_path())
    texts = ["a<|endoftext|>B <|ENDOFTEXT|> c<|", "x" * 40 + " " + "y" * 17 + " " + "x" * 40 + "z", ""]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_nnls():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((8, 20)), rng.random(8)
        x = packing.nnls(a, b)
        w = a.T @ (b - a @ x)
        assert x.min() >= 0 and w.max() < 1e-6 and np.abs(w[x > 0]).max(initial=0) < 1e-6


# token counts


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcé", max_size=14))
def test_automaton_counts_what_greedy_matching_cuts(pieces, text):
    i = n = 0
    while i < len(text):
        j = next((j for j in range(len(text), i, -1) if text[i:j] in pieces), None)
        n, i = (n + 1, j) if j else (n + len(text[i].encode()), i + 1)
    assert token_counts.Automaton(pieces).count(text) == n


def test_token_counts(spark):
    docs, rows = cases.awkward(spark)
    pieces = set(token_counts.pieces_of())
    longest = max(map(len, pieces))

    def greedy(word):
        i = n = 0
        while i < len(word):
            j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pieces), None)
            n, i = (n + 1, j) if j else (n + len(word[i].encode()), i + 1)
        return n

    want = sorted((cases.key((i,)), len(w), sum(greedy("▁" + x) for x in w)) for i, t, *_ in rows for w in [[x.decode() for x in (t or "").encode().split()]])
    got = sorted((cases.key((r["doc_id"],)), r["n_words"], r["n_tokens"]) for r in token_counts.count(docs).collect())
    assert got == want and token_counts.count(cases.empty(spark)).count() == 0


# quality


def labelled(spark, n=300):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        w = cases.words(rng, 80, 2000, "kind")
        docs.append((i, " ".join(w) if good else "!! ".join(x.upper() for x in w), "en", "s", 1))
        labels.append((i, int(good)))
    return docs, spark.createDataFrame([*labels, (None, 1), (5000, 0), (7, None), (8, 3), labels[0]], "doc_id long, quality int")


def test_compression_quality(spark):
    more, labels = labelled(spark)
    docs, rows = cases.awkward(spark, 3, [(1000 + r[0], *r[1:]) for r in more])
    labels = labels.selectExpr("doc_id + 1000 as doc_id", "quality")
    model = compression_quality.train(docs, labels.where("doc_id % 2 = 0"))
    found = compression_quality.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [(r["score"] >= 0.5, (r["doc_id"] - 1000) % 3 != 0) for r in found if (r["doc_id"] or 0) >= 1000 and r["doc_id"] % 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    one = compression_quality.train(docs, labels.where("quality = 1"))
    assert 0 <= one.score(b"") <= 1 and 0 <= compression_quality.train(cases.empty(spark), labels).score(b"text") <= 1
    assert compression_quality.score(cases.empty(spark), model).count() == 0


def test_compression_scores_by_hand(spark):
    """Dictionaries and coefficients are the model's; the sizes and the score are worked out again with the plain library."""
    import zstandard

    more, labels = labelled(spark)
    docs, rows = cases.awkward(spark, 3, [(1000 + r[0], *r[1:]) for r in more])
    model = compression_quality.train(docs, labels.selectExpr("doc_id + 1000 as doc_id", "quality"))
    assert model.used in compression_quality.COVARIATES

    def size(raw, text):
        d = zstandard.ZstdCompressionDict(raw)
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress(text[i : i + 2048])) for i in range(0, len(text), 2048))

    def by_hand(text):
        x = [0.0] * 4
        if text:
            good, bad = (size(raw, text) for raw in model.compressors.parts)
            x = [(bad - good) / len(text), min(good, bad) / len(text), (min(good, bad) / len(text)) ** 2, math.log(1 + len(text))]
        z = model.intercept + sum(model.slopes[j] * (x[j] - model.mean[j]) / model.scale[j] for j in range(4))
        return 1 / (1 + math.exp(-z))

    got = sorted(((str(r["doc_id"]), r["score"]) for r in compression_quality.score(docs, model).collect()))
    want = sorted((str(r[0]), by_hand((r[1] or "").encode())) for r in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 0.02 for (_, a), (_, b) in zip(got, want, strict=True))


def test_compression_learns_without_held_out_rows():
    rng = np.random.default_rng(0)
    y = np.array([0.0, 1.0] * 100)
    x = np.column_stack([y + rng.normal(0, 0.5, 200), rng.normal(0, 1, 200)])
    weight = np.ones(200)
    folds = [[i for i in range(200) if i % 5 == k] for k in range(5)]
    loss = 0.0
    for own in folds:
        rest = [i for i in range(200) if i not in own]
        w = compression_quality.logistic(x[rest], y[rest], weight[rest], ridge=1.0)
        for i in own:
            p = 1 / (1 + math.exp(-(x[i] @ w[:-1] + w[-1])))
            loss -= math.log(p if y[i] else 1 - p)
    assert abs(compression_quality._log_loss(x, y, weight) - loss / 200) < 1e-9


def brute_counts(t):
    t = t or ""
    w = SPACED.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_quality_rules(spark):
    rng = random.Random(6)
    junk = [(200 + i, " | ".join(cases.words(rng, 60)), "en", "s", 1) for i in range(40)]
    fine = [(300 + i, ". ".join(cases.words(rng, 120, 5000)), "en", "s", 1) for i in range(160)]
    twice = [(600, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z", "en", "s", 1)]
    docs, rows = cases.awkward(spark, 4, [*junk, *fine, *twice])
    found = quality_rules.judge(docs).collect()
    got = sorted((cases.key((r["doc_id"],)), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    assert got == sorted((cases.key(r[:1]), *brute_counts(r[1])) for r in rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
        if r["doc_id"] in range(200, 240):
            assert not r["kept"]
        if r["doc_id"] in range(300, 460):
            assert r["kept"]
    assert quality_rules.judge(cases.empty(spark)).count() == 0


def test_em_by_rows():
    """EM over counts of patterns is EM over rows, in plain Python."""
    rng = random.Random(2)
    rows = [[rng.choice([0, 1, 1, 1, 2]) for _ in range(3)] for _ in range(120)]
    counts = Counter(sum(v * 3 ** (2 - i) for i, v in enumerate(r)) for r in rows)
    q = [0.0 if 0 in r else 1.0 for r in rows]
    for _ in range(quality_rules.ROUNDS):
        hold = lambda x: min(0.99, max(0.01, x))
        prior, rates = hold((sum(q) + 5) / (len(rows) + 10)), []
        for k in range(3):
            own = [(r[k], p) for r, p in zip(rows, q, strict=True) if r[k] != 2]
            a = hold((sum(p for v, p in own if v) + 9.9) / (sum(p for _, p in own) + 10))
            b = hold((sum(1 - p for v, p in own if v) + 5) / (sum(1 - p for _, p in own) + 10))
            rates.append((a, min(a, b)))
        q = []
        for r in rows:
            good, bad = prior, 1 - prior
            for v, (a, b) in zip(r, rates, strict=True):
                good, bad = (good * a, bad * b) if v == 1 else (good * (1 - a), bad * (1 - b)) if v == 0 else (good, bad)
            q.append(good / (good + bad))
    got_prior, got = quality_rules.fit(counts, 3)
    assert abs(got_prior - prior) < 1e-9 and all(abs(x - y) < 1e-9 for a, b in zip(got, rates, strict=True) for x, y in zip(a, b, strict=True))


def test_em_matches_itself_by_rows():
    """EM over counts of patterns is EM over rows."""
    rng = random.Random(1)
    rows = [rng.randrange(27) for _ in range(200)]
    prior, accuracy = quality_rules.fit(Counter(rows), 3)
    again = quality_rules.fit({k: v for k, v in sorted(Counter(rows).items(), reverse=True)}, 3)
    assert again == (prior, accuracy) and quality_rules.fit({}, 2)[1] == [(0.99, 0.5)] * 2
    assert all(0 < quality_rules.posterior(quality_rules.votes_of(k, 3), prior, accuracy) < 1 for k in range(27))


# language


def test_language_mixture(spark):
    rng = random.Random(8)
    syllables = {"aa": ["tha", "er", "on", "ing"], "bb": ["sch", "ung", "üb", "kei"], "cc": ["ció", "ñas", "lla", "que"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    more = [(100 + i, make(lang, 40), lang, "s", 1) for i in range(150) for lang in [sorted(syllables)[i % 3]]]
    more += [(900, make("aa", 60) + " " + make("bb", 40), None, "s", 1), (901, "½ — 123", None, "s", 1)]
    docs, rows = cases.awkward(spark, 5, more)
    known = docs.where("doc_id >= 100 and doc_id % 2 = 0")
    model = language_mixture.train(known)
    assert model.names == ["aa", "bb", "cc"]
    found = language_mixture.identify(docs, model)
    by_id = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    assert found.count() == len(rows) and found.columns[:-3] == docs.columns
    tested = [r for r in more if r[2] and r[0] % 2]
    assert sum(by_id[r[0]]["_lang"] == r[2] for r in tested) / len(tested) > 0.98
    mixed = {x["lang"]: x["share"] for x in by_id[900]["_lang_set"]}
    assert by_id[900]["_lang"] == "aa" and set(mixed) == {"aa", "bb"} and 0.5 < mixed["aa"] < 0.7
    for i in (0, 1, 2, 901, 10):
        assert (by_id[i]["_lang"], by_id[i]["_lang_score"]) == ("und", 0.0)
    nothing = language_mixture.train(cases.empty(spark))
    assert {r["_lang"] for r in language_mixture.identify(docs, nothing).collect()} == {"und"}
    assert language_mixture.identify(cases.empty(spark), model).count() == 0


def many_languages(n):
    """Texts of ``n`` languages that share no letter: each has three Chinese characters of its own."""
    rng = random.Random(3)
    own = {f"l{i:02}": [chr(0x4E00 + 3 * i + j) for j in range(3)] for i in range(n)}
    return lambda lang, size: " ".join("".join(rng.choice(own[lang]) for _ in range(4)) for _ in range(size)), sorted(own)


def test_every_language_is_learned(spark):
    make, names = many_languages(70)
    rows = [(10 * i + j, make(lang, 30), lang, "s", 1) for i, lang in enumerate(names) for j in range(3 if i < 69 else 2)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    model = language_mixture.train(docs, train_bytes=1000)  # less than a text for each
    assert model.names == names
    texts = [make(lang, 20) for lang in names]
    assert model.name(texts)[0] == names
    evenly = model.name([" ".join(make(lang, 20) for lang in names[:5])])[2][0]
    assert {x["lang"] for x in evenly} == set(names[:5]) and all(0.15 < x["share"] < 0.25 for x in evenly)


def test_mixtures_of_any_size():
    make, names = many_languages(6)
    model = language_mixture.Languages({n: [make(n, 200)] for n in names})
    found = model.name([" ".join(make(n, 40) for n in names[:size]) for size in range(1, 7)])[2]
    assert [{x["lang"] for x in own} for own in found] == [set(names[:size]) for size in range(1, 7)]


def test_pipeline_keeps_mixtures(spark, tmp_path):
    import corpus_pipeline

    make, names = many_languages(3)
    rows = [(10 * i + j, make(n, 200), n, "s", 1) for i, n in enumerate(names) for j in range(5)]
    rows += [(100, " ".join(make(n, 40) for n in names), None, "s", 1), (101, "zqxj vkwq jjxz " * 20, None, "s", 1), (102, "123", None, "s", 1)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, cases.SCHEMA), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {101, 102}


def brute_mixture(model, text, rounds=6, penalty=3.0):
    """The language set of one text and its proportions, word by word in plain Python; the trigram tables are the model's."""
    data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
    k, words = len(model.names), []
    for w in data.split():
        padded = b" " + w + b" "
        keys = [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(w))]
        words.append([sum(float(model.table[key, j]) for key in keys) for j in range(k)])

    def em(langs, share, steps):
        for _ in range(steps):
            new = [0.0] * len(langs)
            for w in words:
                joint = [s * math.exp(w[j] - max(w)) for s, j in zip(share, langs, strict=True)]
                new = [a + b / sum(joint) for a, b in zip(new, joint, strict=True)]
            share = [a / len(words) for a in new]
        return share

    full = em(range(k), [1 / k] * k, rounds)
    order = sorted(range(k), key=lambda j: -full[j])
    single = [sum(w[j] for w in words) for j in range(k)]
    best = max(range(k), key=lambda j: single[j])
    score, chosen, grown = single[best], {best: 1.0}, 1
    for size in range(2, k + 1):
        if grown < size - 2:
            break
        langs = order[:size]
        share = em(langs, [(full[j] + 1e-9) / sum(full[i] + 1e-9 for i in langs) for j in langs], rounds // 2)
        likelihood = sum(max(w) + math.log(sum(s * math.exp(w[j] - max(w)) for s, j in zip(share, langs, strict=True))) for w in words)
        penalised = likelihood - penalty * (size - 1) * 0.5 * math.log(len(words) + 1) - (size - 1)
        if penalised > score:
            score, chosen, grown = penalised, dict(zip(langs, share, strict=True)), size
    return {model.names[j]: s for j, s in chosen.items()}


@pytest.mark.parametrize(("run_bytes", "block"), [(1 << 20, 64), (40, 64), (1 << 20, 2), (64, 3)])
def test_mixtures_word_by_word(monkeypatch, run_bytes, block):
    monkeypatch.setattr(language_mixture, "BLOCK", block)
    rng = random.Random(21)
    syllables = {"aa": ["tha", "er", "on", "ing"], "bb": ["sch", "ung", "üb", "kei", "er"], "cc": ["ció", "ñas", "lla", "que", "on"], "dd": ["sza", "er", "czy", "ing"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    model = language_mixture.Languages({n: [make(n, 300)] for n in syllables})
    texts = [make(a, rng.randint(1, 30)) + ", " + " ".join(make(b, rng.randint(0, 12)) for b in rng.sample(sorted(syllables), 2)) for a in syllables for _ in range(6)]
    shares, letters, fit, _ = model._estimate(texts, run_bytes=run_bytes)
    assert letters.all()
    for text, row in zip(texts, shares, strict=True):
        want = brute_mixture(model, text)
        got = {n: s for n, s in zip(model.names, row.tolist(), strict=True) if s > 0}
        assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-3 for n in want)


def test_scores_tell_how_sure_a_language_is():
    model = language_mixture.Languages({"aa": ["ab abab abb aab ab"], "bb": ["cd cdcd cdd ccd cd"]})
    _, scores, _, _ = model.name(["ab " * 40, "ab", "ab cd " * 20, "x"])
    assert scores[0] > 0.99 and scores[3] < scores[1] < scores[0] and scores[2] < 0.7


def test_em_raises_the_likelihood():
    model = language_mixture.Languages({"aa": ["ab ab abab"], "bb": ["cd cdcd cd"]})
    share, letters = model.estimate(["ab ab ab cd", "", None, "12", "ab"])
    assert letters.tolist() == [True, False, False, False, True] and share[4].tolist() == [1.0, 0.0] and share[1].sum() == 0


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    only = lambda s: re.sub("[^0-9]", "", s)

    def passes(d):
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if passes(only(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(only(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], personal_data.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text("0123456789..--++ ()@@ab%é", max_size=60))
def test_base_spans(text):
    assert personal_data.base_spans(text) == brute_spans(text)


def test_a_digit_run_is_scanned_once():
    assert personal_data.base_spans("7" * 300_000) == [] and personal_data.base_spans("a" * 300_000 + "@") == []


def people(rng, n):
    out = []
    for _ in range(n):
        digits = [rng.randrange(10) for _ in range(15)]
        check = (10 - sum(sum(divmod(d * 2, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))) % 10) % 10
        card = "".join(map(str, [*digits, check]))
        w = cases.words(rng, 30, 500, "k")
        w[5:5] = [f"ab{rng.randrange(99)}.x@mail{rng.randrange(9)}.example.com", "and", ".".join(str(rng.randrange(1, 255)) for _ in range(4))]
        w[15:15] = [card, "or", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
        out.append(" ".join(w))
    return out


def test_personal_data(spark):
    rng = random.Random(9)
    more = [(100 + i, t, "en", "s", 1) for i, t in enumerate(people(rng, 150))]
    clean = [(500 + i, " ".join(cases.words(rng, 60, 500, "k")) + " on 2024-01-02, v 1.2.3 for 10,000 of 12345", "en", "s", 1) for i in range(50)]
    docs, rows = cases.awkward(spark, 6, [*more, *clean])
    model = personal_data.train(docs)
    found = personal_data.find(docs, model)
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = sorted((cases.key(r[:1]), hashlib.sha256(text(brute_spans(r[1] or "")).encode()).hexdigest(), *[sum(s[0] == k for s in brute_spans(r[1] or "")) for k in personal_data.KINDS]) for r in rows)
    got = found.collect()
    assert sorted((cases.key((r["doc_id"],)), r["base_sha256"], *[r[f"n_{k}"] for k in personal_data.KINDS]) for r in got) == want
    by_id = {r["doc_id"]: r["spans"] for r in got}
    for r in more:
        assert set(text(brute_spans(r[1])).split(",")) <= set(by_id[r[0]].split(","))
    assert all(by_id[r[0]] == "" for r in clean)
    hidden = "k1 k2 ab12.x (at) mail3.example.com k3 k4"
    assert [s[0] for s in model.spans(hidden)[1]] == ["email"] and "[email]" in personal_data.redact(hidden, model.spans(hidden)[1])
    none = personal_data.train(cases.empty(spark))
    assert none.spans(more[0][1])[1] == brute_spans(more[0][1]) and personal_data.find(cases.empty(spark), model).count() == 0


def test_numbers_beside_others_are_proposed_alone():
    found = lambda t: {(k, t[a:b]) for k, a, b in personal_data.proposals(t)}
    assert ("phone", "555-123-4567") in found("room 12 555-123-4567") & found("2024-01-15 555-123-4567") & found("(12) 555-123-4567 99")
    assert ("card", "4111.1111.1111.1111") in found("order 1234 4111.1111.1111.1111") & found("4111.1111.1111.1111 12/27")
    assert ("phone", "+1 (555) 123-4567") in found("7 +1 (555) 123-4567") and ("ip", "10[.]1[.]2[.]3") in found("4,10[.]1[.]2[.]3")
    assert ("email", "ab@c.com") in found("ab@c.com. Next one") and ("email", "ab (at) c (dot) com") in found("ab (at) c (dot) com")
    assert len(personal_data.proposals("1 " * 20_000)) < 20_000 * 17 and personal_data.proposals("7" * 300_000) == []


def test_all_examples_are_learned_from(spark, monkeypatch):
    rng = random.Random(33)
    texts = [*people(rng, 60), "k1 k2 " + "a" * 400 + "@mail1.example.com k3", None]
    rows = {e for t in texts for e in personal_data._examples(t or "")}
    assert any(b - a > 400 for _, _, _, a, b in rows)  # a long span is an example too
    seen = []
    learn = personal_data.Model._learn
    monkeypatch.setattr(personal_data.Model, "_learn", lambda self, v, n, *more: seen.append((v, n)) or learn(self, v, n, *more))
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string").repartition(3)  # copies teach nothing more
    model = personal_data.train(docs, examples=40)  # fewer than there are of most kinds and sides
    vectors, counts = seen[-1]
    want = Counter(personal_data.vector(*row) for row in rows)
    assert {v.tobytes(): n for v, n in zip(vectors, counts.tolist(), strict=True)} == want and sum(want.values()) == len(rows) > 40 * 12
    no = {k: sorted((float(model.trees.probability(np.frombuffer(v[:-2], np.uint8)[None])[0]) for v, n in want.items() for _ in range(n) if v[-2:] == b"\x00\x00" and v[0] == i), reverse=True) for i, k in enumerate(personal_data.KINDS)}
    for kind in ("ip", "card", "phone"):  # thresholds count each counterexample of the other half
        assert len(no[kind]) >= 20 and model.least[kind] == np.nextafter(no[kind][int(len(no[kind]) * personal_data.MOST_WRONG)], 2.0)


def test_a_weight_is_so_many_rows():
    from surveyloom.llm.boosting import Boosted

    x = np.array([[i % 7, i % 5] for i in range(200)], float)
    y, n = (x[:, 0] > x[:, 1]).astype(float), 1 + np.arange(200) % 3
    many = Boosted(np.repeat(x, n, axis=0), np.repeat(y, n), np.ones(n.sum()))
    assert np.allclose(Boosted(x, y, n.astype(float)).probability(x), many.probability(x))


def test_thresholds_are_calibrated():
    rng = random.Random(21)
    rows = [e for t in people(rng, 400) for e in personal_data._examples(t)]
    model = personal_data.Model(rows)
    assert max(model.least.values()) <= 1.0 and model.least["phone"] < 0.95
    for t, want in [("k1 k2 room 12 555-123-4567 k3 k4", "555-123-4567"), ("k1 at 2024-01-15 555-123-4567 k3 k4", "555-123-4567")]:
        assert [(k, t[a:b]) for k, a, b in model.spans(t)[1]] == [("phone", want)]
    few = personal_data.Model([r for r in rows if r[0] != "ip"] + [r for r in rows if r[0] == "ip"][:12])  # a kind that is rare
    assert all(v <= 1.0 for v in few.least.values())


def hidden_forms(rng):
    """Personal data in forms that ``personal_data.rewritten`` doesn't make."""
    card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    card += next(d for d in "0123456789" if personal_data.luhn(card + d))
    parts, octets = [card[i : i + 4] for i in range(0, 16, 4)], [str(rng.randint(10, 255)) for _ in range(4)]
    a, b, c = rng.randint(200, 989), rng.randint(200, 989), rng.randint(1000, 9999)
    yield from (("card", x.join(parts)) for x in ("–", " - ", ",", "*"))
    yield from (("ip", x.join(octets)) for x in (" dot ", "[dot]", ":", "·"))
    yield from (("phone", x) for x in (f"{a}.{b}.{c}", f"({a}) {b} {c}", f"{a}/{b}-{c}", f"{a}–{b}–{c}"))
    name, host = f"ab.{rng.randint(1, 99)}", f"mail{rng.randint(1, 9)}"
    yield from (("email", x) for x in (f"{name} [at] {host}.example.com", f"{name}{{at}}{host}{{dot}}example{{dot}}com", f"{name} AT {host} DOT example DOT com", f"{name}&#64;{host}.example.org"))


def test_hidden_forms_are_found_and_clean_texts_left_alone():
    rng = random.Random(33)
    decoys = lambda: rng.choice([f"on {rng.randint(1900, 2099)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"id {rng.randint(10**6, 10**9)}", f"for {rng.randint(1, 9)},{rng.randint(100, 999)},{rng.randint(100, 999)}", f"v {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", ""])
    spelt = lambda t: re.sub(r"\bk([0-9]+)", lambda m: "k" + "".join(chr(97 + int(c)) for c in m[1]), t)
    plain = lambda: spelt(" ".join([*cases.words(rng, 20, 500, "kind of k"), decoys(), *cases.words(rng, 20, 500, "at k")]))
    rows = [e for t in [*map(spelt, people(rng, 500)), *(plain() for _ in range(500))] for e in personal_data._examples(t)]
    model = personal_data.Model(rows)
    clean = [plain() for _ in range(600)]
    assert sum(bool(model.spans(t)[1]) for t in clean) <= 6  # 1 %
    found = Counter()
    for t in clean[:120]:
        for kind, form in hidden_forms(rng):
            left = t[: len(t) // 2].rsplit(" ", 1)[0] + " k "
            _, spans = model.spans(left + form + " k " + t[len(t) // 2 :])
            found[kind, any(k == kind and a < len(left) + len(form) and b > len(left) for k, a, b in spans)] += 1
    assert all(found[k, True] >= 0.9 * (found[k, True] + found[k, False]) for k in personal_data.KINDS), found


def test_spans_are_chosen_best_first():
    """The choice among overlapping proposals, by comparing all pairs."""
    rng = random.Random(5)
    model = personal_data.Model([e for t in people(rng, 300) for e in personal_data._examples(t)])
    texts = [" ".join([rng.choice(["12", "2024-01-15", "k", "99"]), f, rng.choice(["7", "03/26", "k", "4111"])]) for _ in range(25) for _, f in hidden_forms(rng)] + people(rng, 30)
    some = 0
    for t in texts:
        base = brute_spans(t)
        left = [p for p in personal_data.proposals(t)]
        score = {p: float(model.trees.probability(np.array([personal_data.features(t, *p)]))[0]) for p in left}
        taken = list(base)
        while True:
            free = [p for p in left if score[p] >= model.least[p[0]] and not any(p[1] < b and a < p[2] for _, a, b in taken)]
            if not free:
                break
            taken.append(min(free, key=lambda p: (-score[p], p[1] - p[2], p[1], personal_data.KINDS.index(p[0]))))
        some += len(taken) > len(base)
        assert model.spans(t)[1] == sorted(set(taken), key=lambda s: (s[1], personal_data.KINDS.index(s[0]), s[2]))
    assert some > 50


def test_very_long_texts():
    rng = random.Random(12)
    model = personal_data.Model([e for t in people(rng, 100) for e in personal_data._examples(t)])
    whole = ("no data here, at all. " * 120_000) + "write to ab.c [at] mail.example.com"  # 2.6 MB
    assert [k for k, _, _ in model.spans(whole)[1]] == ["email"]
    digits = "12 345 " * 3000
    base, spans = model.spans(digits)
    assert all(b <= c for (_, _, b), (_, c, _) in zip(spans, spans[1:], strict=False)) and set(base) <= set(spans)
    words = np.ones(400_000, bool)
    text = b"ab \xc3\xa9 " * 200_000
    assert decontaminate.hit_runs(text, words) == [(0, 5 * 200_000 - 1)]
    some = words.copy()
    some[::2] = False
    assert len(decontaminate.hit_runs(text, some)) == 200_000
    long = language_mixture.Languages({"aa": ["ab abab abb aab ab"], "bb": ["cd cdcd cdd ccd cd"]}).name(["ab abab " * 400_000 + "cd " * 1000])  # 3.2 MB
    assert long[0] == ["aa"] and {x["lang"] for x in long[2][0]} == {"aa", "bb"}


def test_boosting_learns_a_rule():
    from surveyloom.llm.boosting import Boosted

    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((Boosted(x[:1000], y[:1000]).probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert Boosted(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3
