import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from surveyloom.llm import balanced_shards, common, line_dedup, ngram_join
from surveyloom.llm.components import components
from tests.llm import cases


def low(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# n-gram join


def brute_components(rows):
    """Per row: set size and class; per class: least id. Links by all pairs of distinct sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    distinct = sorted(set(s for s in sets if s), key=len)
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 5 * len(a) < 4 * len(b):
                break
            common_ = len(a & b)
            if 100 * common_ >= 80 * (len(a) + len(b) - common_):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[find(s)].append(i)
    return sorted((str(i), len(s), str((min(least[find(s)]) if least[find(s)] else None) if s else i)) for (i, _), s in zip(rows, sets, strict=True))


def near(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
    return w


def family(rng):
    base, passage = cases.words(rng, 80, 400), cases.words(rng, 14, 400)
    texts = [near(rng, base, rng.choice([0, 1, 1, 2, 4])) for _ in range(60)]
    for _ in range(25):
        w = cases.words(rng, rng.randint(3, 60), 400)
        texts += [w, w[:3] + passage + w[3:], near(rng, w, 1)] + [w] * rng.randrange(2)
    texts += [["a"], ["A"], ["a", "b"], ["a"] * 50, ["a"] * 60]
    return [(1000 + i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [{}, {"hot_rows": 2}, {"block": 4, "hot_from": 3, "salt_rows": 8, "family_size": 1}, {"block": 3, "hot_from": 1000, "family_size": 0}])
def test_ngram_join(spark, sizes):
    docs, rows = cases.awkward(spark, 7, family(random.Random(11)))
    found = ngram_join.join(docs, **sizes).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_components([r[:2] for r in rows])


def test_pairs_of_blocks_are_searched_in_rounds(spark, monkeypatch):
    """What is sent to pairs of blocks is bounded for a round, and blocks whose sizes are too far apart are no pair."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ngram_join, "ROUND", 1 << 10)
    monkeypatch.setattr(ngram_join, "ROUND_SHARE", 1)
    sent, search = [], ngram_join.link_blocks

    def counted(items, order=None):
        sent.append(0 if order else int(items.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0]) // 8)
        return search(items, order)

    monkeypatch.setattr(ngram_join, "link_blocks", counted)
    rows = family(random.Random(11))
    found = ngram_join.join(spark.createDataFrame(rows, cases.SCHEMA), block=3, hot_from=1000, family_size=0).collect()
    want = brute_components([r[:2] for r in rows])
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == want
    rounds, whole = sent[3:], sum(n for _, n, _ in want)  # after the small families' and those of the two seeds
    assert len(rounds) > 1 and max(rounds) < 2 * whole


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(cases.empty(spark)).count() == 0 and ngram_join.keep_one(cases.empty(spark)).count() == 0
    lonely = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1)], cases.SCHEMA)
    assert [tuple(r) for r in ngram_join.join(lonely).collect()] == [(1, 3, 1)]


@pytest.mark.parametrize("sizes", [{}, {"hot_rows": 2}])
def test_one_of_each_component_stays(spark, sizes):
    docs, rows = cases.awkward(spark, 8, family(random.Random(12)))
    kept = ngram_join.keep_one(docs, **sizes)
    assert kept.columns == docs.columns
    got = Counter((str(r["doc_id"]), r["text"]) for r in kept.collect())
    comps = defaultdict(list)
    sizes = brute_components([r[:2] for r in rows])
    by_row = defaultdict(list)
    for i, n, c in sizes:
        by_row[i].append((n, c))
    for r in rows:
        if not re.search(r"[^\x20\x09-\x0D]", r[1] or ""):
            assert got.pop((str(r[0]), r[1]), 1) >= 1
    for (i, _), n in got.items():
        assert n == 1
        comps[i].append(i)
    least = {c for i, n, c in sizes if n and c != "None"}
    assert {i for i, _ in got if i != "None"} == least


def test_order_of_keys():
    import numpy as np

    order = ngram_join.Order(np.array([9, 4], np.uint64), np.array([5, 70000]))
    keys = order.keys(np.array([8, 18, 20], np.uint64))
    assert keys.tolist() == [(1 << 63) + 1, (1 << 63), 10] and order.salts(keys).tolist() == [3, 1, 1]
    for a in range(1, 60):
        for b in range(a, 60):
            m = int(ngram_join.needed(a, b))
            assert all((100 * k >= 80 * (a + b - k)) == (k >= m) for k in range(a + 1))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nested_sets_make_a_deep_tree():
    sets = [np.arange(1, n + 2, dtype=np.uint64) for n in range(1100)]  # each holds all before it
    got = ngram_join.Tree(sets).links(list(range(1100)))
    assert len(set(got[4:])) == 1 and got[0] == 0 and got[0] != got[4]  # sizes of 5 and more are 80 % of the next


def test_frequent_keys_join_like_others(spark):
    many = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3 if i % 2 else 100 + i) for i in range(600)], "x int, k int")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (103, "c"), (110, "d")], "k int, y string")
    hot = common.frequent(many, "k", 50)
    assert {r["k"] for r in hot.collect()} == {0, 1, 2} and common.frequent(many, "k", 100) is None
    for how in ("inner", "left"):
        got = sorted(map(repr, common.join_frequent(many, one, "k", hot, how).collect()))
        assert got == sorted(map(repr, many.join(one, "k", how).collect()))


def test_frequent_ngrams_make_no_room_for_as_many_rows_as_may_be_frequent(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{i % k}" for i in range(j, j + 9)),) for k in (3, 5, 7) for j in range(4 * k)], "text string")
    asked, limit = [], type(docs).limit
    monkeypatch.setattr(type(docs), "limit", lambda self, n: asked.append(n) or limit(self, n))
    counts = Counter(int(x) for (t,) in docs.collect() for s in ngram_join.ngram_sets([t.encode()]) for x in s[: ngram_join.COUNTED * ngram_join.prefix_length(len(s))])
    order = ngram_join.frequent_ngrams(docs, 1024, 3)
    hot = {x & (1024 << 32) - 1: n for x, n in counts.items() if n > 3}
    assert hot and dict(zip(order.hot.tolist(), order.by_rank[order.rank].tolist(), strict=True)) == hot
    monkeypatch.setattr(ngram_join, "MOST_HOT", 6)  # the bar is the least count of which all fit
    bar = min(b for b in {3, *hot.values()} if sum(n > b for n in hot.values()) <= 6)
    fewer = ngram_join.frequent_ngrams(docs, 1024, 3)
    assert set(fewer.hot.tolist()) == {x for x, n in hot.items() if n > bar}
    assert max(asked, default=0) <= common.MOST_HOT  # a task that sorts makes room for twice the rows of a limit, however few there are


def test_a_map_gives_memory_back_when_its_batches_end(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    mapped = common.gives_back(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))
    assert next(mapped) == 2 and not given
    assert list(mapped) == [4, 6] and given == [1]


def test_components_of_hubs_and_chains(spark):
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), hot_rows=20).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_ids_that_several_sets_share(spark, monkeypatch):
    """Set ids of two bits: the other half of the digest tells the sets apart."""
    rng = random.Random(4)
    rows = [(i, " ".join(cases.words(rng, 30, 400)), "en", "s", 1) for i in range(12)] + [(20, "one two", "en", "s", 1)]
    rows += [(30 + i, t, *r) for i, (_, t, *r) in enumerate(rows)]
    whole = ngram_join.hashlib.blake2b

    class Short:
        def __init__(self, data, digest_size):
            self.raw = whole(data, digest_size=digest_size).digest()

        def digest(self):
            return bytes([self.raw[0] & 3]) + bytes(7) + self.raw[8:]

    found = []

    def ids(keys, shared=frozenset()):
        digest = Short(keys.tobytes(), 16).digest()
        one, two = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
        return (one ^ two if one in shared else one), two

    monkeypatch.setattr(ngram_join, "set_ids", ids)
    found = ngram_join.join(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: 20 if i == 42 else i % 30 for i, *_ in rows}


def test_keep_one_with_any_names(spark):
    internal = ["_may", "_id", "_key", "_stays", "_alone", "_text_key", "c0", "comp", "best", "n", "text_key", "doc"]
    rows = [(i, f"a b c d e f g {i // 2}") for i in range(6)] + [(7, None), (0, "a b c d e f g 0")]
    docs = spark.createDataFrame([(*r, *[f"x{j}" for j in range(len(internal))]) for r in rows], "c1 long, text string, " + ", ".join(f"{c} string" for c in internal)).withColumnRenamed("c1", "doc_id")
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert sorted(r["doc_id"] for r in got) == [0, 2, 4, 7] and all([r[c] for c in internal] == [f"x{j}" for j in range(len(internal))] for r in got)


# boilerplate lines


def brute_lines(rows, min_sites):
    sites = defaultdict(set)
    for _, t, _, site, _ in rows:
        for line in (t or "").split("\n"):
            if site is not None and re.search(r"[^\x20\x09-\x0D]", line):
                sites[line].add(site)
    out = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        flags = [len(sites[x]) >= min_sites if re.search(r"[^\x20\x09-\x0D]", x) else False for x in lines]
        kept = "\n".join(x for x, f in zip(lines, flags, strict=True) if not f)
        out.append((str(i), kept if any(flags) else t, len(lines), sum(flags), sum(flags)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_sites", "hot_rows"), [(2, 1 << 16), (5, 1 << 16), (5, 6), (2, 1)])
def test_boilerplate_lines(spark, min_sites, hot_rows):
    rng = random.Random(13)
    shared = [f"shared line {i}" for i in range(8)]
    more = []
    for i in range(120):
        own = [" ".join(cases.words(rng, 12, 900)) for _ in range(rng.randint(0, 5))]
        lines = own + rng.sample(shared, rng.randint(0, 3)) + ([shared[0]] * (i % 7 == 0)) + [""] * (i % 2)
        rng.shuffle(lines)
        more.append((100 + i, "\n".join(lines), "en", None if i % 11 == 0 else f"site{rng.randrange(1 + i % 9)}", 1))
    docs, rows = cases.awkward(spark, 9, more)
    found = line_dedup.drop_lines(docs, min_sites=min_sites, hot_rows=hot_rows)
    assert found.columns[:-3] == docs.columns
    got = sorted(((str(r["doc_id"]), r["text"], r["_n_lines"], r["_n_boilerplate"], r["_n_dropped"]) for r in found.collect()), key=repr)
    assert got == brute_lines(rows, min_sites)


def test_boilerplate_of_any_names_and_of_long_texts(spark):
    banner = "a banner on every site"
    long = "\n".join([banner, *(f"line {i} of a long text" for i in range(200_000)), banner])
    rows = [(i, f"{banner}\nown {i}", f"site{i}") for i in range(12)] + [(20, long, "site1"), (21, long, "site1")]
    internal = ["t", "row", "k1", "k2", "deal", "deals", "places", "spread", "kept", "l1", "l2", "n", "m", "site", "place", "c0", "c1", "_t", "_k1"]
    docs = spark.createDataFrame([(*r, *[f"x{j}" for j in range(len(internal))]) for r in rows], "c2 long, text string, source string, " + ", ".join(f"{c} string" for c in internal))
    got = {r["c2"]: r for r in line_dedup.drop_lines(docs, hot_rows=3).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: f"own {i}" for i in range(12)} | {i: long[len(banner) + 1 : -len(banner) - 1] for i in (20, 21)}
    assert all([r[c] for c in internal] == [f"x{j}" for j in range(len(internal))] for r in got.values())


def test_only_copies_keep_their_boilerplate(spark):
    banner = "a long banner line that stands on every site there is"
    rows = [(i, f"{banner}\n{banner}\nown {i}", "en", f"site{i}", 1) for i in range(12)]  # mostly boilerplate, with text of its own
    rows += [(20, banner, "en", "site1", 1), (21, f"{banner}\ntwice", "en", "site1", 1), (22, f"{banner}\ntwice", "en", "site2", 1), (23, f"{banner}\nagain", "en", "site3", 1), (24, f"{banner}\nagain", "en", None, 1)]
    found = line_dedup.drop_lines(spark.createDataFrame(rows, cases.SCHEMA), only_copies=True)
    got = {r["doc_id"]: (r["text"], r["_n_boilerplate"], r["_n_dropped"]) for r in found.collect()}
    assert got == {i: (f"own {i}", 2, 2) for i in range(12)} | {20: (banner, 1, 0), 21: (rows[13][1], 1, 0), 22: (rows[13][1], 1, 0), 23: ("again", 1, 1), 24: ("again", 1, 1)}


def test_estimates_far_from_the_bar_decide(spark):
    rows = [(i, "everywhere\nonce %d\nsome more words to keep it" % i, "en", f"site{i}", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    found = line_dedup.drop_lines(docs, min_sites=50)
    assert found.agg({"_n_boilerplate": "sum"}).first()[0] == 400 and found.agg({"_n_dropped": "sum"}).first()[0] in (0, 400)
    assert line_dedup.drop_lines(cases.empty(spark)).count() == 0


# shards


@pytest.mark.parametrize("shards", [8, 3])
def test_shards(spark, shards):
    rng = random.Random(14)
    more = [(100 + i, f"text {rng.randrange(260)}", "en", "s", 1) for i in range(400)] + [(900 + i, "hot", "en", "s", 1) for i in range(200)]
    docs, rows = cases.awkward(spark, 10, more)
    got = balanced_shards.shard(docs, shards).collect()
    own = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r[0]), *own(r[1])) for r in rows)
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == shards and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    small = [t for t, n in Counter(r[1] for r in rows).items() if 1 < n < 10]
    split = sum(len(where[own(t)[1]]) > 1 for t in small)
    assert split <= 0.25 * len(small) and (len(rows) // shards < 200 or len(where[zlib.crc32(b"hot")]) <= 3)


def test_a_hot_group_splits_no_small_ones(spark):
    texts = ["hot"] * 1600 + [f"group {i // 4}" for i in range(800)] + [f"pair {i // 2}" for i in range(200)] + [f"single {i}" for i in range(2200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], cases.SCHEMA)
    got = {r["doc_id"]: r["shard"] for r in balanced_shards.shard(docs, 8).collect()}
    assert sorted(Counter(got.values()).values()) == [600] * 8
    where = defaultdict(set)
    for i, t in enumerate(texts):
        where[t].add(got[i])
    assert all(len(where[t]) == 1 for t in where if t != "hot") and len(where["hot"]) <= 4
    full = spark.createDataFrame([(i, f"group {i // 4}", "en", "s", 1) for i in range(800)], cases.SCHEMA)  # nothing without links to fill gaps
    where = defaultdict(set)
    for r in balanced_shards.shard(full, 8).collect():
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(own) == 1 for own in where.values())


def test_shards_of_little(spark):
    assert balanced_shards.shard(cases.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], cases.SCHEMA)
    assert [(r["shard"], r["slot"]) for r in balanced_shards.shard(one).collect()] == [(0, 0)]
    all_equal = spark.createDataFrame([(i, "same", "en", "s", 1) for i in range(50)], cases.SCHEMA)
    assert sorted(Counter(r["shard"] for r in balanced_shards.shard(all_equal).collect()).values()) == [6] * 6 + [7] * 2


# plumbing


def test_samples_are_bounded_and_fixed(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "id % 3 as label")
    a = common.sample_ids(df, "label", 50)
    assert a == common.sample_ids(df.repartition(7), "label", 50) and sorted(a) == [0, 1, 2] and all(30 < len(v) <= 50 for v in a.values())
    docs = spark.range(5000).selectExpr("id as doc_id", "repeat('x', 100) as text")
    texts = common.fetch_texts(docs, a, 6000)
    assert sum(len(t) for own in texts.values() for t in own) <= 6000


def test_bit_table(spark):
    import numpy as np

    ids = spark.range(0, 3000, 7)
    found = common.BitTable.of(ids, "id").flag(spark.range(3000), "id", "may").collect()
    assert all(r["may"] for r in found if r["id"] % 7 == 0) and np.mean([r["may"] for r in found if r["id"] % 7]) < 0.1


def least_cut(sizes, room):
    """Fewest pairs of equal texts in different shards, over all ways to deal the groups."""
    pairs = lambda n: n * (n - 1) // 2

    def most_kept(k, room):
        if k == len(sizes):
            return 0
        found = []
        for head in itertools.product(range(sizes[k] + 1), repeat=len(room) - 1):
            dealt = (*head, sizes[k] - sum(head))
            if min(dealt) >= 0 and all(a <= b for a, b in zip(dealt, room, strict=True)):
                rest = most_kept(k + 1, tuple(b - a for a, b in zip(dealt, room, strict=True)))
                if rest is not None:
                    found.append(rest + sum(map(pairs, dealt)))
        return max(found, default=None)

    return sum(map(pairs, sizes)) - most_kept(0, tuple(room))


@pytest.mark.parametrize("sizes", [[6, 6, 1], [3, 5, 1], [6, 4, 3, 1, 1, 1, 1, 1], [5, 4, 6, 1, 1], [7, 5, 5, 6, 1, 1, 1, 1, 1, 1]])
def test_cut_edges_of_small_tables(spark, sizes):
    """Cut pairs by comparing all rows; against the best of all ways. Where groups don't go in whole, fewer than shards are split."""
    rng = random.Random(sum(sizes))
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["shard"] for r in balanced_shards.shard(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 3).collect()}
    counts = Counter(got.values())
    assert max(counts.values()) - min(counts[s] for s in range(3)) <= 1
    cut = [texts[a] for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] == texts[b] and got[a] != got[b]]
    room = [len(texts) // 3 + (s < len(texts) % 3) for s in range(3)]
    assert len(set(cut)) < 3
    assert least_cut([n for n in sizes if n > 1], room) <= len(cut) <= least_cut([n for n in sizes if n > 1], room) + max(n * (n - 1) // 2 for n in sizes)


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    passage = " ".join(cases.words(rng, 30, 400, "p"))
    docs, rows = cases.awkward(spark, 16, [(2000, "start " + passage + " " + " ".join(cases.words(rng, 50)), "en", "s1", 1), *family(rng)])
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, now, str(tmp_path)), "test")
        assert after.columns == now.columns and 0 < after.count() <= now.count()
        now = after
    last = {r["doc_id"]: r["text"] for r in now.collect()}
    assert passage not in last[2000] and last[2000].startswith("start ")
    assert now.where("n_chars <> char_length(text) and doc_id = 2000").count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(last)


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_pipeline(rows, items, model, least_fit):
    """The pieces that the five stages leave, in plain Python; rows are (id, text, source), ids are distinct and not null."""
    from tokenizers import Tokenizer

    from surveyloom.llm import packing

    fits = [model.name([t]) for _, t, _ in rows]
    now = [r for r, (names, _, _, fit) in zip(rows, fits, strict=True) if names[0] != "und" and fit[0] >= least_fit]
    sites, places = defaultdict(set), defaultdict(set)
    for _, t, site in now:
        places[t].add(site)
        for line in t.split("\n"):
            if WORD.search(line):
                sites[line].add(site)
    cut = []
    for i, t, site in now:
        kept = "\n".join(x for x in t.split("\n") if not (WORD.search(x) and len(sites[x] - {None}) >= line_dedup.MIN_SITES))
        cut.append((i, kept if WORD.search(kept) and len(places[t] - {None}) < 2 else t))
    least = {}
    for (i, t), (_, n, c) in zip(sorted(cut, key=lambda r: str(r[0])), brute_components(cut), strict=True):
        least.setdefault((c, n > 0) if n else i, []).append((i, t))
    now = [min(own) for own in least.values()]
    phrases = {tuple(w[i : i + 10]) for t in items for w in [ALNUM.findall(low(t))] for i in range(max(1, len(w) - 9) if w else 0)}
    want = Counter()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in now:
        words = [m.span() for m in ALNUM.finditer(low(t))]
        texts = [low(t)[a:b] for a, b in words]
        hit = {j for k in {len(p) for p in phrases} for a in range(len(texts) - k + 1) if tuple(texts[a : a + k]) in phrases for j in range(a, a + k)}
        if words and len(hit) == len(words):
            continue
        parts, at = [], 0
        for j in sorted(hit):
            if j - 1 not in hit:
                parts.append(t[at : words[j][0]])
            if j + 1 not in hit:
                at = words[j][1]
        ids = np.array([*tokenizer.encode(" ".join([*parts, t[at:]]), add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    return want


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline
    from surveyloom.llm import language_mixture

    rng = random.Random(41)
    passage, banner = " ".join(cases.words(rng, 24, 400, "p")), "subscribe to the news of every site"
    spelt = lambda t: re.sub(r"([a-z])([0-9]+)", lambda m: m[1] + "".join(chr(97 + int(c)) for c in m[2]), t)
    page = lambda n: " ".join(cases.words(rng, n, 900, rng.choice("wv")))
    rows = [(i, page(rng.randint(30, 90)) + f"\n{banner}" * (i % 3 == 0), f"site{i % 14}") for i in range(60)]
    rows += [(100 + i, " ".join(near(rng, rows[i][1].split(" "), i % 3)), f"site{i % 5}") for i in range(20)]
    rows += [(200 + i, f"{page(12)} {passage} {page(9)}.", "site1") for i in range(4)]
    rows += [(300, passage, "site2"), (301, banner, "site3"), (302, rows[0][1], "site9"), (303, "½ 12 —", "site1"), (304, "", None), (305, page(6000), None), (306, "A, B; c", "site2")]
    rows = [(i, spelt(t), site) for i, t, site in rows]
    items = [spelt(passage), spelt("short one"), "", None]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "xx", site, len(t)) for i, t, site in rows], cases.SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language_mixture.train(docs.select("doc_id", "text", "lang"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    want = brute_pipeline(rows, [t for t in items if t], model, corpus_pipeline.LEAST_FIT)
    assert got == want and len({i for i, *_ in got}) < len(rows) - 10
    end = Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert max(end.values()) <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a passage of a benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
