"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Everything that touches rows is a DataFrame expression. The driver sees one count for each pattern of votes,
3 ** len(RULES) at most, whatever the size of the corpus; EM runs over those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import materialize

GOOD, BAD, ABSTAIN = 1, 0, 2

#: name, vote over the features: true is good, false is bad, null abstains. The bounds are those that published filters of web
#: text use (words, word length, symbols a word, repetition), none is fitted to labels; no two rules look at the same counts,
#: but for the number of words, because the votes are taken as independent.
RULES: list[tuple[str, str]] = [
    ("length", "n_words >= 50"),
    ("word_length", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    ("symbols", "10 * n_symbols <= n_words"),
    ("repetition", "10 * n_dup_lines <= 3 * n_lines and 100 * n_repeat_words <= 15 * n_words"),
    ("capitals", "5 * n_capitals <= word_chars"),
    ("exclamations", "10 * n_exclaimed <= n_words"),
]

_WINDOW_HASHES = """
transform(array(filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')), ws -> named_struct(
    'n', size(ws), 'word_chars', char_length(array_join(ws, '')),
    'windows', if(size(ws) < 5, cast(array() as array<bigint>),
        transform(sequence(0, size(ws) - 5), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])))
))[0]
"""

#: Sorting brings equal windows together; each window that has an equal one then covers five words, less what the next one covers.
_REPEATED = """
transform(array(w.windows), h -> if(size(array_distinct(h)) = size(h), 0,
    transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s ->
        transform(array(sort_array(transform(filter(s, (x, k) ->
                (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))), p ->
            aggregate(transform(p, (x, k) -> if(k = size(p) - 1, 5, least(5, p[least(k + 1, size(p) - 1)] - x))), 0, (a, b) -> a + b)
        )[0]
    )[0]
))[0]
"""


def features(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts for each document. Null texts are empty; words are runs of anything but space and U+0009 to U+000D."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = "transform(array(filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')), ls -> named_struct('n', size(ls), 'd', size(array_distinct(ls))))[0]"
    gone = "char_length(t) - char_length(regexp_replace(t, '{}', ''))"
    wide = docs.select(
        "doc_id",
        F.expr(_WINDOW_HASHES.format(text="t")).alias("w"),
        F.expr(lines).alias("l"),
        F.expr(gone.format("[#*$%&|<>]")).alias("n_symbols"),
        F.expr(gone.format("[A-ZÀ-ÖØ-Þ]")).alias("n_capitals"),
        F.expr(gone.format("!")).alias("n_exclaimed"),
    )
    long = lambda e, name: F.expr(e).cast("long").alias(name)
    return wide.select(
        "doc_id", long("w.n", "n_words"), long("w.word_chars", "word_chars"), long("n_symbols", "n_symbols"), long("l.n - l.d", "n_dup_lines"),
        long(_REPEATED, "n_repeat_words"), long("l.n", "n_lines"), long("n_capitals", "n_capitals"), long("n_exclaimed", "n_exclaimed"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def pattern(rules: list[tuple[str, str]]) -> Column:
    """The votes as one number, in base 3."""
    out = F.lit(0)
    for _, vote in rules:
        out = out * 3 + F.when(F.expr(vote), GOOD).when(~F.expr(vote), BAD).otherwise(ABSTAIN)
    return out.cast("int")


def votes_of(code: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


#: Rounds of EM; imagined votes of each rule in each class, and the share of good ones among them; bounds of what is estimated.
ROUNDS, STRENGTH, IMAGINED, BOUNDS = 30, 10.0, (0.99, 0.5), (0.01, 0.99)


def _bounded(x: float) -> float:
    return min(BOUNDS[1], max(BOUNDS[0], x))


def fit(counts: dict[int, int], n_rules: int, rounds: int = ROUNDS, strength: float = STRENGTH) -> tuple[float, list[tuple[float, float]]]:
    """Prior of a good document, and each rule's rate of good votes on good and on bad documents, by EM over counts of vote patterns.

    No label is used. EM starts from the filter that it replaces: a document that breaks no rule is good, any other is bad.
    From there, rules whose bad votes agree with nothing else lose their say. A few imagined votes stand for rules that
    nobody breaks; a good vote never tells for a bad document.
    """
    patterns = [(votes_of(code, n_rules), n) for code, n in sorted(counts.items())]
    good = [float(BAD not in votes) for votes, _ in patterns]
    prior, accuracy = 0.5, [IMAGINED] * n_rules
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = _bounded((sum(n * p for (_, n), p in zip(patterns, good, strict=True)) + strength / 2) / (total + strength))
        accuracy = []
        for r in range(n_rules):
            cast = [(votes[r], n, p) for (votes, n), p in zip(patterns, good, strict=True) if votes[r] != ABSTAIN]
            a = _bounded((sum(n * p for v, n, p in cast if v == GOOD) + strength * IMAGINED[0]) / (sum(n * p for _, n, p in cast) + strength))
            b = _bounded((sum(n * (1 - p) for v, n, p in cast if v == GOOD) + strength * IMAGINED[1]) / (sum(n * (1 - p) for _, n, p in cast) + strength))
            accuracy.append((a, min(a, b)))
        good = [posterior(votes, prior, accuracy) for votes, _ in patterns]
    return prior, accuracy


def posterior(votes: list[int], prior: float, accuracy: list[tuple[float, float]]) -> float:
    """Probability of a good document with these votes."""
    z = math.log(prior) - math.log(1 - prior)
    for v, (good, bad) in zip(votes, accuracy, strict=True):
        if v == GOOD:
            z += math.log(good) - math.log(bad)
        elif v == BAD:
            z += math.log(1 - good) - math.log(1 - bad)
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: list[tuple[str, str]] = RULES, least: float = 0.5) -> DataFrame:
    """doc_id, counts, votes as one number, posterior of good quality, base_failed and kept, one row for each row of ``docs``.

    Null and empty texts have no words and fail the base. Repeated rows are judged each on its own, alike. Ids may be null
    or repeat. An empty table gives an empty result; columns other than id and text are not read.
    """
    found = materialize(features(docs, text_col, id_col).withColumn("pattern", pattern(rules)).withColumn("base_failed", base_failed()), "quality-rules")
    # A base failure is no vote: what the base drops is left out of the fit.
    counts = {r[0]: r[1] for r in found.where(~F.col("base_failed")).groupBy("pattern").agg(F.count(F.lit(1))).collect()}
    prior, accuracy = fit(counts, len(rules))
    scores = F.array(*[F.lit(posterior(votes_of(code, len(rules)), prior, accuracy)) for code in range(3 ** len(rules))])
    out = found.withColumn("posterior", F.element_at(scores, F.col("pattern") + 1))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from surveyloom.llm.common import table

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _em_sql(n_rules: int) -> str:
    """The rounds of ``fit`` as a chain of tables: q0, p1, q1, p2, ...; parameters are pr, g0, b0, g1, b1, ..."""
    gain = " + ".join(f"case v{r} when {GOOD} then ln(g{r}) - ln(b{r}) when {BAD} then ln(1 - g{r}) - ln(1 - b{r}) else 0 end" for r in range(n_rules))
    score = f"1 / (1 + exp(-(ln(pr) - ln(1 - pr) + {gain})))"
    broken = " or ".join(f"v{r} = {BAD}" for r in range(n_rules))
    bounded = lambda e: f"least({BOUNDS[1]}, greatest({BOUNDS[0]}, {e}))"
    share = lambda w, r, k: bounded(f"(coalesce(sum(case when v{r} = {GOOD} then {w} else 0 end), 0) + {STRENGTH * IMAGINED[k]}) / (coalesce(sum(case when v{r} <> {ABSTAIN} then {w} else 0 end), 0) + {STRENGTH})")
    tables = [f"q0 as materialized (select patterns.*, case when {broken} then 0.0 else 1.0 end as q from patterns)"]
    for k in range(ROUNDS):
        accuracy = ", ".join(f"{share('n * q', r, 0)} as g{r}, least({share('n * q', r, 0)}, {share('n * (1 - q)', r, 1)}) as b{r}" for r in range(n_rules))
        prior = bounded(f"(coalesce(sum(n * q), 0) + {STRENGTH / 2}) / (coalesce(sum(n), 0) + {STRENGTH})")
        tables.append(f"p{k + 1} as materialized (select {prior} as pr, {accuracy} from q{k})")
        tables.append(f"q{k + 1} as materialized (select patterns.*, {score} as q from patterns, p{k + 1})")
    tables.append(f"verdict as materialized (select votes.doc_id, votes.row, {score} as q from votes, p{ROUNDS})")
    return ",\n".join(tables)


_BASE_SQL = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
_SPACE_SQL = "[^\\x20\\x09-\\x0D]"
_VOTES = ", ".join(f"case when {vote} then {GOOD} when not ({vote}) then {BAD} else {ABSTAIN} end as v{r}" for r, (_, vote) in enumerate(RULES))
_NAMES = ", ".join(f"v{r}" for r in range(len(RULES)))
OP8_SQL = f"""
with t as (select doc_id, row_number() over () as row, coalesce(text, '') as t from documents),
w as (
    select doc_id, row, t, regexp_extract_all(t, '{_SPACE_SQL}+') as w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '{_SPACE_SQL}')] as l from t
),
windows as (select row, i, array_to_string(w[i : i + 4], ' ') as phrase from (select row, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
often as (select row, i from (select row, i, count(*) over (partition by row, phrase) as n from windows) where n > 1),
covered as (select row, count(distinct place) as n from (select row, unnest(range(i, i + 5)) as place from often) group by row),
features as (
    select doc_id, w.row, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, len(l) as n_lines,
        length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as n_capitals, length(t) - length(replace(t, '!', '')) as n_exclaimed
    from w left join covered on w.row = covered.row
),
votes as materialized (select doc_id, row, {_VOTES}, {_BASE_SQL} as base_failed from features),
patterns as materialized (select {_NAMES}, count(*) as n from votes where not base_failed group by all),
{_em_sql(len(RULES))}
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE_SQL} as base_failed, not ({_BASE_SQL}) and q >= 0.5 as kept
from features f join verdict on f.row = verdict.row
"""
