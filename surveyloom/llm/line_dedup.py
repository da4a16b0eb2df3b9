"""Cross-site boilerplate lines: how many distinct sites a line is on, by HyperLogLog sketches; exact counts near the threshold.

DataFrame functions only. Each occurrence of a line is a narrow row (text key, place, line key, site); sketches merge by
aggregation, so a line that is everywhere is one small sketch for each map task. Lines and texts are told apart by two
64-bit hashes. Frequent lines meet their occurrences by a broadcast of bounded size and copied texts are dealt to several
tasks, so that no key is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import discard, materialize, table

MIN_SITES = 10
LG_K = 12
#: Five standard errors of a sketch of 2 ** LG_K registers: farther from the threshold the estimate decides.
BAND = 5 * 1.04 / 2 ** (LG_K / 2)
#: Occurrences from which a key is frequent; where more than MOST_HOT keys might be, the bar is higher.
HOT_ROWS, MOST_HOT = 1 << 16, 1 << 14

_WORD = "[^\\\\x20\\\\x09-\\\\x0D]"
_LINE = ["l1", "l2"]


def _two(c: str) -> list[Column]:
    return [F.xxhash64(c), F.xxhash64(F.lit(20240229), c)]


def occurrences(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(k1, k2, place, l1, l2, site) for each line that has a word."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(site_col).cast("string").alias("site"))
    k1, k2 = _two("t")
    texts = texts.select("t", "site", k1.alias("k1"), k2.alias("k2"))  # before the lines part, or it is done for each of them
    lines = texts.select("k1", "k2", "site", F.posexplode(F.split("t", "\n")).alias("place", "l")).where(F.expr(f"l rlike '{_WORD}'"))
    l1, l2 = _two("l")
    return lines.select("k1", "k2", "place", l1.alias("l1"), l2.alias("l2"), "site")


def _of(lines: DataFrame, keys: DataFrame, hot_rows: int) -> DataFrame:
    """The occurrences of the lines in ``keys`` (l1, l2, n occurrences); those of frequent ones are not shuffled."""
    hot = F.broadcast(keys.where(F.col("n") > hot_rows).select(*_LINE))  # MOST_HOT rows at most
    cold = keys.where(F.col("n") <= hot_rows).select(*_LINE)
    return lines.join(hot, _LINE).unionByName(lines.join(hot, _LINE, "left_anti").join(cold, _LINE))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(l1, l2, n) of the lines on ``min_sites`` distinct sites at least, with their occurrences; a null site is none."""
    sketches = lines.groupBy(*_LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count(F.lit(1)).alias("n"))
    slack = max(1.0, BAND * min_sites)
    likely = materialize(sketches.where(F.col("sites") >= min_sites - slack), "line-spread")
    clear = likely.where(F.col("sites") > min_sites + slack).select(*_LINE, "n")
    near = likely.where(F.col("sites") <= min_sites + slack).select(*_LINE, "n")
    exact = _of(lines, near, hot_rows).groupBy(*_LINE, "site").agg(F.count(F.lit(1)).alias("m")).where("site is not null")
    exact = exact.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select(*_LINE)
    found = materialize(clear.unionByName(near.join(exact, _LINE)), "line-boilerplate")
    discard(likely)
    return found


def drop_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, only_copies: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines gone from the text, then ``_n_lines``, ``_n_boilerplate``, ``_n_dropped``.

    Lines are what stands between line feeds; one without a word is never boilerplate. With ``only_copies``, copied pages alone (no
    word would be left, or the equal text is on several sites) stay whole, for near-duplicate removal to settle. Null texts
    stay null and have no lines (empty ones have one, without a word); a text of which all lines go is empty. Repeated rows are
    treated alike. Names in ``docs`` may be any but those three. An empty table gives an empty result.
    """
    names, text = docs.columns, f"c{docs.columns.index(text_col)}"
    lines = materialize(occurrences(docs, text_col, site_col), "lines")
    hot_rows = max(hot_rows, lines.count() // MOST_HOT)
    marks = boilerplate(lines, min_sites, hot_rows)
    places = _of(lines, marks, hot_rows).groupBy("k1", "k2", "place").agg(F.min("site").alias("a"), F.max("site").alias("z"), F.count(F.lit(1)).alias("m"))
    spread = F.coalesce(F.min("a") < F.max("z"), F.lit(False)).alias("spread")
    deals = F.greatest(F.lit(1), F.ceil(F.max("m") / hot_rows)).cast("int").alias("deals")
    places = materialize(places.groupBy("k1", "k2").agg(F.collect_list("place").alias("places"), spread, deals), "line-places")
    discard(lines, marks)
    copied = F.broadcast(places.where("deals > 1").select("k1", "k2", "deals"))  # MOST_HOT texts at most
    copies = places.select("k1", "k2", "places", "spread", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))

    k1, k2 = _two("t")
    row = F.monotonically_increasing_id()  # where a row is dealt to has no bearing on what becomes of it
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("t", F.coalesce(F.col(text), F.lit(""))).withColumn("row", row)
    keyed = keyed.withColumn("k1", k1).withColumn("k2", k2).join(copied, ["k1", "k2"], "left")
    # A text without a word matches nothing: it may be dealt anywhere.
    deal = F.when(F.expr(f"t rlike '{_WORD}'"), F.pmod("row", F.coalesce("deals", F.lit(1)))).otherwise(-1 - F.pmod("row", F.lit(1 << 16))).cast("int")
    joined = keyed.withColumn("deal", deal).join(copies, ["k1", "k2", "deal"], "left")
    split = "transform(array(split(t, '\\n')), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), places), i -> ls[i]), '\\n'))[0]"
    joined = joined.withColumn("kept", F.when(F.col("places").isNotNull(), F.expr(split)))
    cut = F.col("places").isNotNull()
    if only_copies:
        cut = cut & F.expr(f"kept rlike '{_WORD}'") & ~F.col("spread")
    n = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    n_boilerplate = F.when(F.col("places").isNull(), 0).otherwise(n).cast("long")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.char_length("t") - F.char_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = [F.when(cut, F.col("kept")).otherwise(F.col(f"c{i}")).alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return joined.select(*out, n_lines.alias("_n_lines"), n_boilerplate.alias("_n_boilerplate"), F.when(cut, n).otherwise(0).cast("long").alias("_n_dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = drop_lines(docs)
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_boilerplate").alias("n_boilerplate"), F.col("_n_dropped").alias("n_dropped"), "text")


OP1_SQL = f"""
with l as (
    select doc_id, text, source, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
    from documents
),
spread as (
    select line from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
    group by line having count(distinct source) >= {MIN_SITES}
),
marked as (select l.*, s.line is not null as flag from l left join spread s on l.line = s.line),
cut as (
    select doc_id, any_value(text) as text, count(*) as n_lines, count(*) filter (where flag) as n_boilerplate,
           coalesce(string_agg(line, chr(10) order by place) filter (where not flag), '') as kept
    from marked group by doc_id
)
select doc_id, cast(case when text is null then 0 else n_lines end as bigint) as n_lines, cast(n_boilerplate as bigint) as n_boilerplate,
       cast(n_boilerplate as bigint) as n_dropped, case when n_boilerplate > 0 then kept else text end as text
from cut
"""
