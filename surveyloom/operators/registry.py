"""Settings, roles, coordinate systems, creation records and display lists from the catalog's entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import expressions as E
from surveyloom.functions import registry as R
from surveyloom.operators.versions import collapse, first_seen, latest


def channel_settings(entries: DataFrame) -> DataFrame:
    """path, channel, key, value, conflict: the last value of each key in chain order."""
    return collapse(entries, ["path", "channel_slot", "channel", "key"], "value", "chain_pos").drop("channel_slot")


def settings_map(settings: DataFrame) -> DataFrame:
    return settings.groupBy("path", "channel").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))


def coordinate_systems(entries: DataFrame) -> DataFrame:
    """path, pos, name: the names in the order in which they come up."""
    found = entries.groupBy("path", "name").agg(F.min("chain_pos").alias("first_pos"))
    return found.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("first_pos")) - 1).alias("pos"), "name")


def channel_roles(entries: DataFrame, channels: DataFrame) -> DataFrame:
    """path, role, channel, ambiguous for X, Y and Z of each file: the one real channel that its entries name."""
    files = channels.select("path").unionByName(entries.select("path")).distinct()
    roles = files.select("path", F.explode(F.array(*[F.lit(r) for r in R.ROLE_KEYS])).alias("role"))
    names = channels.select("path", F.col("name").alias("value")).distinct()
    valid = entries.join(names, ["path", "value"], "left_semi").groupBy("path", "role").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    one = F.col("lo") == F.col("hi")
    return roles.join(valid, ["path", "role"], "left").select("path", "role", F.when(one, F.col("lo")).alias("channel"), F.coalesce(~one, F.lit(False)).alias("ambiguous"))


def projections(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each coordinate system of a file: the last record, its parameters named by a text or by the method's layout.

    A text names them if its values are the record's set slots in order, and its method is the layout's where that is
    known; of several the last such one counts. ``text_mismatch``: some text came before it that doesn't fit, or none fits.
    """
    layout = F.create_map(*[x for code, (name, slots) in R.METHODS.items() for x in (F.lit(code), F.struct(F.lit(name).alias("method"), F.array(*[F.lit(s) for s in slots]).cast("array<int>").alias("slots")))])
    records = entries.withColumn("layout", F.try_element_at(layout, F.col("method_code")))
    keys = ["path", "name", "chain_pos"]
    parsed = texts.select("path", "name", F.col("chain_pos").alias("text_pos"), E.projection_method(F.col("text")).alias("text_method"), E.projection_values(F.col("text")).alias("values"))
    tried = records.select(*keys, "parameters", "layout").join(parsed, ["path", "name"])
    fits = F.coalesce(E.holds_in_order(F.col("values"), F.col("parameters")), F.lit(False)) & F.coalesce(F.col("layout.method") == F.col("text_method"), F.col("layout").isNull())
    judged = tried.select(*keys, "text_pos", "text_method", fits.alias("fits"))
    best = judged.groupBy(*keys).agg(F.max_by("text_method", F.when(F.col("fits"), F.col("text_pos"))).alias("text_method"), F.max(F.when(F.col("fits"), F.col("text_pos"))).alias("text_pos"), F.count(F.lit(1)).alias("n"))
    joined = records.join(best, keys, "left")
    used = F.filter("parameters", lambda v: v.isNotNull())
    names = E.parameter_names(F.col("text_method"))
    by_text = F.col("text_pos").isNotNull()
    named_by_text = by_text & names.isNotNull() & (F.size(names) == F.size(used))
    by_layout = ~by_text & F.col("layout").isNotNull()
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    layout_names = E.parameter_names(F.col("layout.method"))
    slots = F.transform(F.col("layout.slots"), lambda s: F.get(F.col("parameters"), s))
    parameters = F.when(named_by_text, F.zip_with(names, used, pair)).when(by_layout, F.zip_with(layout_names, slots, pair))
    named = joined.withColumn("method", F.when(by_text, F.col("text_method")).otherwise(F.col("layout.method"))).withColumn("method_parameters", parameters)
    named = named.withColumn("parameter_source", F.when(named_by_text, "text").when(by_layout, "binary"))
    t = F.col("transform")
    units = F.concat(F.slice(t, 1, 3), F.transform(F.slice(t, 4, 3), E.arc_seconds), F.array(E.parts_per_million(F.get(t, 6))))
    named = named.withColumn("datum_transform_parameters", F.when(t.isNotNull(), units)).withColumn("text_mismatch", F.coalesce((F.col("n") > 0) & ~by_text, F.lit(False)))
    named = named.drop("layout", "text_method", "text_pos", "n", "transform")
    compared = named.withColumn("_content", F.to_json(F.struct(*[c for c in named.columns if c not in ("path", "name", "chain_pos", "text_mismatch")])))
    conflict = compared.groupBy("path", "name").agg((F.min("_content") != F.max("_content")).alias("conflict"))
    return latest(named, ["path", "name"], "chain_pos").join(conflict, ["path", "name"])


def channel_makers(entries: DataFrame) -> DataFrame:
    """path, channel, tool, label, params, conflict: the last creation record of each channel in chain order."""
    content = entries.withColumn("_content", F.to_json(F.struct("tool", "label", "params")))
    conflict = content.groupBy("path", "channel_slot").agg((F.min("_content") != F.max("_content")).alias("conflict"))
    return latest(entries, ["path", "channel_slot"], "chain_pos").join(conflict, ["path", "channel_slot"]).select("path", "channel", "tool", "label", "params", "conflict")


def distinct_names(entries: DataFrame) -> DataFrame:
    return first_seen(entries, "name", "chain_pos")


def findings(settings: DataFrame, projections: DataFrame, makers: DataFrame, roles: DataFrame) -> DataFrame:
    """What contradicts itself in a registry, as rows of ``diagnostics``."""

    def rows(df: DataFrame, when: str, code: str, channel: Column | None, message: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.where(when).select("path", F.lit(code).alias("code"), none.alias("line"), (none if channel is None else channel).alias("channel"), F.lit(None).cast("long").alias("offset"), message.alias("message"))

    told = [
        rows(settings, "conflict", "REG_CONFLICT", F.col("channel"), F.concat(F.lit("several values of "), "key", F.lit("; the last counts"))),
        rows(projections, "conflict", "IPJ_CONFLICT", None, F.concat(F.lit("several records of "), "name", F.lit("; the last counts"))),
        rows(projections, "text_mismatch", "IPJ_TEXT_MISMATCH", None, F.concat(F.lit("a text of "), "name", F.lit(" doesn't fit its record"))),
        rows(makers, "conflict", "MAKER_CONFLICT", F.col("channel"), F.concat(F.lit("several creation records, the last is by "), "tool")),
        rows(roles, "ambiguous", "ROLE_AMBIGUOUS", None, F.concat(F.lit("several channels are registered as "), "role")),
    ]
    return reduce(DataFrame.unionByName, told)
