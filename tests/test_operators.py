from helpers import rows

from surveyloom.operators import alignment as A
from surveyloom.operators import versions as V


def test_numbered_names_fold_case(spark):
    df = spark.createDataFrame([(0, "Mag"), (1, "mag"), (2, "x")], "slot int, name string")
    assert rows(V.numbered(df, "name", "slot", fold_case=True), "slot", "var_name") == [(0, "Mag"), (1, "mag[1]"), (2, "x")]
    assert rows(V.numbered(df, "name", "slot"), "slot", "var_name") == [(0, "Mag"), (1, "mag"), (2, "x")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, pos int, v string")
    assert V.latest(df, ["k"], "pos").count() == 0 and V.collapse(df, ["k"], "v", "pos").count() == 0
    assert A.runs(df, ["k"], "pos").count() == 0 and A.dense(df.select("k", "pos", "v"), "k", "pos", {"v": ""}).count() == 0


def test_calibration_prefers_small_shifts(spark):
    slots = spark.createDataFrame([(0,), (1,)], "slot int")
    held = spark.createDataFrame([(1,), (2,), (-1,)], "slot int")
    assert rows(A.calibrate(slots, held).where("chosen"), "shift", "score") == [(1, 2)]
    tie = spark.createDataFrame([(1,), (-1,)], "slot int")
    assert rows(A.calibrate(spark.createDataFrame([(0,)], "slot int"), tie).where("chosen"), "shift") == [(1,)]


def test_plans_do_not_shuffle_more_than_they_must(spark):
    df = spark.range(100).selectExpr("id % 7 as k", "id as pos", "id * 2 as v")
    plan = V.latest(df, ["k"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
