"""Small frames with known answers: typing, filters, paging, selection, ranking."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plantlens.operators import casts, compare, filters, identity, paging, selection
from plantlens.plans.view import analysis_rows, table_view


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_filter_and_sort(spark):
    t = spark.createDataFrame([("1", 10.0, "A"), ("2", 15.0, "B"), ("3", 12.5, "A"), ("4", 9.5, "C")],
                              "id string, temp double, machine string")
    assert ids(table_view(t, [("temp", "ge", 10), ("machine", "contains", "a")], [("temp", "desc")])) == ["3", "1"]


def test_page_of_ten(spark):
    t = spark.createDataFrame([(str(i),) for i in range(1, 11)], "id string").withColumn("n", F.col("id").cast("int"))
    assert ids(paging.page(t, 1, 3, [("n", "asc")])) == ["4", "5", "6"]
    assert ids(paging.page(t, 1, 3, [("n", "desc")], deep_rows=1)) == ["7", "6", "5"]
    assert paging.page_count(t, 3).first()["pages"] == 4
    assert paging.pages_of(0) == 0
    assert paging.page_size("x") == 200 and paging.page_size(5000) == 1000 and paging.page_index(-3) == 0


def test_deep_page_sorts_text_and_missing(spark):
    words = ["b", "ab", "a", None, "abc", "ä", "", "b"]
    t = spark.createDataFrame([(f"{i}", w) for i, w in enumerate(words)], "id string, w string")
    for direction in ("asc", "desc"):
        near = ids(paging.page(t, 0, 8, [("w", direction)]))
        deep = ids(paging.page(t, 0, 8, [("w", direction)], deep_rows=0, block_rows=3))
        assert near == deep


def test_casts(spark):
    t = spark.createDataFrame([("1", "a", "10", "2025-01-01"), ("2", "b", "20.5", "invalid"), ("3", "c", "x", "2025-01-03"),
                               ("4", "d", "30", None)], "id string, machine string, value string, timestamp string")
    out = casts.apply_types(t, {"value": "int", "timestamp": "datetime", "machine": "nonsense"}).orderBy("id").collect()
    assert [r["value"] for r in out] == [10, None, None, 30]
    assert [r["timestamp"] is None for r in out] == [False, True, False, True]


def test_mask_then_drop(spark):
    t = spark.createDataFrame([("1", 1.0, "a"), ("2", 2.0, "b"), ("3", None, "c")], "id string, x double, g string")
    sel = spark.createDataFrame([("1",), ("9",)], "id string")
    assert ids(analysis_rows(t, sel, True, True)) == ["2"]


def test_missing_passes_only_ne(spark):
    t = spark.createDataFrame([("1", 1.0), ("2", None), ("3", 3.0)], "id string, x double")
    assert sorted(ids(filters.filter_rows(t, [("x", "ne", 1)]))) == ["2", "3"]
    for op in ("eq", "lt", "le", "gt", "ge"):
        assert "2" not in ids(filters.filter_rows(t, [("x", op, 2)]))
    assert ids(filters.filter_rows(t, [("x", "eq", "text")])) == []


def test_require(spark):
    t = spark.createDataFrame([("1", "x", None), ("2", "3", 1.0)], "id string, y string, a double")
    assert ids(filters.require_target(t, "y")) == ["2"]
    assert len(ids(filters.require_target(t, "y", "classification"))) == 2
    with pytest.raises(identity.DataError):
        filters.require_rows(t, "regression")


def test_ids(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, v string")
    fixed = identity.ensure_id(t, order_cols=["v"]).orderBy("v").collect()
    assert [r["id"] for r in fixed] == ["1", "2", "3"]
    kept = identity.ensure_id(spark.createDataFrame([(5, "a"), (7, "b")], "id int, v string"))
    assert dict(kept.dtypes)["id"] == "string" and sorted(ids(kept)) == ["5", "7"]


def test_validate(spark):
    two = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "a")
    with pytest.raises(identity.DataError):
        identity.validate(two)
    with pytest.raises(identity.DataError):
        identity.validate(spark.createDataFrame([], "a int"))


def test_nan_becomes_missing(spark):
    t = identity.load_table(spark.createDataFrame([("1", float("nan")), ("2", 2.0)], "id string, x double"))
    assert t.filter("x is null").count() == 1


def test_selection(spark):
    def frame(*values):
        return spark.createDataFrame([(v,) for v in values], "id string")

    assert sorted(ids(selection.select_add(frame("1", "2"), frame("2", "3")))) == ["1", "2", "3"]
    assert sorted(ids(selection.select_on_page(frame("1", "2", "9"), frame("1", "2", "3"), frame("3")))) == ["3", "9"]
    assert ids(selection.select_clear(frame("1"))) == []


def twelve(spark):
    rows = [(str(i), 100 + i % 3 if i <= 6 else 10 + i % 3, 50 + i % 5, "A" if i <= 6 else "B", "day" if i % 2 else "night")
            for i in range(1, 13)]
    return spark.createDataFrame(rows, "id string, sensor_x bigint, sensor_y bigint, machine string, shift string")


def test_rank_twelve(spark):
    sel = spark.createDataFrame([(str(i),) for i in range(1, 7)], "id string")
    out = {r["variable"]: r for r in compare.rank_causes(twelve(spark), sel).collect()}
    assert {"sensor_x", "machine"} <= set(out)
    assert abs(out["sensor_x"]["effect_size"]) > 10 and out["sensor_x"]["p_value"] < 1e-6
    # 2 x 2 with Yates: all six in A against all six in B
    assert out["machine"]["statistic"] == pytest.approx(4 * (3 - 0.5) ** 2 / 3)
    assert out["shift"]["statistic"] == 0.0 and out["shift"]["p_value"] == 1.0


def test_rank_needs_two(spark):
    t = spark.createDataFrame([("1", 1.0, "a"), ("2", 2.0, "b"), ("3", 3.0, "a"), ("4", 4.0, "b")], "id string, v double, c string")
    one = spark.createDataFrame([("1",)], "id string")
    assert compare.rank_causes(t, one).count() == 0
    assert "select more" in compare.ranking_message(t, one)


def test_no_spread(spark):
    t = spark.createDataFrame([(str(i), 5.0, 1.0 if i < 3 else 2.0, None) for i in range(6)],
                              "id string, flat double, step double, none double")
    out = {r["variable"]: r for r in compare.rank_causes(t, F.col("id").isin("0", "1", "2")).collect()}
    assert out["flat"]["statistic"] is None and out["flat"]["effect_size"] == 0.0
    assert out["step"]["p_value"] == 0.0 and "none" not in out


def test_features_are_row_expressions(spark):
    from plantlens.operators.features import add_features

    t = spark.createDataFrame([("1", 2.0, None)], "id string, v double, w double")
    refused = ["avg(v) over ()", "reflect('java.lang.System','getProperty','user.name')", "(select\nmax(1))", "max(v)", "exists(select 1)",
               "uuid()", "v in (select 1)", "transform(array(1), x -> x)"]
    fine = ["v - w", "v / nullif(w, 0)", "log(v) + exp(v)", "case when v > 1 and not (w is null) then 1 else 0 end", "v in (1, 2)", "1 / 0",
            "if(v between 1 and 3, 'x', concat('a', id))", "cast(id as int) % 2", "id like 'a%'", "pow(v, 2)"]
    warnings: list[str] = []
    out = add_features(t, [(f"f{i}", e) for i, e in enumerate(refused + fine)], warnings)
    assert len(warnings) == len(refused) and out.columns == ["id", "v", "w", *(f"f{len(refused) + i}" for i in range(len(fine)))]
