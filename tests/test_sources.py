"""Readers, the CSV sink, connection settings and stored models."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from plantlens.operators import supervised
from plantlens.operators.identity import DataError
from plantlens.sources import files, jdbc
from plantlens.sources.model_store import load_model, save_model


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "cp932"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes("id,名前,value\n0001,温度計①,1.5\n0002,圧力,2.5\n".encode(encoding))
    t = files.read_csv(spark, str(path))
    assert t.columns == ["id", "名前", "value"]
    assert [r["名前"] for r in t.orderBy("value").collect()] == ["温度計①", "圧力"]
    text = files.read_csv(spark, str(path), schema="id string, n string, value double")
    assert text.orderBy("value").first()["id"] == "0001"


def test_csv_encoding_shows_late(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"id,n\n" + b"".join(b"%d,x\n" % i for i in range(30_000)) + "30000,温度計①\n".encode("cp932"))
    t = files.read_csv(spark, str(path), schema="id int, n string")
    assert t.orderBy("id", ascending=False).first()["n"] == "温度計①"
    real = tmp_path / "u.csv"
    real.write_bytes("id,n\n1,\ufffd\n".encode())
    assert files.read_csv(spark, str(real), schema="id int, n string").first()["n"] == "\ufffd"


def test_csv_failure_names_attempts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"a\n\x81\xff\xfe\n")
    with pytest.raises(DataError, match="utf-8"):
        files.read_csv(spark, str(path), encodings=["utf-8"])
    with pytest.raises(DataError):
        files.read_table(spark, "table.xyz")


def test_write_csv(spark, tmp_path):
    t = spark.createDataFrame([("1", 2.5), ("2", None)], "id string, x double")
    files.write_csv(t, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), schema="id string, x double")
    assert back.filter("x is null").count() == 1
    with pytest.raises(DataError):
        files.write_csv(t.limit(0), str(tmp_path / "none"))


def test_connection_settings():
    ok = {"host": "h", "database": "d", "user": "u", "password": "p"}
    assert jdbc.JdbcConfig("postgresql", **ok).jdbc_url() == "jdbc:postgresql://h:5432/d"
    assert jdbc.JdbcConfig("mysql", port=3307, **ok).jdbc_url() == "jdbc:mysql://h:3307/d"
    assert jdbc.JdbcConfig("oracle", **ok).jdbc_url() == "jdbc:oracle:thin:@//h:1521/d"
    assert "databaseName=d" in jdbc.JdbcConfig("sqlserver", **ok).jdbc_url()
    assert jdbc.JdbcConfig("sqlite", file="/x.db").jdbc_url() == "jdbc:sqlite:/x.db"
    for bad in ({"system": "mysql"}, {"system": "sqlite"}, {"system": "other"}):
        with pytest.raises(DataError):
            jdbc.JdbcConfig(**bad).jdbc_url()
    assert jdbc.JdbcConfig("oracle", **ok).default_schema() == "U"
    assert jdbc.quoted_table(jdbc.JdbcConfig("sqlserver", **ok), "dbo.t a") == "[dbo].[t a]"
    assert jdbc.quoted_table(jdbc.JdbcConfig("mysql", **ok), "`s`.t") == "`s`.`t`"
    assert "sqlite_master" in jdbc.catalog_query(jdbc.JdbcConfig("sqlite", file="x"))
    assert "table_schema = 'public'" in jdbc.catalog_query(jdbc.JdbcConfig("postgresql", **ok))


def test_empty_query(spark):
    with pytest.raises(DataError):
        jdbc.read_jdbc(spark, jdbc.JdbcConfig("sqlite", file="x"), "  ;")


@pytest.mark.parametrize("key", ["linear", "pls", "tree_classifier"])
def test_stored_model_scores_alike(spark, tmp_path, key):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"id": [str(i) for i in range(60)], "a": rng.normal(size=60), "c": rng.choice(["x", "y'"], 60)})
    p["y"] = p.a * 2 + (p.c == "x")
    p["label"] = np.where(p.y > 0, "up", "down")
    t = spark.createDataFrame(p).selectExpr("*", "cast(id as int) < 45 as is_train")
    target = "label" if key == "tree_classifier" else "y"
    fitted = supervised.fit_supervised(t, key, ["a", "c"], target)
    path = str(tmp_path / key)
    save_model(fitted, path)
    back = load_model(spark, path)
    assert back.classes == fitted.classes and back.params == fitted.params
    one = fitted.score(t).orderBy("id").toPandas().predicted
    two = back.score(t).orderBy("id").toPandas().predicted
    assert list(one) == list(two)
    assert back.metrics.count() == 2
