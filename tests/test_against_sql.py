"""Queries against their SQL on tables whose rows lie on edges."""

import hmac
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from evidentia.functions.tokens import hmac_sha256


def same_as_sql(spark, folder, name, *tables):
    got = __spark_entry__.queries()[name](spark, str(folder))
    sql = duckdb.connect()
    for t in tables:
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    expected = sql.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(expected, key=repr)
    return found


def test_scripts_are_made_of_the_given_pages(spark, tmp_path):
    # the name of the host has 18 characters: reports of sites take every third page of such a site for empty
    html = "<html><body>" + "<p>some words</p>" * 60 + "</body></html>"
    spark.createDataFrame([(k, f"https://abcdef.example.net/{k}", html) for k in range(6)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r[0] for r in same_as_sql(spark, tmp_path, "page_asset_hits", "pages")} == set(range(6))


def events(spark, folder, rows):
    """rows: (event_id, seconds, user)."""
    made = [(i, datetime(1970, 1, 1) + timedelta(seconds=s), u, "view", 1.0) for i, s, u in rows]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize(("late", "allowed"), [(0.6, True), (0.5, True), (0.4, False)])
def test_budgets_count_nearest_seconds(spark, tmp_path, late, allowed):
    # 40 requests in the hour 0, and one just before the hour 600
    events(spark, tmp_path, [(5 * k, 60.0, 7) for k in range(40)] + [(5000, 600 * 3600 - 1 + late, 7)])
    found = same_as_sql(spark, tmp_path, "usage_budgets", "events")
    assert ("7", 5000, allowed) in found


def test_slots_are_of_nearest_seconds(spark, tmp_path):
    ids = [24 + 69 * k for k in range(80) if (24 + 69 * k) % 4][:41]
    events(spark, tmp_path, [(i, 1_080_010.0, 1) for i in ids[1:]] + [(ids[0], 1_079_999.6, 1)])
    assert len(same_as_sql(spark, tmp_path, "usage_over_budget", "events")) == 1


def test_keyed_hashes_of_any_key_without_a_step_for_each_byte(spark):
    keys = [b"", b"6\\", bytes(range(64)), bytes(range(128, 192)), bytes(range(192, 256)), bytes(range(64, 129)), b"\0\0", b"secret\n2024-01-16", "ключ".encode()]
    rows = [(k, m) for k in keys for m in (b"", b"m\0x", bytes(range(256)))]
    made = spark.createDataFrame(rows, "k binary, m binary").select("k", "m", hmac_sha256(F.col("m"), F.col("k")).alias("h"))
    assert [r["h"] for r in made.collect()] == [hmac.new(bytes(k), bytes(m), "sha256").hexdigest() for k, m in rows]
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
