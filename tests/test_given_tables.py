"""Named queries on small tables that are written for one hard case each."""

from datetime import datetime, timedelta

from newsflow.plans import ORACLES, QUERIES
from tests.compare import compare

T0 = datetime(2024, 1, 1)


def check(spark, folder, name, table, files="*"):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/{files}.parquet'")
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], str(folder))
    assert ok, message


def test_timeliness_of_ids_beyond_doubles(spark, tmp_path):
    rows = [(8_999_999 - i, 1_199_000 + i, 59_990 + i % 10, 1 + i % 7, 10.0, 100.0, T0) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    check(spark, tmp_path, "timeliness_factors", "lineitem")


def test_capped_alerts_round_arrivals_like_the_sql(spark, tmp_path):
    # slices of 100 seconds; the fifth click, at 99.7, opens the second slice
    at = [("click", x) for x in (0, 1, 2, 3, 99.7)] + [("view", 100 * k + 20 + i) for k in (1, 2, 3) for i in range(5)] + [("view", 399)]
    rows = [(1200 * i, T0 + timedelta(seconds=x), i, kind, 1.0) for i, (kind, x) in enumerate(at)]  # such ids arrive at once
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    check(spark, tmp_path, "stream_capped_alerts", "events")


def test_dedup_count_without_text_and_in_several_files(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"title {i % 13}\nbody") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, tmp_path, "stream_dedup_count", "documents")
