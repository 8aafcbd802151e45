"""Streams of a table that is a folder of files, whose rows follow no order of time."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.streaming import jobs as st
from workload import suite  # noqa: F401
from workload.adapter import Tables
from workload.check import compare
from workload.q_streams import in_files
from workload.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", path / name)
    spark.read.parquet(f"{SF}/documents.parquet").repartition(5, "doc_id").write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(folder):
        files = f"{folder}/{name}/*.parquet" if os.path.isdir(f"{folder}/{name}") else f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


@pytest.mark.parametrize("name", ["breaking_notices", "stream_url_dedup", "stream_history_dedup", "alert_stream", "alert_stream_many_keywords", "alert_stream_after_failures"])
def test_table_of_several_files(spark, con, folder, name):
    status, rows, _, note = compare(name, spark, con, folder, QUERIES, ORACLES)
    assert status == "ok" and rows, note


@pytest.mark.parametrize("rows", [1000, 0])
def test_a_micro_batch_is_no_single_task(spark, tmp_path, rows):
    seen = []

    def handle(batch, batch_id):
        seen.append((batch.select(F.input_file_name()).distinct().count(), sorted(r["id"] for r in batch.select("id").collect())))

    st.drain_batches(in_files(Tables(spark, SF), spark.range(0, rows, 1, 8).withColumn("text", F.lit("x")), 3), handle, checkpoint=str(tmp_path / "cp"))
    assert sorted(x for _, ids in seen for x in ids) == list(range(rows))
    assert [files for files, _ in seen] == ([8, 8, 8] if rows else [0])
