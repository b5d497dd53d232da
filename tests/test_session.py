import os
from types import SimpleNamespace

import pytest

from conftest import rows
from tickerloom import session


def fake(setting=None, folder=None, master="yarn"):
    set_to = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: set_to[-1] if set_to else folder, setCheckpointDir=set_to.append
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting or default), sparkContext=context)


def test_folder_comes_from_the_session():
    assert session.durable_folder(fake("hdfs://shared/ck/")) == "hdfs://shared/ck"
    assert session.durable_folder(fake(folder="s3://shared/ck")) == "s3://shared/ck"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        session.durable_folder(fake())


def test_own_folder_only_in_local_runs():
    assert "tickerloom-" in session.durable_folder(fake(master="local[2]"))


def test_durable_table_keeps_rows_and_types(spark):
    df = spark.sql("SELECT 1 AS a, array(named_struct('x', DATE'2026-04-01')) AS b, CAST(NULL AS TIMESTAMP_NTZ) AS c")
    kept = session.durable_table(df)
    assert kept.dtypes == df.dtypes and rows(kept) == rows(df)
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()


def test_durable_tables_can_be_dropped(spark):
    kept = session.durable_table(spark.range(3))
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    session.drop_durable_tables(spark)
    assert not os.path.exists(path)
