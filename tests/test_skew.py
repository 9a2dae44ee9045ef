"""Hot keys: one customer with a third of all jobs, one job with a third of all labor, one
part type with a third of all parts; nothing broadcast at planning, skew splitting at work."""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle_check import TABLES, connect, differences

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

HOT = {
    "orders": "if(o_orderkey % 3 = 0, 77, o_custkey) as o_custkey",
    "lineitem": "if(l_suppkey % 3 = 0, 4242, l_orderkey) as l_orderkey",
    "part": "if(p_partkey % 3 = 0, 'PROMO', p_type) as p_type",
}

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.files.maxPartitionBytes": "100k",
}


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    for table in TABLES:
        if table not in HOT:
            os.symlink(f"{SF_DIR}/{table}.parquet", folder / f"{table}.parquet")
            continue
        df = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
        column = HOT[table].split()[-1]
        changed = df.selectExpr(*[HOT[table] if c == column else c for c in df.columns])
        changed.coalesce(1).write.option("parquet.block.size", 64 * 1024).parquet(str(folder / f"{table}.dir"))
        part = next(p for p in (folder / f"{table}.dir").iterdir() if p.suffix == ".parquet")
        os.symlink(part, folder / f"{table}.parquet")
    return str(folder)


@pytest.fixture
def shuffled(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key in SETTINGS:
        spark.conf.unset(key)


@pytest.mark.parametrize(
    "name",
    "monthly_scorecard city_scorecard job_fact quality_gate top_customers customer_type_value win_rate_by_channel "
    "labor_rollup crew_dashboard".split(),
)
def test_hot_keys_give_whole_results(spark, shuffled, hot_dir, name):
    assert differences(spark, connect(hot_dir), hot_dir, name) == []


def test_hot_customer_is_split_over_tasks(spark, shuffled, hot_dir):
    df = contract.queries()["monthly_scorecard"](spark, hot_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin(skew=true)" in final
