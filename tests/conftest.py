from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logspark.session import apply_settings  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[8]").appName("tests")
    session = (apply_settings(builder)
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def logs_of(spark):
    """Rows (container, seq, ts_raw, stream, message) as logs, ``span`` sequence numbers a segment."""
    from logspark.model import with_segment

    def make(rows, span=1 << 20):
        df = spark.createDataFrame(
            [(c, c, s, t, st, m) for c, s, t, st, m in rows],
            "container_id string, name string, seq long, ts_raw string, stream string, "
            "message string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
        return with_segment(df, span)
    return make


@pytest.fixture
def eval_expr(spark):
    """Evaluate a column over one-column rows of text."""
    def run(make, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(make("v")).collect()]
    return run
