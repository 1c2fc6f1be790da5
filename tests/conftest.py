import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from changeguard.session import GROUP_ROWS_KEY, build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", "tests", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def group_limit(spark):
    """Set how many rows a window group may hold, for this test only."""
    def use(n):
        spark.conf.set(GROUP_ROWS_KEY, str(n))

    yield use
    spark.conf.unset(GROUP_ROWS_KEY)


@pytest.fixture(scope="session")
def events(spark):
    """Events where one key has a third of the rows and one moment two fifths."""
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{SMALL}/events.parquet").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")).alias("key"),
        F.when(F.col("event_id") % 5 < 2, F.lit("2024-01-05").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"),
        "value", F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("rare"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect()) if df.columns else []


def as_set(df):
    return {tuple(r) for r in df.collect()}
