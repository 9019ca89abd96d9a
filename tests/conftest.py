import os
import signal

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")
#: Seconds after which a test that does not end fails.
LIMIT = 900


@pytest.fixture(autouse=True)
def time_limit():
    def stop(*_):
        raise TimeoutError(f"not ended after {LIMIT} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
