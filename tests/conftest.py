import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LINES = """+1 1:0.5 3:2 # c
-1 2:1 2:0.5
1 qid:7 3:1 1:-1
0 0:9 2:0.25
abc 1:1 3:x
# whole

2"""


@pytest.fixture(scope="session")
def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES.split("\n"))), "row_id bigint, value string")


@pytest.fixture(scope="session")
def micro(lines):
    """Six examples of three features: duplicates, unsorted, a bad label, a bad value, an empty row."""
    from sparselin.sources.libsvm import parse
    return parse(lines)


@pytest.fixture(scope="session")
def random_rows(spark):
    """Random sparse examples with their dense matrix, for comparison with NumPy."""
    import numpy as np

    from sparselin.schema import ROWS
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(200, 30)) * (rng.random((200, 30)) < 0.2)
    dense[:, 0] = 1.0  # a feature every example has
    dense[17] = 0.0
    y = np.where(rng.random(200) < 0.4, 1.0, -1.0)
    data = [(i, float(y[i]), [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]])
            for i, x in enumerate(dense)]
    return spark.createDataFrame(data, ROWS).repartition(5).persist(), dense, y
