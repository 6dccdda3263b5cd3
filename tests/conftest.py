import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from framemill.session import ship

    folder = tempfile.mkdtemp(prefix="spark-")
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", folder).config("spark.checkpoint.dir", f"{folder}/ck").config("spark.sql.warehouse.dir", f"{folder}/wh").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
