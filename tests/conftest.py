import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="spark-tests-")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", work).config("spark.local.dir", work).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


TRANSCRIPT = "rec_id long, session_id string, rec_type string, uuid string, rec_ts string, cwd string, git_branch string, permission_mode string, agent_name string, parent_session_id string, msg_role string, msg_content string, loaded_at timestamp_ntz"


@pytest.fixture(scope="session")
def transcript(spark):
    """Makes transcript rows from dicts; what is not given is NULL or follows from the position."""
    import datetime as dt

    names = [c.split()[0] for c in TRANSCRIPT.split(", ")]

    def make(rows):
        t0 = dt.datetime(2024, 9, 2)
        out = []
        for i, r in enumerate(rows):
            base = {"rec_id": i + 1, "session_id": "s", "rec_type": "user", "uuid": f"u{i:03d}", "rec_ts": f"2024-09-02T00:{i // 60:02d}:{i % 60:02d}Z", "msg_role": "user", "loaded_at": t0 + dt.timedelta(seconds=i)}
            out.append(tuple((base | r).get(n) for n in names))
        return spark.createDataFrame(out, TRANSCRIPT)

    return make
