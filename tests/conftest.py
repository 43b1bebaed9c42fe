import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spokeworks.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.maxMetadataStringLength": "5000",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ts():
    return dt.datetime.fromisoformat


@pytest.fixture
def plan_of():
    """Physical plan text; ``final`` runs the query so that adaptive choices show."""
    def text(df, final=False):
        if final:
            df.collect()
        return df._jdf.queryExecution().toString()
    return text
