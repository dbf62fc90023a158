import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from armscope.session import build_session  # noqa: E402
from armscope.spec import ExperimentSpec  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def spec():
    return ExperimentSpec()


COLUMNS = "experiment string, user_id long, group string, converted int, country string, time_seconds double"


@pytest.fixture
def units(spark):
    """Builds a unit table from (arm, country, converted, count) cells."""

    def build(cells, experiment="x"):
        rows, user = [], 0
        for arm, country, converted, count in cells:
            for _ in range(count):
                rows.append((experiment, user, arm, converted, country, float(user % 97)))
                user += 1
        return spark.createDataFrame(rows, COLUMNS)

    return build


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
