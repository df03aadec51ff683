import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "gaugework-tests", "8g")
    yield session
    session.stop()


@pytest.fixture
def long_frame(spark):
    """A long metric table from ``{metric: values}``."""

    def make(metrics):
        rows = [(m, None if v is None else float(v)) for m, values in metrics.items() for v in values]
        return spark.createDataFrame(rows, "metric_name string, value double")

    return make
