from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from tastemill.session import local_session  # noqa: E402
from tastemill.sources.retail import RetailData  # noqa: E402

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session("4", partitions=4, memory="4g", **{
        "spark.checkpoint.dir": str(folder),
        "spark.sql.warehouse.dir": str(folder / "warehouse"),
        "spark.ui.showConsoleProgress": "false",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root() -> str:
    return ROOT


@pytest.fixture(scope="session")
def data(spark, root) -> RetailData:
    return RetailData(spark, root)


@pytest.fixture()
def rows():
    """Rows of a frame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
