import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from penmark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session("8", 4, **{"spark.checkpoint.dir": str(folder), "spark.driver.memory": "4g"})
    yield session
    session.stop()
