import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lectern.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return session(**{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
