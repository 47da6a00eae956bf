from __future__ import annotations

import pytest

from barloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", **{"spark.master": "local[2]", "spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
