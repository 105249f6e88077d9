from __future__ import annotations

import pytest

from tessitura.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[4]", 4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
