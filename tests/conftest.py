import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark import build_session

    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hot(spark):
    """Three series by day, one of which holds most rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for name, n in (("hot", 900), ("mid", 120), ("tiny", 3)):
        ts = pd.date_range("2020-01-01", periods=n, freq="D")
        parts.append(pd.DataFrame({"series_id": name, "ts": ts, "x": rng.normal(size=n), "price": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(4)
