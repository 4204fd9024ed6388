import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gridloom.runtime import build_session

    session = build_session(
        "gridloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stage")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    import numpy as np

    return np.random.default_rng(20240117)


@pytest.fixture(scope="session")
def vec(spark):
    """Build an indexed vector from values, in a shuffled and repartitioned frame."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def make(values, parts=3, **columns):
        data = {"i": np.arange(len(values)), "x": values, **columns}
        frame = pd.DataFrame(data).sample(frac=1.0, random_state=7)
        # through Arrow, so that NaN stays NaN
        return spark.createDataFrame(pa.table({c: pa.array(frame[c].to_numpy(), from_pandas=False) for c in frame})).repartition(parts)

    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][0]
