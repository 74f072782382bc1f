import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from growthlens.plans.materialise import release  # noqa: E402
from growthlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="6g")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Build a small frame from rows and a schema string."""

    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


def by_key(df, *keys):
    """Rows of a small result as ``{key: row dict}``."""
    out = {}
    for row in df.collect():
        d = row.asDict()
        key = tuple(d[k] for k in keys)
        assert key not in out, f"duplicate {key}"
        out[key] = d
    return out
