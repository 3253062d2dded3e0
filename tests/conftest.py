import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="tessera-tests", shuffle_partitions=4,
                      conf={"spark.driver.memory": "4g"})
    yield s
    s.stop()


def docs_df(spark, texts):
    """A small documents table ``(document, text)`` from literal texts."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document long, text string")
