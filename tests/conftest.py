import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quire.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = tune(local_session("4", "tests"))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def docs(spark):
    """docs(doc_id, filename, html) from a list of HTML texts."""
    def make(*htmls):
        return spark.createDataFrame([(i, f"f{i}.docx", h) for i, h in enumerate(htmls)], "doc_id bigint, filename string, html string")
    return make
