import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from helpers import log_line  # noqa: E402

from hitpath.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, "hitpath-tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def entries(spark):
    """Entries from ``(second, request, uid, is_new)`` rows, in that order."""
    from hitpath.sources.ltsv import parse_lines

    def build(rows):
        lines = [(log_line(*row), i) for i, row in enumerate(rows)]
        return parse_lines(spark.createDataFrame(lines, "value string, ord int"))

    return build
