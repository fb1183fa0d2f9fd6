import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from scoreloom.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, shuffle_partitions=4, memory="4g")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def fixtures_text():
    return (ROOT / "FIXTURES.md").read_text(encoding="utf-8")


@pytest.fixture(scope="session")
def golden(fixtures_text):
    """The table of golden scores: one dict per sample text."""
    rows = []
    for line in fixtures_text.splitlines():
        if re.match(r"\| [ST]\d \|", line):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            keys = ("id", "source", "completion", "n", "ar", "length", "arabic", "keyword", "forbidden",
                    "question", "tags", "total_lit", "total_rng")
            row = dict(zip(keys, cells, strict=True))
            row["completion"] = re.fullmatch(r"`(.*)`|``", row["completion"]).group(1) or ""
            if row["completion"] == "`":
                row["completion"] = ""
            rows.append({k: v if k in ("id", "source", "completion") else float(v) for k, v in row.items()})
    assert len(rows) == 19
    return rows


@pytest.fixture(scope="session")
def fixture_sql(fixtures_text):
    """The SQL of the two small derived tables, by name."""
    blocks = re.findall(r"```sql\n(.*?)```", fixtures_text, re.S)
    assert len(blocks) == 2
    return {"SC": blocks[0], "SI": blocks[1]}
