import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ember.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def pixels(spark):
    """Turn {chip: 2-D list} masks into a pixel table."""

    def make(masks, name="cls", extra=None):
        rows = []
        for chip, mask in masks.items():
            width = len(mask[0])
            for r, line in enumerate(mask):
                for c, value in enumerate(line):
                    more = [extra[k][chip][r][c] for k in (extra or {})]
                    rows.append((chip, r, c, r * width + c, value, *more))
        cols = ", ".join(f"{k} {'boolean' if isinstance(rows[0][5 + i], bool) else 'bigint'}" for i, k in enumerate(extra or {}))
        return spark.createDataFrame(rows, f"chip_id string, rw bigint, cl bigint, pos bigint, {name} bigint" + (", " + cols if cols else ""))

    return make
