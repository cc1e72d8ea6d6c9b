import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import get_session  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session(master="local[4]", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


def rows(df, *order):
    """Collect as a list of dicts (small fixtures only), optionally sorted."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple((r[c] is None, r[c]) for c in order))
    return out
