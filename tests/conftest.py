import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fieldspark.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, order=None):
    """Collect as a list of dicts (sorted by ``order`` when given)."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple((r[k] is None, r[k]) for k in order))
    return out
