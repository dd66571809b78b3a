from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from finlens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[*]", app_name="finlens-tests", shuffle_partitions=8)
    # tests set their own checkpoint folder; a cluster names a shared one
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


def rows(df, *cols):
    """Collect selected columns as tuples, sorted (None first)."""
    data = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(data, key=lambda t: tuple((x is not None, x) for x in t))
