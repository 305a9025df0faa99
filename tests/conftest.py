import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from duocount.session import build_session, checkpoint_dir
    s = build_session("local[4]", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    # tests only: a scratch checkpoint folder when the session names none
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="duocount-ckpt-"))
    yield s


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)


SF_SMALL = "/root/testdata/sf0.001"
