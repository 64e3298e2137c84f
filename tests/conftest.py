import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from assaylake.session import ensure_checkpoint_dir, get_spark
    shared = str(tmp_path_factory.mktemp("shared"))
    s = get_spark(master="local[4]", shuffle_partitions=8, conf={"spark.checkpoint.dir": shared})
    assert ensure_checkpoint_dir(s)
    yield s
