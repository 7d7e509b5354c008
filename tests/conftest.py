import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from flankwear.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="flankwear-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="flankwear-test-ckpt-")})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
