import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fianchetto.session import get_session
    s = get_session("local[4]", app="fianchetto-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="fianchetto-test-ckpt-")})
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
