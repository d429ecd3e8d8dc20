import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from briefkit.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tests run in local mode with their own fresh checkpoint folder.
    ckpt = tempfile.mkdtemp(prefix="briefkit-test-ckpt-")
    s = get_session("local[4]", shuffle_partitions=4, app_name="briefkit-tests",
                    extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="briefkit-test-")


SF = "/root/testdata/sf0.001"
