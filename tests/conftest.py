import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crowdtape.session import build_session, share_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[4]", shuffle_partitions=4, shared_folder=f"file://{shared}")
    share_package(session)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
