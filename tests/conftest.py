import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trawlix.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
