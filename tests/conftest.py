import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from cellweft.session import local_session, use_checkpoints  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8)
    use_checkpoints(session)
    yield session
    session.stop()
