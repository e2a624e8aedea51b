import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def code_of(call, *args, **kwargs) -> str:
    """The error code a call ends with."""
    from gridloom import WorkspaceError

    with pytest.raises(WorkspaceError) as caught:
        call(*args, **kwargs)
    return caught.value.code
