import pytest

from loomframe.session import local_session

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples, for comparison."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
