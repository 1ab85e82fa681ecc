import pytest

from quillspark.session import session


@pytest.fixture(scope="session")
def spark():
    return session(cores=4, memory="4g", partitions=4)
