from __future__ import annotations

import pytest

from tesserae.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=8, partitions=8)
