import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import os  # noqa: E402

os.environ["PYTHONPATH"] = f"{Path(__file__).parents[1]}:{os.environ.get('PYTHONPATH', '')}"  # workers import the package too

from palimpsest.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4, "4g")
