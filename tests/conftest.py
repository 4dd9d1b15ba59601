from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spanmill.session import build_session
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                      spark__ui__showConsoleProgress="false", spark__sql__codegen__wholeStage="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
