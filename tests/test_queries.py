"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytest.importorskip("duckdb")
if not Path(FOLDER).exists():
    pytest.skip("no test tables", allow_module_level=True)

from tabwarden.plans import QUERIES  # noqa: E402
from tests.compare_all import connect, differences  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = differences(spark, con, FOLDER, name)
    assert problem in (None, "empty result"), problem
