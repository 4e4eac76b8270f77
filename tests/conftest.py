import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from small_tables import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from tallyframe.session import local_session

    s = local_session("*", shuffle_partitions=8, app="tallyframe-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ledger(spark):
    from tallyframe.plans.catalog import ledger_for

    return ledger_for(spark, SMALL)
