import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tierloom.session import clear_scratch, local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# Bronze in all-string mode.
SALES_TEXT = "order_id string, customer_id string, product string, amount string, order_date string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=8, app="tierloom-tests")
    yield session
    clear_scratch(session)
    assert not [d.name for d in session.catalog.listDatabases() if d.name.startswith("tierloom_")]
    session.stop()
