"""Flow queries on tables whose keys are larger than those of the test data."""

from datetime import datetime

import pytest

from flowloom.plans.queries import ORACLES, QUERIES
from tests.oracle import assert_same

COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("users", [[0, 15, 16, 4095, 65535], [65536, 65537, 0xFFFFF, 0x100000, 0xABCDEF0], [0x7FFFFFFF, None]])
def test_addresses_of_many_users(spark, tmp_path, users):
    rows = [(k, datetime(2024, 1, 1, 0, k), u, "click", 1.5, '{"k": 7}') for k, u in enumerate(users)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(path)
    assert_same(QUERIES["ip_text"](spark, str(tmp_path)), ORACLES["ip_text"], {"events": f"{path}/*.parquet"})
