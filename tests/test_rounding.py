"""Times that lie half a millisecond between two decimals, against SQL."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronospan import queries
from tests.compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", ["tl_rel_abs", "ag_topic_profile", "vw_inventory"])
def test_half_milliseconds_are_rounded_as_in_sql(spark, tmp_path, name):
    base = datetime.datetime(2024, 1, 1)
    times = [base + datetime.timedelta(microseconds=m) for i in range(1500) for m in (0, 3_600_000 * i * 997 + 1000 * i + 500)]
    n = len(times)
    table = pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array([i // 2 if name != "tl_rel_abs" else i % 7 // 2 for i in range(n)], pa.int64()),
        "event_type": ["view"] * n, "value": [1.5] * n, "props": [""] * n,
    })
    pq.write_table(table, tmp_path / "events.parquet")
    assert spark_rows(queries.QUERIES[name](spark, str(tmp_path))) == sql_rows(queries.ORACLE_SQL[name], str(tmp_path))
