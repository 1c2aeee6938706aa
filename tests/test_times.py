"""Times read strictly, whatever the session's zone."""

import pytest
from pyspark.sql import functions as F

from opinara.functions import times as TM


def test_times_are_read_strictly(spark):
    rows = spark.createDataFrame([("2024-05-01",), ("2024/5/1",), ("20240501",), ("2024-05-01T12:30",), ("2024-05-01 12",), ("2024-05-01 12:30:15.5Z",), ("2024-05-01T12:30:15+0900",), (" ",), (None,)], "t string")
    want = ["2024-04-30 16:00:00", "2024-04-30 16:00:00", "2024-04-30 16:00:00", "2024-05-01 04:30:00", "2024-05-01 04:00:00", "2024-05-01 12:30:15.5", "2024-05-01 03:30:15", None, None]
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in rows.select(TM.in_zone(TM.read_time(F.col("t")), "UTC").cast("string")).collect()]
            assert got == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
    assert rows.limit(1).select(TM.in_zone(TM.read_time(F.col("t"), end_of_day=True)).cast("string")).first()[0] == "2024-05-01 23:59:59.999999"
    bad = spark.createDataFrame([("2024-02-30",), ("soon",), ("2024-05-01T25:00",), ("240501",)], "t string")
    assert {r[0] for r in bad.select(TM.read_time(F.col("t"), strict=False)).collect()} == {None}
    for t in ("2024-02-30", "soon"):
        with pytest.raises(Exception, match="no time"):
            bad.where(F.col("t") == t).select(TM.read_time(F.col("t"))).collect()
    with pytest.raises(Exception, match="no stored time"):
        rows.where("trim(t) = ''").select(TM.stored_time(F.col("t"))).collect()
