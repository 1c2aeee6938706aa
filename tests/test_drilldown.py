"""Single accounts: the store's pruning, marks per comment, the detail's lines."""

import pytest
from pyspark.sql import functions as F

from opinara.operators import accounts as A, drilldown as DR


def activity(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id string, brand string, ts timestamp, text string, sentiment double").withColumn("ts", F.col("ts"))


def test_marks_and_pruning(spark, tmp_path):
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(i, "u", "7-11", day(1, i), "這個真的很好吃推薦", 0.9) for i in range(3)]
    rows += [(3, "u", "全家", day(9), "這個真的很好吃推薦!", 1.0), (4, "u", "全家", None, "普通", 0.1), (5, "u", "全家", day(20), None, 0.1)]
    rows += [(10 + i, f"other{i}", "7-11", day(1 + i), "不同的內容在這裡", 0.0) for i in range(20)]
    rows += [(40 + i, "few", "OK", day(1, i), "一模一樣的文字", 0.0) for i in range(2)]
    stored = activity(spark, rows)
    path = str(tmp_path / "store")
    DR.store_activity(stored, path)
    listed = DR.suspects(stored, 1)
    assert [(r["rank"], r["user_id"]) for r in listed.collect()] == [(1, "u")]
    comments = DR.stored_comments(spark, path, listed)
    plan = comments._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan
    got = {r["event_id"]: (r["template"], r["burst"]) for r in DR.marked_comments(comments).collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (True, True), 3: (True, False), 4: (False, False), 5: (False, False)}
    few = {r["event_id"]: r["template"] for r in A.template_flags(stored.where("user_id = 'few'")).collect()}
    assert few == {40: False, 41: False}
    marked = DR.marked_comments(comments)
    lines = [r["text"] for r in DR.detail_lines(listed, marked, marked).orderBy("line").collect()]
    assert lines[0] == "帳號可疑明細: u" and lines[2] == "品牌互動" and lines[3] == "- 7-11: 留言數=3, 平均情感=0.90" and "burst 標記留言" in lines and lines.index("template_like 標記留言") == 11
    assert lines[12] == "- [7-11] 2024-01-01 00:00 這個真的很好吃推薦" and len(lines) == 11 + 1 + 4 + 1 + 3
    assert DR.suspects(stored.limit(0)).count() == 0
    with pytest.raises(ValueError):
        DR.suspects(stored, 5000)
    with pytest.raises(ValueError):
        DR.stored_comments(spark, str(tmp_path / "none"), listed)


def test_empty_marks_are_told(spark):
    rows = activity(spark, [(1, "a", "7-11", None, "x", 0.5)])
    listed = DR.suspects(rows)
    lines = [r["text"] for r in DR.detail_lines(listed, DR.marked_comments(rows.withColumn("rank", F.lit(1))), DR.marked_comments(rows.withColumn("rank", F.lit(1)))).orderBy("line").collect()]
    assert lines[-4:] == ["template_like 標記留言", "- 無", "burst 標記留言", "- 無"] and "- 未達活動量門檻，未計算特徵" in lines
