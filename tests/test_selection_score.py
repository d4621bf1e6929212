"""The selection score's order and reach against values worked out by hand."""

import datetime

from rostrum.plans import times


def test_best_score_before_rounding_and_reach_in_microseconds(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 0, 0, 0, 100001)
    far = t + datetime.timedelta(seconds=20000)
    rows = [(1, t, 1, "view", 1.0000001), (2, t, 1, "view", 1.0000002), (3, t, 2, "view", 1.0), (4, far, 2, "signup", 0.0), (5, t, 3, "view", 1.0), (6, far + datetime.timedelta(microseconds=1), 3, "signup", 0.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.event_id, r.score) for r in times.c28_selection_score(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1.0), 2: (3, 51.0), 3: (6, 50.0)}
