"""The views of the tables against plain Python."""

from loomgraph import catalog

SF = "/root/testdata/sf0.001"


def test_users_follow_each_other_in_the_whole_log(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id", "user_id").collect()
    log = [r.user_id for r in sorted(events, key=lambda r: (r.ts, r.event_id))]
    got = [(r.source, r.target) for r in catalog.users(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in zip(log, log[1:]) if a != b}
