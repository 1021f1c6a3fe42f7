"""A cache kept in the state of a stream: answers, ends and restarts against a plain loop over the events."""

from datetime import datetime, timedelta

from graphloom.streaming import progress as ST


def plain(events, ttl):
    last, out = {}, []
    for event, at, user, kind, value in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "purchase":
            last[user] = (at, value)
        else:
            held = user in last and at - last[user][0] < ttl
            out.append((user, event, "hit" if held else "miss", last[user][1] if held else None))
    return sorted(out)


def test_answers_end_and_outlive_a_restart(spark, tmp_path):
    begin, folder, state = datetime(2024, 1, 1), str(tmp_path / "events"), str(tmp_path / "state")
    events = [(k, begin + timedelta(minutes=7 * k), k * k % 5, "purchase" if k % 6 == 0 else "view", float(k)) for k in range(90)]
    answers = None
    for part in (events[:40], events[40:70], events[70:]):  # each part is a run of its own
        rows = [(e, t, u, k, v, "{}") for e, t, u, k, v in part]
        spark.createDataFrame(rows, ST.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        answers = ST.cache_stream(spark, folder, "event_type = 'purchase'", "45 minutes", state)
    got = answers.collect()
    asked = sorted((r.key, r.event_id, r.outcome, r.answer) for r in got if r.outcome != "expired")
    assert asked == plain(events, timedelta(minutes=45))
    assert {"hit", "miss"} == {r[2] for r in asked}
    assert any(r.outcome == "expired" for r in got)
    # an answer stored in one run is given in the next one
    first_of_second = [r for r in asked if r[1] in range(40, 46) and r[2] == "hit"]
    assert first_of_second
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_nothing_stored(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.createDataFrame([(1, datetime(2024, 1, 1), 7, "view", None, "{}"), (2, datetime(2024, 1, 1), None, "view", 1.0, "{}")], ST.EVENTS).write.parquet(folder)
    assert [tuple(r) for r in ST.cache_stream(spark, folder, "event_type = 'purchase'", "1 day").collect()] == [(7, 1, "miss", None)]
