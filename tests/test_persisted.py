"""Publications and their pointers, commits of two writers, merged batches, keyed state over micro-batches."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import settlement
from larkspur.sources import sinks, snapshots
from larkspur.streaming import keyed, merge

AT = "2024-02-01T10:30:00Z"
NOON = "2024-02-01 12:00:00"


def rows_of(spark, n, market="m"):
    return spark.range(n).withColumn("market", F.lit(market))


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/gens", f"file://{tmp_path}/latest.json"


def put(spark, place, n, mode="full", least=1):
    return sinks.publish(rows_of(spark, n), *place, ["id"], AT, mode, least)


def test_full_generation_outlives_close_ones(spark, place):
    full = put(spark, place, 3)
    for n in (1, 2, 4, 5):
        put(spark, place, n, "close")
    held = sinks._body(spark, place[1])
    assert held == full and spark.read.json(held["file"]).count() == 3
    again = put(spark, place, 3)
    assert again["file"] == full["file"] and spark.read.json(full["file"]).count() == 3
    newer = put(spark, place, 6)
    assert sinks._body(spark, place[1])["file"] == newer["file"]
    assert spark.read.json(full["file"]).count() == 3  # the one before stays for those who read it
    put(spark, place, 7)
    assert not sinks._exists(spark, full["file"])


def test_partial_publication_keeps_the_full_one(spark, place):
    full = put(spark, place, 3, least=2)
    put(spark, place, 1, least=2)
    assert sinks._body(spark, place[1]) == full
    assert sinks._body(spark, sinks.pointers(place[1])["any"])["n"] == 1


def test_interruption_before_the_swap(spark, place, monkeypatch):
    full = put(spark, place, 2)
    real = sinks.put_text

    def broken(spark, path, text):
        if path == place[1]:
            raise RuntimeError("cut off")
        real(spark, path, text)

    monkeypatch.setattr(sinks, "put_text", broken)
    with pytest.raises(RuntimeError):
        put(spark, place, 3)
    assert sinks._body(spark, place[1]) == full and spark.read.json(full["file"]).count() == 2


def test_market_collapse_blocks_promotion(spark, place):
    both = rows_of(spark, 10, "fouls").unionByName(rows_of(spark, 10, "cards"))
    full = sinks.publish(both, *place, ["id", "market"], AT, market="market")
    body = sinks.publish(rows_of(spark, 10, "fouls"), *place, ["id", "market"], AT, market="market")
    assert body["promotion_blocked"] == ["cards"] and sinks._body(spark, place[1])["file"] == full["file"]
    assert sinks.collapsed({"a": 2}, {"a": 8, "b": 7}) == ["a"] and sinks.collapsed({"a": 3}, {"a": 8}) == []


def test_unsound_pointers_are_not_resolved(spark, tmp_path):
    pointer = f"file://{tmp_path}/p.json"
    sinks.put_text(spark, pointer, json.dumps({"file": f"file://{tmp_path}/missing", "n": 10, "at": AT, "mode": "full"}))
    assert snapshots.resolve(spark, pointer, NOON) is None
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{cut')
    any_ = sinks.pointers(pointer)["any"]
    sinks.put_text(spark, any_, json.dumps({"file": f"file://{tmp_path}/bad.jsonl", "n": 2, "at": AT}))
    assert snapshots.resolve(spark, pointer, NOON) is None
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    sinks.put_text(spark, any_, json.dumps({"file": f"file://{tmp_path}/good.jsonl", "n": 2, "at": AT}))
    found = snapshots.resolve(spark, pointer, NOON)
    assert (found["pointer"], found["age_hours"], found["stale"]) == ("any", 1.5, True)
    assert snapshots.resolve(spark, pointer, NOON, prefer_full=False)["stale"] is False
    assert snapshots.resolve(spark, pointer, NOON, most_hours=1) is None
    sinks.put_text(spark, any_, json.dumps({"file": f"file://{tmp_path}/good.jsonl", "n": 2, "at": "no date"}))
    assert snapshots.resolve(spark, pointer, NOON)["age_hours"] is None
    assert snapshots.resolve(spark, pointer, NOON, most_hours=12) is None
    sinks.put_text(spark, any_, "{not json")
    assert snapshots.resolve(spark, pointer, NOON) is None


def test_two_writers_lose_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    add = lambda base, k: spark.range(k, k + 1) if base is None else base.union(spark.range(k, k + 1))
    assert sinks.head(spark, folder) == (0, None)
    seen = []

    def slow(base):
        if not seen:
            seen.append(sinks.persist(spark, folder, lambda now: add(now, 1)))
        return add(base, 2)

    assert sinks.persist(spark, folder, slow) == 2 and seen == [1]
    assert sorted(r.id for r in sinks.committed(spark, folder).collect()) == [1, 2]
    with pytest.raises(sinks.Conflict):
        sinks.persist(spark, folder, lambda base: (sinks.persist(spark, folder, lambda now: add(now, 9)), add(base, 3))[1], tries=2)
    assert len(list((tmp_path / "c").glob("gen=*"))) == 4  # two here, two in the lost tries


def t(h, m=0):
    return datetime.datetime(2024, 1, 1, h, m)


def stream_of(spark, tmp_path, batches):
    schema = "game long, house string, id long, ts timestamp, odd double, kickoff timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_late_rows_take_their_place_and_lines_close_by_time(spark, tmp_path):
    batches = [
        [(1, "h", 1, t(9), 1.9, t(12)), (1, "h", 2, t(10), 2.0, t(12)), (2, "h", 3, t(9), 1.5, None)],
        [(1, "h", 4, t(9, 30), 1.7, t(12))],  # late, within an hour
        [(3, "h", 5, t(14), 3.0, t(20))],  # event time passes 11:58 without a row of game 1
        [(1, "h", 6, t(13, 30), 9.0, t(12)), (3, "h", 7, t(13, 20), 3.2, None)],
        [(1, "h", 8, t(9, 45), 1.1, t(12)), (3, "h", 9, t(14), 3.0, None)],  # the first one is behind the watermark of the batch before
    ]
    out = keyed.run(keyed.instruments(stream_of(spark, tmp_path, batches), "1 hour"), f"file://{tmp_path}/run")
    got = {r.game: r for r in keyed.latest(out).collect()}
    one = got[1]
    assert (one.open_odd, one.open_ts, one.last_odd, one.last_ts, one.min_odd, one.max_odd, one.n_obs, one.n_moves, one.closed, one.close_odd) == (1.9, t(9), 2.0, t(10), 1.7, 2.0, 4, 2, True, 2.0)
    assert (got[2].n_obs, got[2].closed, got[2].close_odd) == (1, False, None)
    assert (got[3].open_odd, got[3].last_odd, got[3].n_obs, got[3].n_moves, got[3].closed) == (3.2, 3.0, 3, 1, False)
    ticks = [(r.id, r.kind, r.previous) for r in keyed.final_ticks(out).orderBy("game", "ts").collect()]
    assert ticks == [(1, "open", None), (4, "price", 1.9), (2, "price", 1.7), (3, "open", None)]  # time has come to 13:00, before the first row of game 3


def test_state_goes_after_its_days(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d, 9)
    batches = [[(1, "h", 1, day(1), 1.9, day(2)), (2, "h", 2, day(1), 1.5, None)], [(3, "h", 3, day(9), 2.0, None)], [(1, "h", 4, day(10), 5.0, None), (2, "h", 5, day(10), 5.0, None)]]
    out = keyed.run(keyed.instruments(stream_of(spark, tmp_path, batches), "1 hour", keep_days=3), f"file://{tmp_path}/run")
    again = {(r.game, r.n_obs, r.open_odd) for r in out.where("kind = 'state' AND shown = 1").collect()}
    assert {(1, 1, 5.0), (2, 1, 5.0)} <= again  # both keys began anew


def plain(rows):
    """Records of (key, ts, odd) seen once each."""
    best = {}
    for key, ts, odd in rows:
        best[key, ts] = max(odd, best.get((key, ts), 0))
    out = {}
    for (key, ts), odd in sorted(best.items(), key=lambda x: x[0]):
        r = out.setdefault(key, [odd, odd, odd, odd, 0, 0])
        r[5] += r[4] > 0 and abs(odd - r[1]) >= 0.01 - 1e-9
        r[1], r[2], r[3], r[4] = odd, max(r[2], odd), min(r[3], odd), r[4] + 1
    return {k: tuple(v) for k, v in out.items()}


def test_batches_in_any_order_and_twice(spark, tmp_path):
    rng = random.Random(4)
    seen = [(rng.choice(["a", "b", "c", None]), t(rng.randrange(24), rng.randrange(60)), rng.randrange(101, 140) / 100) for _ in range(120)]
    seen = list({(k, ts): (k, ts, o) for k, ts, o in seen}.values())
    batches = [[r for r in seen if rng.random() < 0.4] for _ in range(3)]
    batches.append(seen)
    get = lambda: {r.key or "": tuple(r[c] for c in ("open_odd", "last_odd", "max_odd", "min_odd", "n_obs", "n_moves")) for r in merge.records(spark, f"file://{tmp_path}/m", "key string").collect()}
    so_far = []
    for k, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, "key string, ts timestamp, odd double")
        so_far += batch
        for _ in range(2 if k == 1 else 1):
            merge.merge_batch(frame, k, f"file://{tmp_path}/m", "key string")
            assert get() == plain([(key or "", ts, odd) for key, ts, odd in so_far])
    merge.merge_batch(spark.createDataFrame(batches[0], "key string, ts timestamp, odd double"), 9, f"file://{tmp_path}/m", "key string")
    assert get() == plain([(key or "", ts, odd) for key, ts, odd in seen])


def test_retries_are_throttled(spark):
    hour = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp")
    schema = "id long, status string, result double, reason string, retryable boolean, last_attempt timestamp, attempts int, note string"
    rows = spark.createDataFrame([(1, "closed", None, None, None, None, 0, "x"), (2, "open", None, None, None, None, None, "y"), (None, "closed", None, None, None, None, None, "z"), (3, "unavailable", None, "final", False, None, 1, "w")], schema)
    none = spark.createDataFrame([], "id long, found double, why string")
    state, attempts = rows, []
    for h in (0, 3, 6, 7):
        state = settlement.attempt(state, none, "id", hour(h)).cache()
        attempts.append({r.id: (r.status, r.attempts) for r in state.collect()})
    assert [a[1] for a in attempts] == [("pending_result", n) for n in (1, 1, 2, 2)]
    assert attempts[-1][2] == ("open", None) and attempts[-1][3] == ("unavailable", 1) and attempts[-1][None] == ("pending_result", 2)
    changed = settlement.attempt(state, spark.createDataFrame([(1, None, "postponed")], none.schema), "id", hour(8)).where("id = 1").first()
    assert (changed.reason, changed.attempts) == ("postponed", 3)
    done = settlement.attempt(state, spark.createDataFrame([(1, 4.0, None)], none.schema), "id", hour(8)).where("id = 1").first()
    assert (done.status, done.result, done.reason, done.retryable, done.attempts, done.note) == ("settled", 4.0, None, False, 3, "x")


def test_older_stream_closes_by_time_and_keeps_late_rows_in_place(spark, tmp_path):
    from larkspur.streaming import ticks

    batches = [[(1, "h", 1, t(9), 1.9, t(12)), (1, "h", 2, t(10), 2.0, t(12))], [(1, "h", 3, t(9, 30), 1.7, t(12))], [(1, "h", 4, t(8, 59), 1.6, t(12)), (2, "h", 5, t(14), 3.0, None)]]
    seen = []
    stream = ticks.open_close(stream_of(spark, tmp_path, batches), "2 hours")
    stream.writeStream.outputMode("update").foreachBatch(lambda d, k: seen.extend((k, r) for r in d.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    last = [r for _, r in seen if r.game == 1][-1]
    assert (last.open_odd, last.open_ts, last.last_odd, last.last_ts, last.n_obs, last.closed) == (1.6, t(8, 59), 2.0, t(10), 4, True)
