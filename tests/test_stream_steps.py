"""Stream state as tables: no Python per key, batches run again, streams that go on, days that end before a row is final."""

import datetime
import inspect

from larkspur.streaming import keyed, ticks

SCHEMA = "game long, house string, id long, ts timestamp, odd double, kickoff timestamp"


def day(d, h=9):
    return datetime.datetime(2024, 1, d, h)


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    return keyed.instruments(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "1 hour", keep_days=3)


def test_no_call_of_python_for_a_key():
    for code in (keyed, ticks.price_ticks):
        assert not any(word in inspect.getsource(code) for word in ("InPandas", "pandas_udf", "StatefulProcessor"))


def test_last_odds_go_from_batch_to_batch(spark, tmp_path):
    rows = lambda *r: arrive(spark, tmp_path, [(1, "h", i, ts, odd, None) for i, ts, odd in r]) and spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    ticks.price_ticks(rows((2, day(2), 1.9), (1, day(1), 1.8), (3, None, 2.0), (4, day(2), None)), f"file://{tmp_path}/run")
    out = ticks.price_ticks(rows((5, day(1), 2.0), (6, day(3), 2.2)), f"file://{tmp_path}/run")
    # an odd that is missing opens the line anew
    assert sorted((r.id, r.kind, r.previous) for r in out.collect()) == [(1, "open", None), (2, "price", 1.8), (3, "open", None), (6, "price", 2.0)]


def test_stream_goes_on_and_rows_of_ended_states_stay_final(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    first = [(1, "h", 1, day(1), 1.9, None), (1, "h", 2, day(1, 10), 2.5, None), (2, None, 3, day(1), 1.5, day(1, 12))]
    keyed.run(arrive(spark, tmp_path, first), folder, ended=False)
    keyed.run(arrive(spark, tmp_path, [(3, "h", 4, day(9), 2.0, None)]), folder, ended=False)  # no row of the first part is final yet
    out = keyed.run(arrive(spark, tmp_path, [(1, "h", 5, day(10), 5.0, None)]), folder)
    ticks = sorted((r.id, r.kind, r.previous) for r in keyed.final_ticks(out).collect())
    assert ticks == [(1, "open", None), (2, "price", 1.9), (3, "open", None), (4, "open", None)]  # time has come to the tenth, eight o'clock
    got = {r.game: (r.open_odd, r.n_obs, r.closed) for r in keyed.latest(out).collect()}
    assert got == {1: (5.0, 1, False), 2: (1.5, 1, True), 3: (2.0, 1, False)}


def test_a_batch_run_again_replaces_what_it_wrote(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    of = arrive(spark, tmp_path, [(1, "h", 1, day(1), 1.9, None)])
    keyed.run(of, folder, ended=False)
    more = [(1, "h", 2, day(1, 12), 2.5, None), (1, "h", 3, day(1, 8), 2.1, None)]
    keyed.run(arrive(spark, tmp_path, more), folder, ended=False)
    before = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=repr)
    rows = spark.createDataFrame([(g, h, i, int(ts.replace(tzinfo=datetime.UTC).timestamp() * 1e6), o, None) for g, h, i, ts, o, _ in more], "game long, house string, id long, us long, odd double, kickoff_us long")
    keyed._step(rows, 4, of, folder, "out")
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=repr) == before
    last = keyed.latest(keyed.run(of, folder)).first()
    assert (last.open_odd, last.last_odd, last.n_obs, last.n_moves) == (2.1, 2.5, 3, 2)
