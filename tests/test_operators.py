import datetime

from pyspark.sql import functions as F

from larkspur.operators import feeds, gates, history, identity, ladder, matching
from larkspur.sources import sinks, snapshots


def at(minute):
    return datetime.datetime(2026, 7, 1, 12, 0) + datetime.timedelta(minutes=minute)


def test_ladder_reasons(spark):
    rows = spark.createDataFrame(
        [(1, 0, 2.5, 1.5, 2.6), (1, 1, 3.5, 1.9, 1.9), (1, 2, 3.5, 1.8, 1.9), (1, 3, 4.5, 1.2, 4.0), (1, 4, 5.5, 2.2, 2.2), (1, 5, 6.5, 60.0, 1.1), (1, 6, 7.5, None, 1.1)],
        "grp int, pos int, line double, over double, under double",
    )
    got = {r.pos: r.reason for r in ladder.sanitize(rows, ["grp"], ["pos"]).collect()}
    assert got == {0: None, 1: None, 2: "duplicate_line", 3: "mono_over", 4: "margin_low", 5: "odds_range", 6: "parse"}


def test_two_way_family_first(spark):
    rows = spark.createDataFrame([(1, "a", "Total 3-Vias", 73), (1, "b", "Escanteios Mais/Menos", 42)], "g int, family string, name string, lines int")
    assert ladder.pick_family(rows, ["g"]).first().family == "b"


def test_first_observation_is_no_move_and_late_rows_only_count(spark):
    ko = at(60)
    rows = spark.createDataFrame([("k", at(0), 2.0, ko), ("k", at(1), 2.0, ko), ("k", at(2), 2.1, ko), ("k", at(61), 9.0, ko)], "k string, ts timestamp, odd double, kickoff timestamp")
    r = history.fold(rows, ["k"]).first()
    assert (r.open_odd, r.last_odd, r.max_odd, r.n_obs, r.n_moves) == (2.0, 2.1, 2.1, 4, 1)


def test_merge_sums_and_keeps_settlement(spark):
    rows = spark.createDataFrame(
        [("k", "a", at(0), 2.0, at(5), 2.2, 2.3, 1.9, 3, 1, "open", None), ("k", "b", at(1), 2.1, at(4), 2.4, 2.4, 2.0, 2, 0, "settled", 7)],
        "k string, source string, open_ts timestamp, open_odd double, last_ts timestamp, last_odd double, max_odd double, min_odd double, n_obs int, n_moves int, status string, result int",
    )
    r = history.merge_records(rows, ["k"]).first()
    assert (r.open_odd, r.last_odd, r.n_obs, r.status, r.result, r.merged_from) == (2.0, 2.2, 5, "settled", 7, "a,b")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (9, 7)], "a long, b long")
    assert {tuple(r) for r in identity.unify(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (9, 5)}


def test_events_meet_fixtures(spark):
    day = datetime.date(2026, 7, 1)
    events = spark.createDataFrame([("e1", day, at(0), "sao paulo", "santos", None), ("e2", day, at(0), "other", "teams", None)], "event string, day date, kickoff timestamp, home string, away string, league string")
    fixtures = spark.createDataFrame([("f1", day, at(10), "santos", "sao paulo", "br-a"), ("f2", day, at(300), "sao paulo", "santos", "br-a")], "fixture string, day date, kickoff timestamp, home string, away string, league string")
    assert {r.event: r.fixture for r in matching.to_fixtures(events, fixtures).collect()} == {"e1": "f1", "e2": None}


def test_feed_pairs(spark):
    rows = spark.createDataFrame([("e", "Escanteios", 9.5, "over", 1.9, 0), ("e", "Escanteios", 9.5, "over", 5.0, 1), ("e", "Escanteios", 9.5, "under", 1.8, 2), ("e", "Escanteios", 10.5, "over", 2.2, 3)], "event string, market string, line double, side string, odd double, seq int")
    assert [tuple(r) for r in feeds.pairs(rows, ["event", "market"]).collect()] == [("e", "Escanteios", 9.5, 1.9, 1.8)]
    said = spark.range(1).select(feeds.market_of(F.lit("Total de Escanteios")).alias("m"), feeds.market_of(F.lit("Jogador: chutes")).alias("p"), feeds.side_of(F.lit("Mais de 5.5")).alias("s"), feeds.line_of(F.lit("Over 5.5")).alias("l"), feeds.line_of(F.lit("Over 5,5")).alias("q")).first()
    assert tuple(said) == ("Escanteios", None, "over", 5.5, None)


def test_gates(spark):
    count = lambda rows: spark.createDataFrame(rows, "market string, n long")
    assert [r.subject for r in gates.promotion_block(count([("a", 2), ("b", 9)]), count([("a", 10), ("b", 10), ("c", 9), ("d", 3)])).orderBy("subject").collect()] == ["a", "c"]


def test_snapshot_round_trip(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('{"casa":"h","event_id":"1","name":"A - B","start":"2026-07-14T10:00:00Z","mercados":{"Gols":[{"linha":2.5,"over":1.9,"under":1.9}]}}\n{broken\n{"casa":"h","event_id":"2"}\n')
    lines = snapshots.ladder_lines(snapshots.snapshot(spark, str(path), stale=True)).collect()
    assert [(r.event_id, r.market, r.line, r.stale) for r in lines] == [("1", "Gols", 2.5, True)]
    assert tuple(snapshots.valid_lines(spark, str(path)).first()) == (2, 3)


def test_publish_writes_the_pointer_last_and_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    first = sinks.publish(rows, str(tmp_path / "gen"), str(tmp_path / "latest.json"), ["a", "b"], "2026-07-14T10:00:00Z")
    again = sinks.publish(rows.orderBy("a", ascending=False), str(tmp_path / "gen"), str(tmp_path / "latest.json"), ["a", "b"], "2026-07-14T11:00:00Z")
    assert first["file"] == again["file"] and again["n"] == 2
    found = snapshots.pointer(spark, str(tmp_path / "latest.json"), "2026-07-14 15:00:00")
    assert found["stale"] and found["n"] == 2
    closed = sinks.publish(rows.limit(1), str(tmp_path / "gen"), str(tmp_path / "latest.json"), ["a", "b"], "2026-07-14T12:00:00Z", "close")
    assert snapshots.pointer(spark, str(tmp_path / "latest.json"), "2026-07-14 11:30:00")["n"] == 2 and closed["mode"] == "close"
