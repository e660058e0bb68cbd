"""Atomic pointers, months, generations, manifests, and keyed stream state."""

import datetime
import json
import uuid

import pytest

from larkspur.sources import sinks
from larkspur.streaming import ticks


def test_pointer_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/p.json"
    for body in ("one", "two"):
        sinks.put_text(spark, path, body)
        assert (tmp_path / "p.json").read_text() == body
    assert not (tmp_path / "p.json.tmp").exists()


def test_months_keep_other_keys(spark, tmp_path):
    path = f"file://{tmp_path}/months"
    rows = lambda *r: spark.createDataFrame([(k, datetime.datetime(2024, m, 3), v) for k, m, v in r], "key string, kickoff timestamp, v int")
    sinks.upsert_months(rows(("a", 1, 1), ("b", 1, 2), ("c", 2, 3)), path, keys=["key"])
    before = {f.name for f in (tmp_path / "months" / "month=2024-02").iterdir()}
    sinks.upsert_months(rows(("a", 1, 9), ("c", 2, 3), ("d", 3, 4)), path, keys=["key"])
    got = {(r.key, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 9), ("b", 2), ("c", 3), ("d", 4)}
    assert {f.name for f in (tmp_path / "months" / "month=2024-02").iterdir()} == before  # nothing changed there
    sinks.append_months(rows(("e", 3, 5)), path)
    assert spark.read.parquet(path).where("month = '2024-03'").count() == 2


def test_two_generations_stay(spark, tmp_path):
    folder = f"file://{tmp_path}/gens"
    for k in range(4):
        sinks.publish(spark.range(k + 1), folder, f"file://{tmp_path}/latest.json", ["id"], "now")
    assert len(list((tmp_path / "gens").glob("gen=*"))) == 2
    last = json.loads((tmp_path / "latest.json").read_text())
    assert last["n"] == 4 and spark.read.json(last["file"]).count() == 4


def test_manifest(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = spark.createDataFrame([("a", "x", 3, at(0)), ("b", "y", 4, at(30))], "name string, sha256 string, n int, ts timestamp")
    assert sinks.manifest(rows, f"file://{tmp_path}/m.json", "now")["spread_minutes"] == 30
    assert [a["name"] for a in json.loads((tmp_path / "m.json").read_text())["artifacts"]] == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.manifest(rows.unionByName(spark.createDataFrame([("c", "z", 1, at(59))], rows.schema)), f"file://{tmp_path}/n.json", "now")


def test_open_close_state(spark, tmp_path):
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "game long, house string, id long, ts timestamp, odd double, kickoff timestamp"
    batches = [
        [(1, "h", 1, t(9), 1.9, t(12)), (1, "h", 2, t(10), 2.0, t(12)), (2, "h", 3, t(9), 1.5, None)],
        [(1, "h", 4, t(11), 2.0, t(12)), (1, "h", 5, t(12), 9.0, t(12))],
        [(1, "h", 6, t(11, 30), 1.2, t(12))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in")
    name = f"s{uuid.uuid4().hex[:8]}"
    ticks.open_close(stream).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r.game, r.n_obs): (r.open_odd, r.last_odd, r.min_odd, r.max_odd, r.n_moves, r.closed) for r in spark.table(name).collect()}
    assert got[1, 2] == (1.9, 2.0, 1.9, 2.0, 1, False) and got[2, 1] == (1.5, 1.5, 1.5, 1.5, 0, False)
    assert got[1, 4] == (1.9, 2.0, 1.9, 2.0, 1, True)
    assert got[1, 5] == got[1, 4]  # closed: it only counts
