"""Splits of identities read their records once for names and once for verdicts; where ticks go, against plain Python."""

import random

from larkspur import plans
from larkspur.operators import repair


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_records_are_read_and_dealt_out_once(spark, sf):
    for name, reads in (("identity_split_totals", 1), ("identity_split_records", 1), ("identity_split_ticks", 2)):
        text = plan(plans.QUERIES[name](spark, sf))
        assert sum("FileScan parquet" in line and "l_quantity" in line for line in text.splitlines()) == reads, name  # ticks are of records too
        wide = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "fixture" in line and "home" in line]
        assert not wide, name  # records meet what is known of their fixture where they are


def test_ticks_go_where_records_went(spark):
    rng = random.Random(3)
    keys = [(f"g{g}", h, m, line, s) for g in range(4) for h in "ab" for m in "xy" for line in (0.5, 1.5, None) for s in ("over", None)]
    gone = [(*k, rng.choice(["n1", "n2"]) if k[0] != "g1" else "n3") for k in keys if rng.random() < 0.5 and k[0] != "g3"]
    records = spark.createDataFrame([(to, *k, g) for g, *k, to in gone] + [("g9", "a", "x", 0.5, "over", None)], "game string, house string, market string, line double, side string, moved_from string")
    ticks = [(*k, kind, i) for i, (k, kind) in enumerate((k, kind) for k in keys for kind in ("open", "price", "line_move"))]
    out = repair.retargeted(spark.createDataFrame(ticks, "game string, house string, market string, line double, side string, kind string, i long"), records)
    got = {r.i: (r.game, r.retargeted) for r in out.collect()}
    assert len(got) == len(ticks)
    for *k, kind, i in ticks:
        if kind == "line_move":
            to = {t for *g, t in gone if g[:3] == k[:3]}
        else:
            to = {t for *g, t in gone if g == k and None not in g}
        to = min(to) if len(to) == 1 or kind != "line_move" and to else None
        assert got[i] == (to or k[0], to is not None), (k, kind)
    assert any(moved for _, moved in got.values())
