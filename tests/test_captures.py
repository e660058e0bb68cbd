"""Nested feeds, guards, manifests, parameters in pages, names of markets, gates: small tables and odd rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import sql_names
from larkspur.operators import gates, houses, repair
from larkspur.sources import artifacts, captures, nested, pages, sinks


def test_dictionary_and_flat_values(spark):
    docs = spark.createDataFrame([(1, '{"data": [{"id": 5, "name": "a", "x": {"id": 5, "name": "b"}}, {"id": 0, "name": "no"}, {"id": 6, "localNames": {"en": "e", "pt-BR": "p"}}, {"id": 7, "localNames": {"de": "d"}, "name": "n"}, {"id": 8, "name": null}]}'), (2, "not json"), (3, None), (4, "[]")], "k long, j string")
    assert {(r.key, r.id, r.name, r.depth) for r in nested.dictionary(docs, "k", "j").collect()} == {(1, "5", "b", 3), (1, "6", "p", 2), (1, "7", "d", 2)}
    lists = spark.createDataFrame([(1, "[3, [1, null, [[2]]], []]"), (2, "[]"), (3, "9")], "k long, j string")
    assert [(r.key, r.pos, r.value) for r in nested.flat_values(lists, "k", "j").orderBy("key", "pos").collect()] == [(1, 0, "3"), (1, 1, "1"), (1, 2, "2"), (3, 0, "9")]
    deep = spark.createDataFrame([(1, "[" * 70 + "1" + "]" * 70)], "k long, j string")
    with pytest.raises(ValueError, match="deeper"):
        nested.nodes(deep, "k", "j")


def test_guard_and_status(spark):
    captures.guard(4, 0)
    captures.guard(9, 1)
    with pytest.raises(captures.FormatChanged):
        captures.guard(5, 0)
    rows = {r.house: (r.ok, r.error_class, r.exit_code) for r in captures.finished(spark, {"a": (9, 9), "b": (9, 0), "c": (0, 0)}, 3).collect()}
    assert rows == {"a": (True, None, 0), "b": (False, "Parse", 2), "c": (False, None, 2)}


def test_manifest_names_what_changed(spark, tmp_path):
    folder = f"file://{tmp_path}/site"
    for name in ("a.js", "b.js", "data/c.js"):
        sinks.put_text(spark, f"{folder}/{name}", name)
    artifacts.publish_manifest(spark, folder, "2024-01-01T10:00:00Z")
    found = lambda now="2024-01-01 11:00:00": {(r.subject, r.reason) for r in artifacts.incoherent(spark, folder, now).collect()}
    assert found() == set()
    sinks.put_text(spark, f"{folder}/b.js", "B.js")
    (tmp_path / "site/data/c.js").unlink()
    sinks.put_text(spark, f"{folder}/d.js", "new")
    assert found() == {("b.js", "changed"), ("data/c.js", "absent"), ("d.js", "extra")}
    assert ("manifest.json", "old") in found("2024-01-01 17:00:00")


def test_parameters_of_odd_pages(spark):
    html = "<script>const T=`PL\t7\tx\t1.5\nBR\tno\ty`;\nconst CAL = [1, 2.5]; f(); beta: -0.25e1, </script>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "nothing"), (4, "const T=``; const CAL={")], "k long, html string")
    told = rows.select("k", pages.number_after(F.col("html"), "beta:").alias("beta"), pages.object_after(F.col("html"), "CAL", "array<double>").alias("cal"))
    assert {(r.k, r.beta, tuple(r.cal or ())) for r in told.collect()} == {(1, -2.5, (1.0, 2.5)), (2, None, ()), (3, None, ()), (4, None, ())}
    table = pages.table_rows(rows, "html", "T", [(0, "lg", "string"), (1, "id", "int"), (3, "v", "double")], ["k"])
    assert [tuple(r) for r in table.orderBy("lg").collect()] == [(1, "BR", None, None), (1, "PL", 7, 1.5)]


def test_names_of_markets(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("m")).first().m
    for f in (houses.colon_match, houses.exact_match, houses.plural_match, houses.colon_team, houses.exact_team, houses.plural_team):
        assert one(None, f) is None and one("", f) is None
    assert one("Total de Finalizações São João", houses.exact_team) == ("Finalizações", "São João")
    assert one("  Atlético total de faltas ", houses.plural_team) == ("Faltas", "Atlético")


def test_purity_of_small_tables(spark):
    schema = "game string, house string, market string, line double, side string, fixture long, home string, away string, method string, kickoff timestamp, status string, result long, close_odd double"
    rows = spark.createDataFrame([("g1", "h", "m", 2.5, "over", 1, "ajax", "porto", "pair", None, "settled", 3, 1.9), ("g1", "i", "m", 2.5, "over", 1, "fenerbahce", "galatasaray", "one_side", None, "settled", 4, None), ("g2", "h", "m", 2.5, "over", 2, "ajax", "porto", "pair", None, "open", None, None), ("g3", "h", "m", 2.5, "over", None, "", None, None, None, None, None, None)], schema)
    evidence = spark.createDataFrame([(1, 9, "fenerbahce", "galatasaray", None)], "fixture long, new_fixture long, new_home string, new_away string, new_kickoff timestamp")
    got = {(r.house, r.verdict): (r.game, r.status, r.result, r.reset) for r in repair.split(rows, evidence).where("fixture IS NULL OR fixture != 2").collect()}
    assert got["h", "keep"] == ("g1", "settled", 3, False) and got["h", "pure"][0] == "g3"
    assert got["i", "quarantine"] == ("?|fenerbahce|galatasaray", "open", None, True)  # the other game has no kickoff
    assert repair.impure(rows.where("fixture = 2")).collect() == []
    assert gates.purity(repair.name_clusters(rows.limit(0))).collect() == []


def test_sql_names_equal_columns(spark):
    sql_names.register(spark)
    r = spark.sql("SELECT poisson_over(2.4, 2.5) AS o, poisson_under(2.4, 2.5) AS u, poisson_push(2.4, 3.0) AS p, poisson_over(2.4, 3.0) + poisson_under(2.4, 3.0) + poisson_push(2.4, 3.0) AS all, american_to_decimal(-150) AS a, fair_odd(0.0, 0.0) AS f, margin(0.9, 2.0) AS m, negbin_size_cdf(3, 2.4, 5.0) AS n, negbin_size_cdf(3, 2.4, NULL) - poisson_cdf(3, 2.4) AS z").first()
    assert abs(r.o + r.u - 1) < 1e-12 and abs(r["all"] - 1) < 1e-12 and r.p > 0.2 and r.a == 1.67 and r.f is None and r.m is None and 0.7 < r.n < 0.8 and r.z == 0
