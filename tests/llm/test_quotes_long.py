"""Quotes: texts of many lines, conversations of many chunks, repeated places, an empty table, and planted quotes against the SQL."""

import random
import time

import duckdb
import pytest

from larkspur.llm import q_quotes, quotes
from tests.compare import same

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [3, 1000])
def test_planted_quotes_equal_sql(spark, monkeypatch, chunk):
    rng = random.Random(5)
    said = lambda: "\n".join(" ".join(rng.choice("abcdefg") * rng.randint(1, 5) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 3)))
    rows, planted = [], 0
    for conv in range(25):
        talk = []
        for turn in range(rng.randint(1, 12)):
            own = text = said()
            if talk and rng.random() < 0.6:
                text = "\n".join("> " + line for line in rng.choice(talk).split("\n")) + "\n" + own
                planted += 1
            talk.append(own)
            rows.append((conv, turn, rng.choice(["a", "b", None]), text))
    rows += rows[:7] + [(None, 1, "a", "x"), (3, None, "a", "x"), (4, 50, "a", None)]
    monkeypatch.setattr(quotes, "CHUNK", chunk)
    monkeypatch.setattr(q_quotes, "SQL", q_quotes.SQL.replace("// 1000 AS chunk", f"// {chunk} AS chunk"))
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS chunk", "3 AS _at")
    conversations = d.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841  the SQL reads it by name
    talks = quotes.conversations(d)
    same(talks, duckdb.connect().execute(q_quotes.SQL))
    assert sum(r.n_linked for r in talks.collect()) >= planted


def test_a_hot_turn_is_cut_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK", 10)
    rows = [(1, 7, "a", f"m{k:03d}") for k in range(95)] + [(1, 3, "b", "first")]
    got = sorted(quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.chunk)
    assert [r.n_messages for r in got] == [10] * 9 + [6] and got[0].chat.startswith("<|b|>\nfirst\n<|a|>\nm000")
    assert quotes.conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_time_is_linear_in_lines(spark):
    def took(n):
        rows = [(1, 0, "a", "\n".join(f"line {k}" for k in range(n))), (1, 1, "b", "\n".join(f"> line {k}\nanswer {k}" for k in range(n)))]
        began = time.perf_counter()
        assert quotes.linked_messages(spark.createDataFrame(rows, SCHEMA)).where("turn = 1").first().n_linked == n
        return time.perf_counter() - began

    took(100)
    assert took(16000) < 3 * took(8000) + 2
