"""Queries without SQL against plain Python on small tables."""

import itertools
import random

from larkspur import plans


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def indel(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(both + sorted(s - set(both))) for s in (x, y))
    scores = [indel(left, right)]
    if both:
        scores += [indel(" ".join(both), left), indel(" ".join(both), right)]
    return max(scores)


def test_names_of_all_pairs(spark, tmp_path):
    part = ["azure pale", "pale azure", "Pale  Azure", "red bolt", "bolt", "zinc red bolt", "ring", "x", None, "abc" * 25, "acb" * 24 + " bolt", "b" * 61, "ab" * 31]
    spark.createDataFrame([(i, x) for i, x in enumerate(part)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.a, r.b): r.score for r in plans.QUERIES["name_token_set_ratio"](spark, str(tmp_path)).collect()}
    distinct = sorted({" ".join(x.lower().split()) for x in (name or "" for name in part)})
    assert got == {(a, b): round(token_set_ratio(a, b), 6) for a, b in itertools.combinations(distinct, 2)}
    assert got["azure pale", "pale azure"] == 100


def test_components_of_all_orders(spark, tmp_path):
    rng = random.Random(13)
    orders = [(k, rng.randint(1, 150)) for k in rng.sample(range(1, 900), 60)] + [(97 * 9 + 4, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for key, customer in orders:
        if customer != key % 97 + 1:
            x, y = sorted((find(customer), find(key % 97 + 1)))
            root[y] = x
    got = {tuple(r) for r in plans.QUERIES["game_unify_all_orders"](spark, str(tmp_path)).collect()}
    assert got == {(x, find(x)) for x in root}
