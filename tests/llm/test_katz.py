"""Katz backoff against a model of dictionaries, and its probabilities against one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import katz

SCHEMA = "doc_id long, text string, score string, block int, bucket int"


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


class Plain:
    """The same model, one dictionary a level."""

    def __init__(self, texts, order):
        self.order, self.counts, self.after = order, [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for text in texts:
            words = ["<s>"] * (order - 1) + tokens_of(text)
            for i in range(order - 1, len(words)):
                for k in range(order):
                    self.counts[k][tuple(words[i - k : i + 1])] += 1
                    self.after[k][tuple(words[i - k : i])] += 1
        self.rules = [katz.discounts([sum(1 for n in c.values() if n == r) for r in range(1, katz.SPECTRUM + 1)]) for c in self.counts]
        self.words = [w for (w,) in self.counts[0]]
        self.kept = {}

    def seen(self, gram):
        n = self.counts[len(gram) - 1][gram]
        return float(katz.discounted(np.array([n]), self.rules[len(gram) - 1])[0]) * n / self.after[len(gram) - 1][gram[:-1]]

    def weight(self, context):
        if context not in self.kept:
            grams = [g for g in self.counts[len(context)] if g[:-1] == context]
            self.kept[context] = (1 - sum(map(self.seen, grams))) / (1 - sum(self.seen(g[1:]) for g in grams if context))
        return self.kept[context]

    def p(self, gram):
        k, context = len(gram) - 1, gram[:-1]
        if self.counts[k][gram]:
            return self.seen(gram)
        lower = self.p(gram[1:]) if k else 1.0
        return lower * self.weight(context) if self.after[k][context] else lower

    def score(self, text):
        words = ["<s>"] * (self.order - 1) + tokens_of(text)
        return sum(math.log10(self.p(tuple(words[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(words)))


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(d, t if len(t) < 3000 else t[:3000]) for d, t in rows]
    hot = ["the same line"] * 40
    return [*rows, *((900 + i, t) for i, t in enumerate(hot)), (1, None), (None, "null id"), (None, ""), (7, "A  b\tÄ \x0b c"), (7, "x" * 300), (8, "nowhereseen word")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_dictionaries(spark, order):
    rows = corpus(spark)
    docs = spark.createDataFrame([(d, t, "own", 1, 2) for d, t in rows], SCHEMA).repartition(3)
    result = katz.score(docs, order, block_tokens=700, bucket_entries=900)
    got = sorted((repr(r.doc_id), r.n_tokens, r.held_out, r.n_known, round(r.base_score, 6), round(r.score, 6), r.train_tokens) for r in result.scores.collect())
    plain = Plain([t for d, t in rows if not held(d)], order)
    total, types = sum(plain.counts[0].values()), len(plain.counts[0])
    want = []
    for d, t in rows:
        words = tokens_of(t)
        base = sum(math.log10((plain.counts[0][(w,)] + 0.5) / (total + 0.5 * (types + 1))) for w in words)
        want.append((repr(d), len(words), held(d), sum(plain.counts[0][(w,)] > 0 for w in words), round(base, 6), round(plain.score(t), 6), total))
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in sorted(want)], atol=2e-6)
    # the stored tables hold every n-gram and every context, and each context's chances add up to one
    assert {(r.level, r["count"]): r.n for r in result.grams.groupBy("level", "count").agg(F.count("*").alias("n")).collect()} == Counter((k + 1, n) for k, c in enumerate(plain.counts) for n in c.values())
    weights = sorted((r.level, round(r.weight, 6)) for r in result.weights.collect())
    contexts = [(len(c) + 1, round(math.log10(plain.weight(c)), 6)) for k in range(order) for c in plain.after[k]]
    assert np.allclose(weights, sorted(contexts), atol=2e-6)
    for context in list(plain.after[order - 1])[:8]:
        assert abs(sum(plain.p((*context, w)) for w in [*plain.words, "never"]) - 1) < 1e-9


def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = katz.score(docs).scores.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b + 0.02 * abs(r.b)


def test_nothing_to_learn(spark):
    assert katz.score(spark.createDataFrame([], SCHEMA)).scores.collect() == []
    docs = spark.createDataFrame([(1, "a b", "", 0, 0)], SCHEMA)
    got = katz.score(docs, held=F.lit(True)).scores.collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]


def test_long_words_and_slices():
    words = ["w%d" % i for i in range(300_000)] + ["y" * (3 << 20)] + ["w5", "W5"]
    hashes = katz.token_hashes(" ".join(words))
    assert len(hashes) == len(words) + 1 and hashes[-2] == hashes[-3] == hashes[5] and len(set(hashes.tolist())) == 300_002
