"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes good (1), bad (-1) or abstains (0). Junk comes in kinds that other rules see, so the model has one
class of good documents and one for each of KINDS. In every class a rule that votes accuses with a chance of its own,
estimated on both sides of the question by expectation-maximisation with weak Beta priors, which only say
where the search begins. The histogram of vote patterns, at most 3 ** (number of rules) rows whatever the input, is all that it
reads. A document is kept if its posterior probability of being good reaches a threshold: one noisy rule is outvoted,
several weak ones together condemn.

DataFrame functions only. A null text has no words; it and the empty text fail the base rules. Repeated rows count as
rows of their own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, WORD, let, materialize

SYMBOLS = "#*$%&|<>"
#: ASCII characters that are no letters, in syntax that Java and RE2 share.
NO_LETTERS = r"[\x00-@\[-`{-\x7F]+"
WINDOW = 5
#: Rounds of expectation-maximisation.
ROUNDS = 12
#: Weight of each prior, in documents.
PRIOR_WEIGHT = 10.0
#: Prior chance that a rule which votes accuses a good document, and one of junk of a kind that it sees or does not see.
ACCUSES_GOOD, SEES, MISSES = 0.05, 0.7, 0.2
#: Kinds of junk, by the rules that are to see them, and the prior share of good documents and of each kind.
KINDS = (("word_size", "symbols", "letters", "marked", "upper", "marks"), ("dup_lines", "repeats", "variety"))
SHARES = (0.8, 0.1, 0.1)
THRESHOLD = 0.5


def words_of(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def counted(text: Column, chars: str) -> Column:
    """Characters of text that are in the regular expression's class chars."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 5 words found twice or more, first finds included.

    Windows are compared by 64-bit hashes within one text. Sorting (hash, start) brings equal windows
    together; the starts of repeated ones, sorted again, give the union of the windows' words.
    """

    def from_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, from_windows)

    def from_windows(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, from_ordered))

    def from_ordered(s: Column) -> Column:
        same = lambda v, k: (F.get(s, k - 1)["x"] == v["x"]) | (F.get(s, k + 1)["x"] == v["x"])
        starts = F.array_sort(F.transform(F.filter(s, lambda v, k: F.coalesce(same(v, k), F.lit(False))), lambda v: v["i"]))
        return let(starts, covered)

    def covered(p: Column) -> Column:
        spans = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(spans, F.lit(0), lambda a, v: a + v)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the whole row as _row, the base figures and what the rules vote on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    base = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("text"))
    figures = F.struct(
        let(
            words_of(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                F.size(F.filter(w, lambda x: x.rlike(f"[{SYMBOLS}]"))).cast("long").alias("n_marked"),
            ),
        ).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        counted(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.length(F.regexp_replace("text", NO_LETTERS, "")).cast("long").alias("n_letters"),
        counted(F.col("text"), "A-Z").alias("n_upper"),
        counted(F.col("text"), "!?").alias("n_marks"),
    )
    return base.select("doc_id", "_row", let(figures, lambda f: f).alias("f")).select(
        "doc_id", "_row", "f.w.n_words", "f.w.word_chars", "f.n_symbols", "f.l.n_dup_lines", "f.w.n_repeat_words",
        "f.l.n_lines", "f.w.n_distinct", "f.w.n_marked", "f.n_letters", "f.n_upper", "f.n_marks",
    )


#: Rules as SQL over the figures: (name, bad if, good if); the first that holds counts, else the rule abstains.
#: Comparisons are of whole numbers, so that every engine agrees. Some accuse good documents too; the fit says how often.
RULES = [
    ("length", "n_words < 20", "n_words >= 60"),
    ("word_size", "word_chars < 3 * n_words OR word_chars > 10 * n_words", "word_chars BETWEEN 4 * n_words AND 8 * n_words"),
    ("symbols", "20 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("letters", "20 * n_letters < 17 * word_chars", "100 * n_letters >= 95 * word_chars"),
    ("marked", "5 * n_marked > n_words", "20 * n_marked <= n_words"),
    ("upper", "5 * n_upper > word_chars", "12 * n_upper <= word_chars"),
    ("marks", "20 * n_marks > n_words", "n_marks = 0"),
    ("dup_lines", "n_dup_lines > 0", "n_dup_lines = 0 AND n_lines > 1"),
    ("repeats", "5 * n_repeat_words > n_words", "n_repeat_words = 0 AND n_words >= 30"),
    ("variety", "5 * n_distinct < 2 * n_words", "2 * n_distinct >= n_words AND n_words >= 30"),
]
NAMES = [n for n, _, _ in RULES]
#: Prior chances of an accusation: a list for each class, good documents first.
PRIORS = [[ACCUSES_GOOD] * len(NAMES), *([SEES if n in kind else MISSES for n in NAMES] for kind in KINDS)]


def vote(bad: str, good: str) -> Column:
    return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")


def pattern(names: list[str]) -> Column:
    """The votes as one number in base 3."""
    return sum(((F.col(n) + 1) * 3**k for k, n in enumerate(names)), F.lit(0)).cast("int")


def doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def posteriors(votes: Column, model: Column) -> Column:
    """The chance of each class, given the votes."""

    def evidence(accuses: Column) -> Column:
        return total(F.zip_with(votes, accuses, lambda v, a: F.when(v == -1, F.log(a)).when(v == 1, F.log(1 - a)).otherwise(0.0)))

    def normal(logs: Column) -> Column:
        return let(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(F.zip_with(model["shares"], model["accuses"], lambda share, a: F.log(share) + evidence(a)), normal)


def fit(patterns: DataFrame) -> DataFrame:
    """patterns(pattern, n), one row a pattern, to (pattern, p_quality): the posterior after EM.

    The patterns, at most 3 ** len(RULES), are folded in one row; each round of EM is a fold over them.
    """
    m, classes = len(NAMES), len(PRIORS)
    votes = F.array(*[(F.floor(F.col("pattern") / 3**k) % 3 - 1).cast("int") for k in range(m)])
    table = F.sort_array(F.collect_list(F.struct("pattern", votes.alias("v"), F.col("n").cast("double").alias("n"))))
    one = patterns.agg(table.alias("t")).where(F.size("t") > 0)

    def maximised(rows: Column) -> Column:
        """The model that rows(v, w), w the documents of the pattern by class, make likeliest."""

        def share(c: int) -> Column:
            mass = total(F.transform(rows, lambda r: r["w"][c]))
            every = total(F.transform(rows, lambda r: total(r["w"])))
            return (mass + SHARES[c] * PRIOR_WEIGHT) / (every + PRIOR_WEIGHT)

        def accuses(c: int, k: int) -> Column:
            bad = total(F.transform(rows, lambda r: F.when(r["v"][k] == -1, r["w"][c]).otherwise(0.0)))
            cast = total(F.transform(rows, lambda r: F.when(r["v"][k] != 0, r["w"][c]).otherwise(0.0)))
            return (bad + PRIORS[c][k] * PRIOR_WEIGHT) / (cast + PRIOR_WEIGHT)

        return F.struct(
            F.array(*[share(c) for c in range(classes)]).alias("shares"),
            F.array(*[F.array(*[accuses(c, k) for k in range(m)]) for c in range(classes)]).alias("accuses"),
        )

    def step(t: Column, model: Column) -> Column:
        weighed = F.transform(t, lambda p: F.struct(p["v"].alias("v"), F.transform(posteriors(p["v"], model), lambda q: q * p["n"]).alias("w")))
        return let(weighed, maximised)

    start = F.struct(doubles(SHARES).alias("shares"), F.array(*[doubles(p) for p in PRIORS]).alias("accuses"))
    fitted = let(F.col("t"), lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: step(t, s)))
    model = one.select("t", fitted.alias("model"))
    return model.select(F.explode("t").alias("p"), "model").select(
        F.col("p.pattern").alias("pattern"), F.get(posteriors(F.col("p.v"), F.col("model")), F.lit(0)).alias("p_quality")
    )


def judge(figures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Figures of measure() with base_failed, kept, p_quality and each rule's vote.

    figures is read twice, for the histogram and for the verdicts: hand in a materialized frame.
    """
    voted = figures.withColumns({n: vote(bad, good) for n, bad, good in RULES}).withColumn("pattern", pattern(NAMES))
    fitted = fit(voted.groupBy("pattern").agg(F.count("*").alias("n")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # at most 3 ** 10 patterns: a proven bound for the broadcast
    return voted.join(F.broadcast(fitted), "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("p_quality") >= threshold)).alias("kept"),
        F.round("p_quality", 6).alias("p_quality"),
        *NAMES,
        *[c for c in figures.columns if c == "_row"],
    )


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, as they were. They are written once with their figures, never shuffled."""
    return judge(materialize(measure(docs), "quality"), threshold).where("kept").select("_row.*")
