"""The posterior against the labels, and against what all-must-pass filtering would do."""

from pyspark.sql import functions as F

from larkspur.llm import quality


def agreement(rows, column):
    return rows.where(F.col(column) == (F.col("quality") == 1)).count() / rows.count()


def test_posterior_agrees_with_labels_better_than_all_must_pass(spark):
    sf = "/root/testdata/sf0.01"
    figures = quality.measure(spark.read.parquet(f"{sf}/documents.parquet")).drop("_row").cache()
    judged = quality.judge(figures).withColumn("accused", F.expr(" OR ".join(f"{n} = -1" for n in quality.NAMES)))
    judged = judged.withColumn("likely", F.col("p_quality") >= 0.5).withColumn("unanimous", ~F.col("accused"))
    judged = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").cache()
    labelled = judged.where("quality IS NOT NULL")
    assert agreement(labelled, "likely") > 0.97
    assert agreement(labelled, "likely") > agreement(labelled, "unanimous") + 0.03
    assert judged.where("kept AND accused").count() > 20
    assert judged.where("NOT kept AND NOT base_failed").count() > 20


def test_outvoted_and_condemned(spark):
    names = quality.NAMES
    good, noisy = [1] * len(names), [-1 if n == "dup_lines" else 1 for n in names]
    junk = [-1 if n in ("symbols", "letters", "marked") else 1 for n in names]
    code = lambda votes: sum((v + 1) * 3**k for k, v in enumerate(votes))
    rows = [(code(good), 900), (code(noisy), 40), (code(junk), 60)]
    got = {r.pattern: r.p_quality for r in quality.fit(spark.createDataFrame(rows, "pattern int, n long")).collect()}
    assert got[code(good)] > 0.9 and got[code(noisy)] > 0.5 > got[code(junk)]


def test_empty_table(spark):
    assert quality.judge(quality.measure(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
