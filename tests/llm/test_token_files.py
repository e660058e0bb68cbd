"""Plans of token counts: what has a row for each document is not broadcast, and blocks are read in many tasks."""

from larkspur.llm import q_token_files, token_files


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rows_of_documents_are_not_broadcast(spark, sf):
    text = plan(q_token_files.op5_token_counts(spark, sf))
    lines = text.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[at + 1 :]]
            end = next((k for k, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            assert not any("posexplode" in x or "sizes" in x or "doc_id" in x for x in below[:end]), line
    assert text.count("SortMergeJoin") >= 2


def test_blocks_are_read_in_many_tasks(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), 4000)], "path string, size long")
    blocks = token_files.dealt(token_files.blocks_of(spark, files, 2, block=10))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.rdd.glom().map(len).collect()
    assert len(rows) == parts and all(rows) and sum(rows) == 200
