from pagewright.operators import probe
from pagewright.streaming.logs import keep_better, read_log


def test_log_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("STEP\tid=s1\nFAIL\tstep=x\tto")
    q = read_log(spark, str(tmp_path)).select("kind", probe.value("step").alias("step")).writeStream.format("memory").queryName("log_rows").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("log_rows").collect()} == {("STEP", None), ("FAIL", "x")}
    finally:
        q.stop()


def test_outcomes_never_get_worse(spark):
    s = "page long, outcome string, version int"
    old = spark.createDataFrame([(1, "Translated", 1), (2, "Failed", 1), (3, "Skipped", 1)], s)
    new = spark.createDataFrame([(1, "Failed", 2), (2, "Translated", 2), (3, "Failed", 2), (4, "Skipped", 2)], s)
    got = {r["page"]: r["outcome"] for r in keep_better(old, new).collect()}
    assert got == {1: "Translated", 2: "Translated", 3: "Failed", 4: "Skipped"}
