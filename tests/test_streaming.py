from __future__ import annotations

from scholia.streaming.incremental import arriving, check_stream


def test_each_file_is_judged_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("# imports\nimport os\n")
    check_stream(arriving(spark, source), out, state, once=True).awaitTermination(120)
    (tmp_path / "src/b.py").write_text("# TODO: x\ny = 1\n")
    (tmp_path / "src/c.txt").write_text("# imports\n")
    check_stream(arriving(spark, source), out, state, once=True).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.batch, r.path.rsplit("/", 1)[1], r.rule) for r in rows) == [(0, "a.py", "UC010"), (1, "b.py", "UC011")]
