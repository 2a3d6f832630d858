"""Jobs that survive a crash, a lost batch and a repeated run."""

import pytest
from pyspark.sql import functions as F

from sheafline.sources import files
from sheafline.streaming import recovery


class Fake:
    """A service that can fail before or after it takes a batch."""

    def __init__(self, fail=None, bad=()):
        self.batches, self.tokens, self.calls, self.fail, self.bad = {}, {}, 0, fail, bad

    def submit(self, jobs, token):
        if self.fail == "before":
            raise ConnectionError
        self.calls += 1
        name = self.tokens.setdefault(token, f"b{len(self.tokens)}")
        self.batches[name] = sorted((r.question, r.job) for r in jobs.collect())
        if self.fail == "after":
            raise ConnectionError
        return name

    def find(self, token):
        return self.tokens.get(token)

    def ended(self, batch):
        return True

    def results(self, spark, batch):
        kind = lambda q: dict(self.bad).get(q, "succeeded")
        rows = [(j, kind(q), "{}") for q, j in self.batches[batch] if kind(q) != "missing"]
        return spark.createDataFrame(rows, "job string, type string, payload string")


@pytest.fixture
def design(spark):
    return spark.createDataFrame([(c, f"q{i}") for c in "ab" for i in range(3)], "cell string, question string")


def run(spark, tmp_path, service):
    return recovery.Run(spark, f"{tmp_path}/log", f"{tmp_path}/results", service)


@pytest.mark.parametrize("fail", ["before", "after"])
def test_a_crash_doubles_nothing(spark, tmp_path, design, fail):
    service = Fake(fail)
    with pytest.raises(ConnectionError):
        run(spark, tmp_path, service).seed(design, 1)
    states = run(spark, tmp_path, service).states().groupBy("state").count().collect()
    assert [tuple(r) for r in states] == [("intended", 6)]
    service.fail = None
    s = run(spark, tmp_path, service).seed(design, 1)
    assert (s.adopted, s.sent_again) == ((6, 0) if fail == "after" else (0, 6)) and s.collected == 6 and s.submitted == 0
    assert len(service.tokens) == 1 and service.calls == 1
    assert run(spark, tmp_path, service).seed(design, 1) == (6, 0, 0, 0, 0)
    assert spark.read.parquet(f"{tmp_path}/results").count() == 6


def test_only_what_failed_goes_again(spark, tmp_path, design):
    service = Fake(bad=[("q0", "expired"), ("q1", "missing")])
    r = run(spark, tmp_path, service)
    assert r.seed(design, 1) == (0, 0, 0, 0, 6)
    with pytest.raises(recovery.SeedConflict):
        r.seed(design, 2, confirmed=True)
    s = r.seed(design, 1)
    assert (s.collected, s.submitted) == (2, 4)
    service.bad = ()
    assert r.seed(design, 1) == (2, 0, 0, 4, 0)
    assert {x.attempt for x in r.states().filter("question = 'q0'").collect()} == {2}
    with pytest.raises(recovery.SeedConflict):
        r.seed(design, 2)
    assert r.seed(design, 2, confirmed=True).submitted == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x|y"), (2, None)], "a int, b string")
    files.write_atomic(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ValueError):
        files.write_atomic(df, f"{tmp_path}/t")
    assert [r.line for r in files.markdown_table(df, ["a"]).orderBy("line_no").collect()] == ["| a | b |", "| --- | --- |", r"| 1 | x\|y |", "| 2 |  |"]
    pairs = spark.createDataFrame([(b"ab", b"abc"), (b"ab", b"ab"), (b"ab", b"a"), (b"ab", b"acb"), (b"", b"x")], "x binary, y binary")
    assert [r.k for r in pairs.select(files.prefix_kept(F.col("x"), F.col("y")).alias("k")).collect()] == [True, True, False, False, True]


def test_strict_csv_checks_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,"b,c"\n1,x\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('k,"b,c"\r\n2,y\r\n', encoding="utf-8")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("b,c", T.StringType())])
    assert sorted(tuple(r) for r in files.strict_csv(spark, f"{tmp_path}/*.csv", schema).collect()) == [(1, "x"), (2, "y")]
    for bad in ('k,b\n1,x\n', 'k,"b,c",d\n1,x,y\n', ""):
        (tmp_path / "c.csv").write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError, match="c.csv"):
            files.strict_csv(spark, f"{tmp_path}/*.csv", schema)
