"""Hand-computed values, decision tables and edge cases of the reusable operators."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions import text as fx
from sheafline.operators import chunks, decision, integrity, joins, order, quality, sample, stats
from sheafline.sources import files
from sheafline.streaming import jobs


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


CANON = [
    ("1,234", "1234"), ("−5.0", "-5.0"), ("–7", "-7"), ("12*", "12"), ("3�5", "3.5"), ("�5", "0.5"), ("(4.2)", "-4.2"), (".5", "0.5"), ("-.5", "-0.5"),
    ("-0", "0"), ("1.2.3", None), ("abc", None), ("", None), (" 8 ", "8"), ("12**", "12"),
]


@pytest.mark.parametrize("raw,want", CANON)
def test_canon(spark, raw, want):
    assert one(spark, fx.canon(F.col("a")), a=raw) == want


GUARD = [
    ("the total was 12.5 today", "12.5", True), ("it was 112.5", "12.5", False), ("12.55", "12.5", False), ("1,234", "234", False), ("-5", "5", False), ("5.", "5", True),
    ("5, 6", "5", True), ("5,6", "5", False), ("a 5 then 15", "5", True), ("5%", "5", True), ("1.5", "5", False), ("x(5)", "5", True),
]


@pytest.mark.parametrize("text,value,want", GUARD)
def test_occurs(spark, text, value, want):
    assert one(spark, fx.occurs(F.col("t"), F.col("v")), t=text, v=value) is want


def test_numeric_match_minus(spark):
    m = lambda g, a: tuple(one(spark, fx.numeric_match(F.col("g"), F.col("a")), g=g, a=a))
    # A sign is part of a number: these asserted the opposite before.
    assert m("-5", "fell by 5 percent") == (False, False)
    assert m("-5", "at −5 percent") == (True, True)
    assert m("–106.3", "net borrowing was -106.3 billion") == (True, True)
    assert m("–106.3", "net borrowing was (106.3) billion") == (False, False)
    assert m("-106.3", "-106.3") == (True, False) and m("106.3", "(106.3)") == (True, False)
    assert m("5", "about 6") == (False, False) and m("", "any 5") == (False, False)
    assert one(spark, fx.contained(F.col("a"), F.col("b")), a="Gross  Product", b="the gross product rose") is True


def test_flags_scores_fences(spark):
    assert [one(spark, fx.strip_flags(F.col("a")), a=x) for x in ("R 5.2", "5.2 RE", "5.2", "RENT")] == ["5.2", "5.2", "5.2", "RENT"]
    assert one(spark, fx.last_score(F.col("a")), a="<score>no</score> <score>yes</score>") == "yes"
    assert one(spark, fx.last_score(F.col("a")), a="none") is None
    assert one(spark, fx.strip_fence(F.col("a")), a='```json\n{"a": 1}\n```') == '{"a": 1}'


def ratings(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b, n in pairs for _ in range(n)], "a int, b int")


def test_kappa(spark):
    k = lambda p: stats.kappa(ratings(spark, p), [], "a", "b").first().kappa
    assert k([(1, 1, 2), (0, 0, 2), (1, 0, 1), (0, 1, 1)]) == pytest.approx(1 / 3)
    assert k([(1, 1, 3), (1, 0, 3)]) == 0
    assert k([(1, 1, 5)]) is None


def test_auroc(spark):
    a = lambda rows: stats.auroc(spark.createDataFrame(rows, "s double, y int"), [], "s", "y").first().auroc
    assert a([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)]) == 3.5 / 4
    assert a([(1.0, 1), (2.0, 1)]) is None


def test_intervals(spark):
    w = spark.createDataFrame([(0.0, 0.0), (23.0, 25.0)], "k double, n double").select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert tuple(w[0].w) == (0.0, 0.0)
    assert [round(x, 2) for x in w[1].w] == [0.75, 0.98]
    assert [round(x, 2) for x in stats.exact_interval(5, 5)] == [0.48, 1.0]
    assert stats.exact_interval(0, 0) == (0.0, 1.0)
    assert stats.two_sided_mcnemar(0, 0) == 1.0 and stats.two_sided_mcnemar(0, 5) == pytest.approx(0.0625)


CHOICES = [
    ([("a", 8, 8, 6, 8, True), ("b", 8, 8, 5, 5, True)], ("a", "only one")),
    ([("a", 8, 8, 1, 8, True), ("b", 8, 8, 1, 8, True)], (None, "none eligible")),
    ([("a", 8, 8, 6, 8, False), ("b", 8, 8, 6, 8, True)], ("b", "only one")),
    ([("a", 0, 8, 0, 8, True), ("b", 0, 8, 0, 7, True)], ("b", "empty class")),
    ([("a", 8, 10, 6, 9, True), ("b", 8, 10, 5, 9, True)], ("b", "one claim apart")),
    ([("a", 4, 8, 4, 7, True), ("b", 4, 8, 3, 8, True)], ("a", "better")),
    ([("a", 10, 10, 6, 10, True), ("b", 10, 10, 8, 8, True)], ("b", "tie")),
]


@pytest.mark.parametrize("rows,want", CHOICES)
def test_verifier_choice(spark, rows, want):
    df = spark.createDataFrame(rows, "name string, k long, m long, tp long, tn long, scored boolean")
    r = decision.choose_verifier(df, "b").first()
    assert (r.choice, r.rule) == want


@pytest.mark.parametrize("rows,want", [([("a", 6, 10), ("b", 5, 10)], "GO"), ([("a", 3, 6), ("b", 2, 5)], "GO, TUNE"), ([("a", 1, 3), ("b", 2, 6)], "STOP"), ([("a", 1, 3), ("b", 0, 0)], "NO-GO CANDIDATE")])
def test_branch(spark, rows, want):
    df = spark.createDataFrame([(v, "m", n, d) for v, n, d in rows], "v string, mode string, n long, d long")
    assert decision.branch(df, "v", "mode", "n", "d").first().branch == want


def test_multiset_and_division(spark):
    want = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "x", 3), (1, "y", 4)], "g int, v string, o int")
    have = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "g int, v string")
    got = {r.o: r.admitted for r in joins.multiset_match(want, have, ["g"], "v", "o").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    need = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, i string")
    off = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "s string, i string")
    assert {(r.k, r.s, r.n_candidates) for r in joins.divide(need, off, "k", "s", "i").collect()} == {(1, "p", 1), (2, "p", 2), (2, "q", 2)}


def test_asof_reset_and_barrier(spark):
    df = spark.createDataFrame([("k", 1, "w"), ("k", 2, "p"), ("k", 3, "w"), ("k", 4, "r"), ("k", 5, "p"), ("k", 6, "w")], "k string, n int, e string")
    is_ = lambda c: F.col("e") == c
    f = joins.asof_forward(df, "k", ["n"], is_("w"), is_("p"), is_("r"), "n").collect()
    assert {(r.n, r.next_n) for r in f} == {(1, 2), (3, None), (6, None)}
    b = joins.asof_backward(df, "k", ["n"], is_("w"), is_("p"), is_("r"), "n").collect()
    assert {(r.n, r.blocked, r.last_n) for r in b} == {(1, False, None), (3, False, 2), (6, False, 5)}


def test_overlaps_count_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (2, 95, 96)], "i int, a0 int, a1 int").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(1, 5, 99), (2, 100, 120)], "j int, b0 int, b1 int").withColumn("k", F.lit(1))
    got = [(r.i, r.j) for r in joins.overlaps(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 10).collect()]
    assert sorted(got) == [(1, 1), (2, 1)]


def test_order_operators(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 3, 9), ("k", 9, 10), ("k", 20, 30)], "k string, x0 int, x1 int")
    assert sorted((r.x0, r.x1, r.n) for r in order.merge_intervals(df, "k", "x0", "x1").collect()) == [(0, 10, 3), (20, 30, 1)]
    c = order.gap_clusters(df, "k", ["x0"], F.col("x0"), 5).collect()
    assert [r.cluster for r in sorted(c, key=lambda r: r.x0)] == [0, 0, 1, 2]


def test_draws_do_not_depend_on_layout(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k for r in sample.draw(df, 20, "7", "s", "k").collect()}
    b = {r.k for r in sample.draw(df.repartition(13).orderBy(F.desc("k")), 20, "7", "s", "k").collect()}
    assert a == b and len(a) == 20
    assert sample.draw(df.limit(3), 20, "7", "s", "k").count() == 3


def test_missing_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        quality.thin_unit_exclusion(spark.range(1), "id", 1, None, 1)


def test_chunks_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "s", "l", None), (2, "s", "l", ""), (3, "s", "l", "a\n\n|b|\n")], "doc_id long, source string, lang string, text string")
    rows = {r.chunk_id: r.chunk_type for r in chunks.chunk_records(docs).collect()}
    assert rows == {"doc3::p0::ln0::s0": "prose", "doc3::p0::ln2::s1": "table"}


def test_two_way_diff_counts_copies(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in integrity.two_way_diff(a, b).collect()) == [(1, "only_a"), (2, "only_a"), (3, "only_b")]


def test_files(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"record": "header", "n": 1}\n\n{"record": "unit", "n": 2}\n{"record": "unit", "n": 3, "odd": 1}\n')
    schema = T.StructType([T.StructField("record", T.StringType()), T.StructField("n", T.LongType())])
    head, rows = files.header_and_rows(files.json_lines(spark, str(p), schema), "record", "header")
    assert (head.count(), rows.count()) == (1, 2)
    assert [r.unknown for r in files.unknown_keys(spark, str(p), schema).collect()] == ["odd"]
    c = tmp_path / "a.csv"
    c.write_text("﻿record,n\nx,1\n")
    assert files.strict_csv(spark, str(c), schema).first().n == 1
    c.write_text("n,record\n1,x\n")
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(c), schema)
    log = tmp_path / "l.log"
    log.write_bytes("größe".encode("utf-16"))
    assert files.log_text(spark, str(log)).first().text == "größe"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink = str(tmp_path / "sink")
    files.append_new(df, sink, "k")
    files.append_new(df.unionByName(spark.createDataFrame([(3, "c"), (3, "c")], "k int, v string")), sink, "k")
    assert spark.read.parquet(sink).count() == 3
    once = str(tmp_path / "once")
    assert [files.write_once(df, once), files.write_once(df.orderBy(F.desc("k")), once)] == ["written", "unchanged"]
    with pytest.raises(ValueError):
        files.write_once(df.limit(1), once)
    assert sorted(r.line for r in files.render(df.select("v", "k")).collect())[0] == '{"k":1,"v":"a"}'
    assert spark.createDataFrame([(bytearray(b"%PDF-1.7"),)], "b binary").select(files.magic(F.col("b")).alias("m")).first().m == "pdf"


def machine(rows):
    import pandas as pd

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

    s, out = State(), None
    for batch in rows:
        out = next(jobs._advance(("j",), iter([pd.DataFrame(batch, columns=["offset", "state"])]), s))
    return tuple(out.iloc[0])


JOBS = [
    ([[(1, "pending"), (2, "intended"), (3, "submitted"), (4, "completed")]], ("j", "completed", 1, 0)),
    ([[(1, "pending"), (2, "intended")], [(2, "intended"), (3, "intended")]], ("j", "intended", 0, 0)),  # a crash before sending
    ([[(1, "pending"), (2, "intended"), (3, "submitted"), (4, "expired"), (5, "intended"), (6, "submitted")]], ("j", "submitted", 2, 0)),
    ([[(1, "pending"), (2, "completed"), (3, "intended"), (4, "submitted"), (5, "errored")]], ("j", "errored", 1, 1)),
    ([[(1, "pending"), (2, "intended"), (3, "submitted"), (4, "completed")], [(5, "submitted")]], ("j", "completed", 1, 1)),
]


@pytest.mark.parametrize("rows,want", JOBS)
def test_job_machine(rows, want):
    assert machine(rows) == want


def test_stream_equals_batch(spark):
    from sheafline.plans import catalog

    sf = "/root/testdata/sf0.001"
    stream, batch = (sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) for n in ("stream_last_state", "job_last_state"))
    assert stream == batch


def test_idempotent_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "job string, v int")
    assert [jobs.write_once(df, str(tmp_path / "r")), jobs.write_once(df, str(tmp_path / "r"))] == [1, 0]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert len(jobs.token(df.selectExpr("job", "1 as attempt").distinct()).first().token) == 32


def test_line_and_key_functions(spark):
    assert one(spark, fx.unit_line(F.col("a")), a="[million tons]") and not one(spark, fx.unit_line(F.col("a")), a="[a] b")
    assert one(spark, fx.item_key(F.col("a")), a="#/tables/2") == "tbl-2" and one(spark, fx.item_key(F.col("a")), a="#/texts/7") == "txt-7"
    assert one(spark, fx.without_backspace(F.col("a")), a="a\bb") == "ab" and one(spark, fx.broken_number(F.col("a")), a="3�5") is True
    assert one(spark, fx.rejoined(F.col("a")), a="3 .349") == "3.349"
    assert [one(spark, fx.footer_line(F.col("a")), a=x) for x in ("Source: x", "Notes. y", "1/ Estimated", "Coal 5")] == [True, True, True, False]
    assert tuple(one(spark, fx.period(F.col("a")), a="M:2024-07")) == ("M", 2024, 7) and tuple(one(spark, fx.period(F.col("a")), a="M:2024-13")) == (None, None, None)


def test_words_of_lines(spark):
    rows = [(1, "a b a\n| a | b |\nb\x0b c|\n\n a"), (1, "a\r| b\n|"), (2, "| x |"), (3, " \t\n| |"), (4, ""), (5, None), (6, " \n "), (None, "a b\n|c"), (7, "a\x85|b c\nd"), (8, "|\n|\nz z")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = sorted(map(tuple, joins.line_overlap(df, "k", "t", "|").collect()), key=repr)
    words = lambda c: df.filter("k is not null").select("k", F.explode(chunks.tokens(c)).alias("v"))
    plain = joins.multiset_overlap(words(F.col("t")), words(F.regexp_replace("t", r"[^\n]*[|][^\n]*", "")), ["k"], "v")
    assert got == sorted([*map(tuple, plain.collect()), (None, 3, 0, 3)], key=repr)
    assert got[0] == (1, 15, 4, 11)


def test_conservation_of_long_lines(spark, tmp_path):
    import time

    from sheafline.plans import catalog

    line = "word " * 60_000
    spark.createDataFrame([(1, line), (2, f"{line}\n{line}|\nend"), (None, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {tuple(r) for r in catalog.QUERIES["word_conservation"](spark, str(tmp_path)).select("doc_id", "n", "conserved", "excess").collect()}
    assert got == {(1, 60_000, 60_000, 0), (2, 120_002, 60_001, 60_001), (None, 1, 0, 1)}
    assert time.time() - began < 15  # the square of a line's length took minutes
