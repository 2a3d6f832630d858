"""Queries that must use whole tables, against plain versions over all rows."""

import os
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest

from sheafline.operators import retrieval
from sheafline.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "customer supplier orders lineitem events documents embeddings benchmark".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(spark, name, *cols):
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*cols).collect()), key=repr)


def plain(con, sql):
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_units_of_whole_texts(spark, con):
    want = Counter(unicodedata.normalize("NFKC", w).strip().lower() for (t,) in con.execute("select text from documents where text is not null").fetchall() for w in re.split(r"[ \t\n\x0B\f\r]+", t) if w)
    assert dict(rows_of(spark, "nfkc_units", "unit", "n")) == dict(want)


def test_every_order_is_rebuilt_and_scored(spark, con):
    orders = {str(k): n for k, n in con.execute("select l_orderkey, count(*) from lineitem group by 1").fetchall()}
    cells = catalog.QUERIES["glyph_to_cells"](spark, SF).select("unit").distinct().collect()
    assert {r.unit for r in cells} == set(orders)
    assert dict(rows_of(spark, "cell_scores", "unit", "n")) == {k: 2 * n for k, n in orders.items()}


def test_groups_of_any_id(spark, tmp_path):
    rows = [(101, [1.0, 0.0]), (250, [0.99, 0.01]), (251, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in catalog.QUERIES["near_duplicate_groups"](spark, str(tmp_path)).orderBy("id").collect()] == [(101, 1, 101, False), (250, 1, 101, True), (251, 0, 251, False)]


def test_near_groups_across_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base + 0.1 * rng.normal(size=base.shape), base[:1].repeat(20, 0)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i + 1, j + 1) for i, j in zip(*np.nonzero(np.triu(u @ u.T > 0.9, 1)), strict=True)}
    odd = [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0]), (504, [])]
    df = spark.createDataFrame([*((i + 1, v.tolist()) for i, v in enumerate(x)), *odd], "id long, vec array<double>")
    n, comp = Counter(i for p in want for i in p), {i + 1: i + 1 for i in range(len(x))}
    for _ in comp:
        for a, b in want:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.id: (r.n_links, r.component, r.rejected) for r in retrieval.near_groups(df, 0.9, block=30).collect()}
    assert got == {i: (n[i], comp.get(i, i), any(b == i for _, b in want)) for i in [*comp, *(k for k, _ in odd)]}


def test_long_documents_admit_words(spark, con):
    want = r"""with w as (select item_id, v, count(*) as k from (select item_id, unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) as v from benchmark) where v <> '' group by all),
p as (select item_id, v, count(*) as c from (select doc_id % 40 as item_id, unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) as v from documents) group by all)
select item_id, sum(k)::bigint, sum(least(k, coalesce(c, 0)))::bigint from w left join p using (item_id, v) group by item_id"""
    assert rows_of(spark, "multiset_admission", "item_id", "n", "admitted") == plain(con, want)


def test_division_of_all_orders(spark, con):
    need, groups = {}, {}
    for o, p, *cell in con.execute("select l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity::bigint from lineitem").fetchall():
        need.setdefault(o, set()).add(tuple(cell))
        groups.setdefault(p % 100, set()).add(tuple(cell))
    want = [(o, g) for o, items in need.items() for g, have in groups.items() if items <= have]
    n = Counter(o for o, _ in want)
    assert set(n) != {o for o in need if len(need[o]) == 1} and len(want) < len(need) * len(groups)  # some groups are refused
    assert rows_of(spark, "relational_division_unique", "l_orderkey", "grp", "n_candidates") == sorted(((o, g, n[o]) for o, g in want), key=repr)


def test_all_orders_cited(spark, con):
    assert rows_of(spark, "cited_within_supplied", "o_orderkey", "within", "n") == plain(con, "select o_orderkey, max(l_suppkey) <= 5, count(*) from orders join lineitem on o_orderkey = l_orderkey group by 1")


def test_all_events_have_paths(spark, con):
    sql = "select 'events.' || event_type || '.' || (row_number() over (partition by event_type order by epoch_us(ts), event_id) - 1) || '.user', user_id from events"
    assert rows_of(spark, "attribute_paths", "path", "value") == plain(con, sql)


def test_paths_of_any_user(spark, tmp_path):
    spark.sql("select event_id, timestamp_ntz'2024-01-01 00:00:00' as ts, 'view' as event_type, user_id from values (1L, 21L), (2L, 5L) as t(event_id, user_id)").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in catalog.QUERIES["attribute_paths"](spark, str(tmp_path)).collect()}
    assert got == {("events.view.0.user", 21), ("events.view.1.user", 5)}


def test_orphans_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(1, 0), (3, 1), (4, 10)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1), (2, 10), (3, 7)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r) for r in catalog.QUERIES["orphans_both_ways"](spark, str(tmp_path)).collect()}
    assert got == {(0, "customer only"), (1, "customer only"), (7, "supplier only")}
