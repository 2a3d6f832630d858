"""The pipeline against its stages' plain versions."""

import collections

import corpus_pipeline
from sheafline.llm import learn, pii, quality_rules, toxicity

from .test_operators import near_copies, plain_components


def test_run_equals_plain(spark, tmp_path):
    texts = near_copies(1, 30, 8) + [" ".join(f"q{i}x{j}" for j in range(60)) + f" call +1 (212) 555-{i:04d}" for i in range(40)] + ["short", "", None, "echo " * 90]
    docs = [(i, t, None, "src", None if t is None else len(t)) for i, t in enumerate(texts)] + [(5, texts[5], None, "src", len(texts[5])), (None, texts[40], "en", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(docs, schema).selectExpr("*", "1 as score", "2 as kept")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    import pyarrow as pa

    keep = quality_rules.judge(pa.array([d[1] for d in docs]))["kept"]
    rows = [d for d, k in zip(docs, keep, strict=True) if k]
    left = spark.createDataFrame(rows, schema)
    model = toxicity.Model(*learn.labelled_sample(left, spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic", toxicity.FOLDS, toxicity.FOLD))
    rows = [d for d in rows if model.score(pa.array([d[1]]))[0] < toxicity.CUT]
    comp = plain_components([(d[0], d[1]) for d in rows if d[0] is not None], 5)
    want = collections.Counter([i for i, c in comp.items() if i == c] + [d[0] for d in rows if d[0] is None])
    assert collections.Counter(r.doc_id for r in out if r.piece == 0) == want
    assert sum(want.values()) > 30
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    new = corpus_pipeline.pseudonyms(spark, df, str(tmp_path)).filter("doc_id = 40").collect()[0]
    assert "555-0010" not in new.text and len(new.text) == new.n_chars
    assert pii.PATTERN
