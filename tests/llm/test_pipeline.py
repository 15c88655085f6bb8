import corpus_pipeline
from test_numbered import brute_components, brute_dedup, words


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, sf)
        assert kept.columns == names
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in brute_components(before.items()).items() if i == c}
        elif name == "substring_dedup":
            want = brute_dedup(before.items())
            assert set(after) == set(before) and all(len(words(after[i])) == want[i][0] - want[i][1] for i in after)
        else:
            assert set(after) < set(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, an empty table and clashing columns go through every stage."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    good = " ".join(f"the word{i} of item{i} and thing{i}" for i in range(40))
    rows = [(1, good), (1, good), (2, good), (None, good + " more"), (3, None), (4, ""), (5, " \n\t"), (6, " ".join(f"the long{i} of text{i} and words{i}" for i in range(40_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_id", "id", "words", "component_id", "spans", "_row", "_w", "length", "piece", "n_words", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    expected = {"quality_rules": [1, 1, 2, 6, None], "ngram_jaccard_join": [1, 1, 3, 4, 5, 6, None], "substring_dedup": [1, 1, 2, 3, 4, 5, 6, None], "benchmark_decontamination": [1, 1, 2, 3, 4, 5, 6, None]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=str) == expected[name], name
        assert stage(spark, df.limit(0), sf).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5, 6, None} and corpus_pipeline.STAGES[-1][1](spark, df.limit(0), sf).count() == 0


def test_run_leaves_only_its_last_input(spark):
    from citetrace.plans import storage

    before = set(storage.written(spark))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(storage.written(spark)) - before
    assert out.count() > 0 and sum("pipeline-" in p for p in left) == 1
