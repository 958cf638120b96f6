"""The pipeline's stages in order, each on what its predecessor kept."""

import corpus_pipeline


def test_stages_keep_columns_and_documents(spark, tmp_path):
    words = lambda seed, n: " ".join(f"x{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(n))
    leak = words(99, 30)
    texts = [words(k, 120) for k in range(12)]
    texts += [texts[0], texts[1] + " extra", "short text", f"{words(50, 60)}\n{leak}\n{words(51, 60)}", None]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept == [[*range(14), 15], [*range(14), 15], [*range(12), 15], [*range(12)]]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [*range(12)]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing names of further columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, hits string, key1 long, rep long, found string"
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long, None, None, None), (1, long, None, None, None), (2, long, "en", "s", len(long)), (None, long + " x", "en", "s", 5), (3, None, None, "s", None), (4, "", "en", None, 0), (5, " \n ", "en", "s", 3)]
    rows = [(*r, "i", 7, "h", 8, 9, "f") for r in rows]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    want = {"quality_rules": [None, 1, 1, 2], "cross_site_lines": None, "minhash_near_dedup": [None, 1, 1, 3, 4, 5], "benchmark_decontamination": [None, 1, 1, 2, 3, 4, 5]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is not None, x))
        assert got == (want[name] or [None, 1, 1, 2, 3, 4, 5]), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == 7 and last(spark, docs.limit(0), str(tmp_path)).count() == 0
