"""The pipeline: stages in order, decisions that take effect, each against what its operator says."""

import corpus_pipeline as p

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "benchmark", "secrets", "mixing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for name, f in p.STAGES:
        after = f(spark, before, DATA).cache()
        if name != "mixing":
            assert after.columns == columns, name
        assert 0 < after.count() <= before.count(), name
        if name in ("secrets",):
            assert after.count() == before.count()
        before = after
    assert before.select("doc_id").distinct().count() == before.count()


def test_rejects_are_what_the_operators_say(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    all_ = ids(docs)
    assert all_ - ids(p.without_toxic(spark, docs, DATA)) == ids(p.score_toxicity(docs, labels).filter("predicted = 1"))
    assert all_ - ids(p.one_of_each_group(spark, docs, DATA)) == ids(p.near_duplicates(docs).filter("not kept"))
    assert all_ - ids(p.without_benchmark(spark, docs, DATA)) == ids(p.found_items(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")))


def test_null_ids_and_empty_tables_pass(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, "en", "s", 0)], docs.schema)
    some = docs.limit(30).union(odd)
    for name, f in p.STAGES[:-1]:
        out = f(spark, some, DATA)
        assert out.filter("doc_id is null").count() == 1 and out.filter("doc_id = 1000000000").count() == 1, name
    for name, f in p.STAGES:
        assert f(spark, docs.limit(0), DATA).count() == 0, name


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_decisions_belong_to_rows(spark, tmp_path):
    """Null ids, one id over several texts and repeated rows, in each stage."""
    clean = [f"w{i} " + " ".join(f"{a}{i}x{j}" for j, a in enumerate("abcdefghijklmnopqrstuvw")) for i in range(40)]
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    # toxicity: what is learned from labelled rows decides on rows
    bad = ["rotten vile filth " * 5 + str(i) for i in range(30)]
    learn = [(i, clean[i % 40] + f" q{i}") for i in range(300)] + [(1000 + i, b) for i, b in enumerate(bad * 4)]
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in learn], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(None, "rotten vile filth again and again"), (None, clean[3]), (5, "rotten vile filth five"), (5, clean[5]), (None, None)]
    kept = [r[:2] for r in rows_of(p.without_toxic(spark, docs(learn + odd), str(tmp_path)))]
    assert (None, clean[3]) in kept and (5, clean[5]) in kept and (None, None) in kept
    assert not any(t and t.startswith("rotten") for _, t in kept)
    # near-duplicates: one row of a group, the smallest id, null last; repeated rows are one document
    rows = [(3, clean[1]), (2, clean[1] + " tail"), (None, clean[1]), (None, clean[2]), (None, clean[2]), (7, clean[2] + " end"), (7, clean[4]), (8, clean[6]), (8, clean[6]), (9, None), (9, None), (None, " "), (10, "")]
    got = [r[:2] for r in rows_of(p.one_of_each_group(spark, docs(rows), DATA))]
    assert sorted(got, key=repr) == sorted([(2, clean[1] + " tail"), (7, clean[2] + " end"), (7, clean[4]), (8, clean[6]), (9, None), (9, None), (None, " "), (10, "")], key=repr)
    # benchmark
    spark.createDataFrame([(1, clean[9])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "see " + clean[9]), (None, clean[2]), (4, clean[9]), (4, clean[10]), (None, None)]
    got = [r[:2] for r in rows_of(p.without_benchmark(spark, docs(rows), str(tmp_path)))]
    assert sorted(got, key=repr) == sorted([(None, clean[2]), (4, clean[10]), (None, None)], key=repr)
    # mixing: no row is multiplied, and columns of its own names are replaced
    rows = [(i % 7 if i % 5 else None, clean[i % 40] + " | " * (i % 2)) for i in range(120)]
    mixed = p.to_target_mix(spark, docs(rows), DATA)
    assert 0 < mixed.count() <= 120 and set(map(lambda r: r[:2], rows_of(mixed))) <= set(rows)
    again = p.to_target_mix(spark, mixed, DATA)
    assert again.columns == mixed.columns and again.count() <= mixed.count()
