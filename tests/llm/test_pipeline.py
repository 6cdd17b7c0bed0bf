import corpus_pipeline
from pangrove.llm import decontaminate, mixing, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(150)
    docs = docs.unionByName(spark.createDataFrame([(None, None, "en", None, None), (None, "", "en", "s", 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_dedup", "decontamination", "mixing", "token_files"]
    rows = docs.collect()

    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    kept = stages["toxicity"](spark, docs, DIR)
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in rows if scorer.score(r.text or "") < 0.5)

    kept = stages["simhash_dedup"](spark, docs, DIR).collect()
    texts = [r.text or "" for r in kept]
    assert len(texts) == len(set(texts)) and {r.text or "" for r in rows if len((r.text or "").split()) < 4} & set(texts)
    firsts = {}
    for r in rows:
        firsts.setdefault(r.text or "", []).append(r.doc_id)
    assert all(r.doc_id == min((x for x in firsts[r.text or ""] if x is not None), default=None) for r in kept)

    kept = stages["decontamination"](spark, docs, DIR).collect()
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leaked = lambda t: any(i in decontaminate.plain(t or "") for i in items)
    assert not any(leaked(r.text) for r in kept) and len(kept) >= sum(not leaked(r.text) for r in rows) - 2

    mixed = stages["mixing"](spark, docs, DIR)
    assert mixed.schema == docs.schema and 0 < mixed.count() <= 3 * len(rows)
    tokens = stages["token_files"](spark, mixed, DIR)
    assert tokens.count() == mixed.count()


def test_other_columns_nulls_and_empty_tables(spark):
    """Columns of any name, nulls everywhere, long texts, repeated rows; and no rows at all."""
    rows = [
        (1, "a b c d e f g", "en", "s", 1, 1, 5, "x", 7), (1, "a b c d e f g", "en", "s", 1, 1, 5, "x", 7), (2, None, None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None), (3, "", "en", "t", 0, 2, 6, "y", 8), (4, "long " * 60_000, "en", "s", 9, 3, 7, "z", 9),
        (5, "A b c d e f g", "en", "t", 1, 1, 5, "x", 7), (6, "h i j k l m n o p q r s", "de", None, 1, 1, 5, "x", 7),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n int, copies int, key_id int, key_hash string, `_key_id` int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.schema.names == docs.schema.names and set(map(tuple, kept.collect())) <= set(rows), name
        assert stage(spark, docs.limit(0), DIR).count() == 0, name
    near = sorted((r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DIR).collect()), key=str)
    assert near == [1, 2, 4, 6]  # null and empty texts are one group, as are texts that differ in letter case
    assert corpus_pipeline.drop_leaks(spark, docs, DIR).count() == len(rows)
    mixed = {}
    for r in corpus_pipeline.mix(spark, docs, DIR).collect():
        mixed[tuple(r)] = mixed.get(tuple(r), 0) + 1
    want = {}
    for r in mixing.mix_sources(docs.select("doc_id", "source", "text")).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert {d: sum(n for k, n in mixed.items() if k[0] == d) for d in want} == want
    last = corpus_pipeline.write_tokens(spark, docs, DIR).collect()
    assert len(last) == len(rows) and corpus_pipeline.write_tokens(spark, docs.limit(0), DIR).count() == 0


def test_left_tables_go(spark):
    """A stage deletes what earlier ones left, but not what its own documents read."""
    from pangrove.plans import storage

    docs = storage.written(spark.createDataFrame([(1, "a b", "s")], "doc_id bigint, text string, source string"), "kept")
    other = storage.written(docs, "other")
    storage.release(spark, docs)
    assert docs.count() == 1 and other.written_at not in storage._LEFT and docs.written_at in storage._LEFT
