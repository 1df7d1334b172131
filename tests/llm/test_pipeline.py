import corpus_pipeline
from quern.llm import secret_scan
from quern.llm.common import DOCUMENT_COLUMNS


def stages(spark, docs, sf_dir, tmp_path, names=None):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    return out


def test_whole_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12345 !!", "en", "s", 8), (9002, None, "en", "s", None), (9003, 'the token = "abcdef1234567890" of this and that', "en", "s", 40), (9003, 'the token = "abcdef1234567890" of this and that', "en", "s", 40)], docs.schema)
    out = stages(spark, docs.unionAll(extra), sf_dir, tmp_path)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert tuple(out[name].columns) == DOCUMENT_COLUMNS
    ids = lambda name: sorted(r.doc_id for r in out[name].select("doc_id").collect())
    clean = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert ids("language") == [*clean, 9003, 9003]
    # one row of each class, the smallest id, and of a repeated row one
    from quern.llm.jaccard import near_duplicate_classes

    classes = {r.doc_id: r.component_id for r in near_duplicate_classes(out["language"]).collect()}
    assert ids("near_duplicates") == sorted({v for v in classes.values()})
    assert ids("secrets") == ids("near_duplicates")
    texts = {r.doc_id: (r.text, r.n_chars) for r in out["secrets"].collect()}
    assert texts[9003] == (new := f'the {secret_scan.REDACTED}" of this and that', len(new))
    assert set(ids("mixing")) <= set(ids("secrets"))
    packed = out["packing"].collect()
    total = sum(r.length for r in packed)
    assert {r.doc_id for r in packed} == set(ids("mixing")) and total == sum(r.doc_tokens for r in packed if r.start == 0)


def test_classes_not_ids_are_kept(spark, make):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = lambda k: text(k) + " and more"
    rows = [(None, text(1)), (None, text(2)), (None, near(2)), (None, text(3)), (1, near(3))]  # null ids: two texts of their own, near copies of one and of a row with an id
    rows += [(5, text(5)), (5, text(6)), (5, text(6)), (4, near(6))]  # a repeated id, one of its texts a near copy of a smaller id's
    rows += [(7, text(7)), (7, near(7)), (7, text(7))]  # all one class
    rows += [(None, None), (None, ""), (8, " \t"), (8, " \t"), (9, None)]  # wordless
    got = corpus_pipeline.drop_near_duplicates(spark, make(rows), "")
    assert tuple(got.columns) == DOCUMENT_COLUMNS
    found = [(r.doc_id, r.text) for r in got.collect()]
    seven = [r for r in found if r[0] == 7]
    assert len(seven) == 1 and seven[0][1] in (text(7), near(7))
    two = [r for r in found if r[1] in (text(2), near(2))]
    assert len(two) == 1
    want = [(None, text(1)), (1, near(3)), (5, text(5)), (4, near(6)), *rows[-5:], *seven, *two]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_stages_take_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert all(df.count() == 0 for df in stages(spark, docs, sf_dir, tmp_path).values())


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and corpus_pipeline.ORACLE_SQL is None
