"""The corpus pipeline: decisions of each stage on planted rows."""

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_clean_documents_and_act_on_the_rest(spark, documents):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = documents.filter("doc_id = 74").first().text
    planted = [
        (10_000, "12345 67890 --- 42", "en", "p", 18), (10_001, clean, "en", "p", len(clean)), (10_002, clean + "\n" + item, "en", "p", 1),
        (10_003, "The and of that was with. " + clean[:300] + ' password = "hunter2hunter2x"', "en", "p", 1),
    ]
    docs = documents.unionByName(spark.createDataFrame(planted, documents.schema))
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns, name
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(range(1000)) <= set(seen["language"]) and 10_000 not in seen["language"]
    assert 74 in seen["minhash"] and 10_001 not in seen["minhash"] and 10_003 in seen["minhash"]
    assert 10_002 not in seen["decontamination"] and 10_003 in seen["decontamination"]
    assert set(seen["secrets"]) == set(seen["decontamination"])
    last = seen["secrets"][10_003]
    assert "hunter2" not in last.text and last.text.endswith('[SECRET]"') and last.n_chars == len(last.text)
    mixed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(seen["secrets"]) and all(r.taken <= 2 * r.size for r in mixed)


def test_empty_table_and_odd_rows(spark, documents):
    rows = documents.withColumnsRenamed({"n_chars": "score"}).limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d", "en", None, 1), (5000, "", "en", "s", 0)], rows.schema)
    for docs in (documents.limit(0), rows.unionByName(odd)):
        names = docs.columns
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == names
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_dedup_judges_rows_by_their_own_text(spark):
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a.replace("w30", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [(1, "", "x"), (1, a, "x"), (1, a, "y"), (2, near, "x"), (2, other, "x"), (3, other, "x"), (None, near, "x"), (None, "just once here", "x"), (None, "just once here", "x"), (4, None, "x"), (5, " ", "x")]
    for turned in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, o, 1, 2, "r") for i, t, o in turned], "doc_id long, text string, row string, id int, hash int, `group` string")
        kept = cp.drop_near_duplicates(spark, docs, SF)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
        assert got == sorted([(1, ""), (1, a), (2, other), (None, "just once here"), (4, None), (5, " ")], key=repr)
