"""The queries of this folder against their SQL on the smallest tables, and the pipeline against plain Python."""

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from beamloom.llm import bpe, quality
from beamloom.llm.queries import C
from tests.llm.test_jaccard import plain_classes, plain_set

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(C.sql))
def test_query(spark, name):
    db = duckdb.connect()
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = C.builds[name](spark, SF)
    cur = db.execute(C.sql[name])
    cols = [d[0] for d in cur.description]
    assert check.rows(df.columns, df.collect()) == check.rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)


def test_jaccard_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(map(tuple, C.builds["op2_jaccard_join"](spark, SF).collect()), key=repr) == plain_classes(rows)


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(frame, model).collect() if r.score >= 0.5}
    kept = [(i, t) for i, t in docs if i in good]
    first = {i for i, _, c in plain_classes(kept) if i == c}
    items = [plain_set(t[0]) for t in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    clean = {i for i, t in kept if i in first and not any(b and 100 * len(b & plain_set(t)) >= 80 * len(b) for b in items)}
    assert set(got) == clean
    code = bpe.Bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).encoding
    assert all(got[i].ids == code.encode_ordinary(t or "") and got[i].round_trip for i, t in docs if i in clean)


def test_stages_keep_columns_and_take_awkward_rows(spark):
    from pyspark.sql import functions as F

    from tests.llm.data import documents, frame

    docs = frame(spark, documents()).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    one = corpus_pipeline.keep_one_of_each_class(spark, docs, SF).collect()
    assert sorted((r.doc_id for r in one if r.doc_id is not None)) == sorted(set(range(1, 21)) - {2, 3, 9})
    assert sum(r.doc_id is None for r in one) == 2
    assert corpus_pipeline.encode_texts(spark, docs, SF).filter("NOT round_trip").count() == 0


def test_a_text_that_shares_its_id_with_a_copy_stays(spark):
    from tests.llm.data import frame, words

    copied, alone = words(60, 5), words(60, 6)
    docs = frame(spark, [(1, copied), (2, copied), (2, alone), (2, alone), (3, copied), (None, alone)])
    got = corpus_pipeline.keep_one_of_each_class(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, copied), (2, alone), (None, alone)], key=repr)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "other text of the same id"), (3, "x y z x y z"), (None, "a b c d e f g"), (None, None), (3, "x y z x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = ("__id", "__key", "__later", "__mark", "__score", "__text", "id", "key", "mark", "row", "later", "h", "component_id", "n")
    for c in odd:
        docs = docs.withColumn(c, F.lit("clash"))
    once = corpus_pipeline.keep_one_of_each_class(spark, docs, SF)
    assert once.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=repr) == sorted([rows[0], rows[2], rows[3], rows[4], rows[5]], key=repr)
    assert corpus_pipeline.keep_good(spark, docs, SF).columns == docs.columns
    left = corpus_pipeline.keep_clean(spark, docs, SF)
    assert left.columns == docs.columns and left.count() == len(rows)


def test_the_pipeline_leaves_its_last_table_only(spark):
    from tests.llm.test_jaccard import folders

    before = folders(spark) if spark.conf.get("spark.checkpoint.dir", None) else []
    out = corpus_pipeline.run(spark, SF)
    assert [f.rsplit("-", 1)[0] for f in folders(spark, before) if f.startswith("pipeline-")] == ["pipeline-byte-level-BPE"]
    assert out.filter("round_trip").count() > 0
