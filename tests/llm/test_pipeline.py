"""The corpus pipeline on a small corpus with planted cases."""

import zlib

import numpy as np
import pytest

from levelscope.llm import secret_scan
from levelscope.llm.encoding import vocabulary

from .conftest import prose
from .test_tokens import ids, linked

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    good = [(k, prose(k, 80)) for k in range(80)]
    junk = [(k, "BUY!! NOW!! " * 25) if k % 2 else (k, " | ".join(prose(k, 40).split())) for k in range(100, 160)]
    copy = [(200, prose(3, 80)), (201, prose(4, 80) + " end")]
    item = prose(900, 30)
    leak = [(210, prose(11, 70) + " " + item + " " + prose(12, 70))]
    secret = [(220, prose(21, 80) + " password=hunter2222 " + prose(22, 60))]
    rows = [(d, t, "en", "s", len(t)) for d, t in good + junk + copy + leak + secret]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100), 0) for d, _ in good + junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    first, second, third, fourth = kept
    assert not set(first) & {d for d, _ in junk} and len(set(first) & {d for d, _ in good}) >= 76
    classes = linked(list(first.items()), 5, 80)
    assert set(second) == set(classes.values())
    assert set(third) == set(second) - {210} and all(second[d] == third[d] for d in third)
    assert set(fourth) == set(third) and {d for d in third if third[d] != fourth[d]} == {220}
    assert secret_scan.REDACTED in fourth[220] and "hunter2222" not in fourth[220]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    packed = {r["doc_id"]: r for r in docs.collect()}
    assert set(packed) == set(fourth)
    for d, text in fourth.items():
        x = np.array(ids(t, text) + [0], "<u4")
        assert (packed[d]["length"], packed[d]["ids_crc32"]) == (len(x), zlib.crc32(x.tobytes()))


@pytest.fixture(scope="module")
def odd_tables(spark, corpus, tmp_path_factory):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names; labels and items with nulls."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = corpus.unionByName(corpus.limit(1).selectExpr(*[f"CAST(NULL AS {t}) AS `{n}`" for n, t in corpus.dtypes]))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 5 != 0), 0) for k in range(50)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(5, 20)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_odd_rows(spark, odd_tables):
    """Each stage on the whole odd table: no crash, the columns as they are, and only its own decisions."""
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    whole = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd_tables)
        if k == 4:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            continue
        assert out.columns == docs.columns and 0 < out.count() <= whole, name
        if name == "secret scan":
            assert out.count() == whole
        if name in ("near duplicates", "decontamination"):
            assert out.where("text IS NULL").count() == docs.where("text IS NULL").count(), name
            assert out.where("words IS NOT NULL AND words <> 'x'").count() == 0


def test_stages_take_an_empty_table(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd_tables).count() == 0, name
