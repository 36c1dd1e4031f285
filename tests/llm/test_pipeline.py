"""The stages one after the other against the plain rules."""

import corpus_pipeline
import pytest

from tests.llm.test_overlap import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    held = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held.append(stage(spark, held[-1], FOLDER))
        assert held[-1].columns == columns and held[-1].dtypes == docs.dtypes
    good, single, clean, masked = ([tuple(r) for r in df.select("doc_id", "text").collect()] for df in held[1:])
    components, _ = brute(good)
    assert sorted(single) == sorted(row for row, c in zip(good, components, strict=True) if row[0] == c)
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    whole = {i for i, t in single if any(x in " ".join(t.lower().split()) for x in items)}
    assert not whole & {i for i, _ in clean} and {i for i, _ in clean} <= {i for i, _ in single} and len(clean) >= len(single) - len(whole) - 2
    assert [i for i, _ in masked] == [i for i, _ in clean]
    packed = corpus_pipeline.STAGES[-1][1](spark, held[-1], FOLDER)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in masked}
    assert sorted(r.ids_crc32 for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r.ids_crc32 for r in packed.collect())


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_and_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    _, run = corpus_pipeline.STAGES[stage]
    assert run(spark, spark.createDataFrame([], schema), FOLDER).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, None, "en", None, None), (2, None, "en", None, None)], schema)
    assert run(spark, odd, FOLDER).count() <= 4
