import os

import corpus_pipeline
import helpers
import pytest
from test_ngramjoin import plain
from tokenloom.llm import decontam, pii, toxicity
from tokenloom.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_against_plain_versions(spark):
    """Each stage's decision, taken again without its operator where that is possible."""
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.score(docs, table(spark, SF, "labels")).collect()}
            assert set(after) == {i for i in before if scores[i] == 0} and all(after[i] == before[i] for i in after)
        if name == "near_duplicates":
            component = plain([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i in before if component[i][1] == i}
        if name == "decontaminate":
            bench = [r.text for r in table(spark, SF, "benchmark").collect()]
            leaked = {i for i, r in before.items() if any(b in r.text for b in bench)}
            assert not leaked & set(after)
            index = decontam.build([(k, b) for k, b in enumerate(bench)])
            assert all(decontam.leaks(index, [before[i].text]) for i in set(before) - set(after))
        if name == "pii":
            assert set(after) == set(before)
            for i, r in after.items():
                assert (r.text == before[i].text) == (not pii.base_spans(before[i].text)) and r.n_chars == len(r.text) and not pii.base_spans(r.text)
        if name == "pieces":
            assert set(after) == set(before) and all(r.lossless for r in after.values())
        docs, before = out, after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(before)


def tables(spark, folder, docs):
    """A folder of tables around some documents: labels of a few, and a benchmark of one item."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0) for k in (1, 4, 5, 8, 9, 10)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Which river runs through the old town of Emmbridge? The Emm, which floods in spring."), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    leaked = "x y. Which river runs through the old town of Emmbridge? The Emm, which floods in spring. z"
    rows = [*helpers.ROWS, (20, leaked, "en", "a"), (21, "write to ann.lee@corp.org today please", "en", "a")]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    columns = helpers.awkward(spark).columns
    docs = more.selectExpr("*", "cast(length(text) as bigint) as n_chars", *[f"'clash' as `{c}`" for c in columns[5:]]).select(*columns)
    sf = tables(spark, tmp_path, docs.repartition(3))
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = materialise(stage(spark, got, sf), f"test-{name}")
        assert got.columns == columns and got.schema["n_chars"] == docs.schema["n_chars"], name
    kept = got.collect()
    # the copies of 1 and the leaked document are gone, one row without an id stays, null and empty texts stay as they are
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "4", "None", "7", "8", "9", "10", "21"])
    text = {r.doc_id: r.text for r in kept}
    assert text[2] is None and text[3] == "" and text[21] == "write to [EMAIL] today please" and text[4] == helpers.LONG
    last = corpus_pipeline.run(spark, sf).collect()
    assert sorted(str(r.doc_id) for r in last) == sorted(str(r.doc_id) for r in kept) and all(r.lossless for r in last)


def test_empty_documents(spark, tmp_path):
    sf = tables(spark, tmp_path, helpers.empty(spark))
    docs = helpers.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), "test-empty")
        assert docs.count() == 0 and docs.columns == helpers.empty(spark).columns
    assert corpus_pipeline.run(spark, sf).count() == 0
