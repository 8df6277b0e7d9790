import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sawlog.llm import decontamination, near_duplicates, stages, toxicity
from tests.llm import brute
from tests.llm.corpus import corpus, documents

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, tmp_path):
    rows = corpus()
    docs = documents(spark, rows)
    spark.createDataFrame([(k, 0) for k, _ in rows[:20] if k is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = next(t for _, t in rows if t and len(t.split()) > 100)
    items = [(1, " ".join(long.split()[10:40]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert stages.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)
    kept = stages.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    # Texts are compared, so a row of another text under the same id is a node of its own.
    nodes = sorted({(k, t or "") for k, t in rows if k is not None})
    groups = brute.groups([(i, t) for i, (_, t) in enumerate(nodes)], 5, 80)
    have = [(r.doc_id, r.text or "") for r in kept if r.doc_id is not None]
    members = {}
    for i, node in enumerate(nodes):
        members.setdefault(groups[i], []).append(node)
    assert len(have) == len(set(have)) == len(members)
    for group in members.values():
        assert [k for k, t in have if (k, t) in group] == [min(group)[0]]
    assert sum(r.doc_id is None for r in kept) == sum(k is None for k, _ in rows)
    clean = stages.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert len(clean) == sum(not hit for *_, hit in brute.contaminated(rows, items, 10))


def test_no_text_goes_with_another_one_of_its_id(spark):
    one, two = "a b c d e f g h i j k", "some other words that are not at all like those"
    rows = [(5, one, "x"), (5, two, "y"), (7, two, "z"), (3, one, "v"), (5, one, "w"), (None, two, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stage_id string")
    kept = stages.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(3, one), (5, two), (0, two)])


def test_columns_may_have_any_names(spark, tmp_path):
    """Names that the stages use inside, or that are odd, come back with their values."""
    names = ["doc_id", "text", "row", "id", "tag", "node", "score", "_stage_id", "_stage_tag", "_stage_score", "a.b", "component_id", "n"]
    docs = spark.createDataFrame([(i, f"text {i} of words that differ {i * 7}", *[f"{n}{i}" for n in names[2:]]) for i in range(9)], names)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it in any document at all anywhere here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (stages.drop_toxic, stages.drop_near_duplicates, stages.drop_contaminated):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == names
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_redaction_updates_lengths(spark):
    docs = spark.createDataFrame([(1, "token = abcdef0123456789", 24), (2, None, 7), (3, "x", 1)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.redact_secrets(spark, docs, "").collect()}
    assert got == {1: ("<secret>", 8), 2: (None, 7), 3: ("x", 1)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_works_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    final = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = model.scored(docs).filter(F.col("score") < 0.7)
    left = left.join(near_duplicates.near_duplicates(left).filter("kept").select("doc_id"), "doc_id")
    found = decontamination.contamination(left, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert final == {r.doc_id for r in found.filter("NOT contaminated").collect()}
