from collections import defaultdict

import corpus_pipeline
from sparkloom.llm import decontamination, near_dedup, packing, quality
from sparkloom.llm.common import table


def test_stages_on_the_smallest_tables(spark, tiny):
    docs = table(spark, tiny, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
        out = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}-{id(docs)}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    scores = quality.quality_scores(table(spark, tiny, "documents"), table(spark, tiny, "labels")).collect()
    assert set(kept["quality"]) == {r.doc_id for r in scores if r.predicted}
    groups = defaultdict(list)
    for d, t in kept["quality"].items():
        groups[(t or "").encode().lower()].append(d)
    assert set(kept["exact_dedup"]) == {max(ids) for ids in groups.values()}
    classes = near_dedup.brute_force(list(kept["exact_dedup"].items()))
    assert set(kept["near_dedup"]) == {d for d, c in classes.items() if d == c}
    items = [(r.item_id, r.text) for r in table(spark, tiny, "benchmark").collect()]
    leaks = {d for d, _ in decontamination.brute_force(list(kept["near_dedup"].items()), items)}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - leaks and leaks
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(kept["decontamination"])
    used = defaultdict(int)
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY
    assert all(before[d] == t for d, t in kept["decontamination"].items())


def test_stages_take_empty_tables(spark, tiny):
    docs = table(spark, tiny, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).collect() == []


def test_null_and_empty_texts_pass_the_stages(spark, tiny):
    """The classifier lets texts without words go; the other stages keep one of them, and packing gives it a separator."""
    base = table(spark, tiny, "documents")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (None, None)], "doc_id long, text string")
    docs = base.where("doc_id < 12").unionByName(odd, allowMissingColumns=True)
    assert not [r for r in corpus_pipeline.STAGES[0][1](spark, docs, tiny).collect() if not r.text]
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, tiny)
        if name != "packing":
            assert docs.columns == base.columns
            assert [r.doc_id for r in docs.collect() if not r.text] == [10**6 + 1]
    assert [(r.start, r.length) for r in docs.collect() if r.doc_id == 10**6 + 1] == [(0, 1)]
