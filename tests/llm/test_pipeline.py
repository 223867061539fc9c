import collections

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tempoframe.llm import queries
from tempoframe.llm.near_copies import near_copy_groups
from tempoframe.llm.shared import staged
from tempoframe.llm.toxicity import without_toxic


def test_stages_keep_their_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts, kept = docs.columns, [docs.count()], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept[name] = staged(stage(spark, docs, sf))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[4] <= counts[3] < counts[2]
    assert near_copy_groups(kept["near_dedup"]).filter("doc_id <> keep_id").isEmpty()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter()
    for r in docs.collect():
        expected[r["doc_id"]] += len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] += r["length"]
    assert got == expected


def test_odd_inputs_pass_all_stages(spark, odd, none, sf):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, sf))
        assert docs.columns[:2] == ["doc_id", "piece"]


def test_no_document_is_dropped_as_toxic_without_labels_of_both_kinds(spark, odd):
    for rows in ([], [(10**9, 1)], [(i, 1) for i in range(100)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert without_toxic(odd, labels).count() == odd.count()


def test_queries_cover_whole_tables(spark, sf):
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in queries.QUERIES.items():
        n = query(spark, sf).count()
        if name.split("_")[0] in ("op2", "op3", "op4", "op6", "op9", "op10"):
            assert n == rows["documents"], name
        elif name.startswith("op7"):
            assert n == rows["pages"]
        else:
            assert n > 0, name
