"""Documents that line dedup empties."""

import corpus_pipeline
from shelfmark.llm import line_dedup


def test_emptied_documents_are_dropped(spark):
    docs = [*((i, "one line of words\nanother line of words") for i in range(6)), (10, ""), (11, " \n "), (12, None), (13, "alone here\none line of words")]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {0: docs[0][1], 10: "", 11: " \n ", 12: None, 13: "alone here"}


def test_many_copies_leave_one_document_in_the_run(spark, tmp_path):
    clean = lambda i: " ".join(f"word{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80)) + ".\nSecond line of it ends well here."
    docs = [*((i, clean(0)) for i in range(40)), (50, clean(1).split("\n")[0]), (51, clean(2).split("\n")[0])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "no such item in any of these documents")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 50, 51}
