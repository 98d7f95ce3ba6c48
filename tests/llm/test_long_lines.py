"""Long lines go from their second document on, short ones from the third."""

from shelfmark.llm import line_dedup


def line(tag, n):
    return " ".join(f"{tag}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))


def test_two_documents_share_a_passage(spark):
    passage, edge, short = line("p", 60), line("e", 20), line("s", 19)
    docs = [(1, f"{line('a', 30)}\n{passage}\n{short}"), (2, f"{passage}\n{line('b', 30)}\n{short}"), (3, f"{edge}\n{edge}"), (4, f"{line('c', 9)}\n{edge}"), (5, None), (6, "")]
    got = {r.id: r.clean_text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: docs[0][1], 2: f"{line('b', 30)}\n{short}", 3: docs[2][1], 4: line("c", 9), 5: None, 6: ""}


def test_a_long_template_with_one_changed_segment(spark):
    w = line("w", 24).split()
    changed = " ".join([*w[:10], "other", *w[11:]])
    docs = [(1, " ".join(w)), (2, changed), (3, " ".join(["new", *w[1:]]))]
    got = {r.id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_very_long_line_and_extra_columns(spark):
    huge = line("h", 600) * 300
    docs = [(1, huge, "x", 1), (2, huge, "y", 2), (3, huge + " more", "z", 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, line string, n int").withColumnRenamed("n", "needed")
    got = {r.doc_id: (r.text, r.line, r.needed) for r in line_dedup.drop_lines(df).collect()}
    assert got == {1: (huge, "x", 1), 2: ("", "y", 2), 3: (huge + " more", "z", 3)}
