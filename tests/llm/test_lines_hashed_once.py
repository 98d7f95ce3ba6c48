"""Line dedup cuts and hashes the texts in one pass, whatever reads the hashes."""

from shelfmark.llm import line_dedup

TEXTS = [
    "one two three four\n padded line here \nx", "one two three four\nplus  two spaces\ny", "one two three four\npadded line here\nplus two spaces",
    "row 17 of the day\nplus\ttwo\r spaces", "row 18 of the day\npadded line here", "row 19 of the day", None, "", "\n \n"]


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").mapInArrow(counted, "doc_id bigint, text string")
    dropped = {r.id: sorted(r.drop) for r in line_dedup.dropped_lines(docs).collect()}
    assert dropped == {1: [0], 2: [0, 1, 2], 3: [1], 4: [0, 1], 5: [0]} and read.value == len(TEXTS)


def test_even(spark):
    lines = spark.createDataFrame([("a b",), (" a b",), ("a b ",), ("a  b",), ("a\tb",), ("a 1b c",), (" ",), ("",)], "t string")
    got = [r.e for r in lines.select(line_dedup.even(lines.t).alias("e")).collect()]
    assert got == ["a b", "a b", "a b", "a b", "a b", "a <*> c", "", ""]


def test_one_row_per_line_with_its_templates(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nb c\n\nc"), (2, "a b x d e")], "doc_id bigint, text string")
    rows = {(r.id, r.line): list(r["keys"]) for r in line_dedup.occurrences(docs, "doc_id", "text", 2, 20).collect()}
    assert {k: len(v) for k, v in rows.items()} == {(1, 0): 4, (1, 1): 1, (1, 3): 1, (2, 0): 4}
    assert len(set(rows[1, 0]) & set(rows[2, 0])) == 1
