from tallyline.llm.line_dedup import dedup_lines


def cleaned(spark, *rows):
    frame = spark.createDataFrame(list(rows), "doc_id long, text string, spans string, K1 int")
    return {(r.doc_id, r.spans): (r.text, r.n_lines, r.n_removed) for r in dedup_lines(frame).collect()}


def test_later_windows_go(spark):
    got = cleaned(
        spark,
        (1, "a\nb\nc\nd", "x", 1),
        (2, "z\n a \nb\t\n\nc\nd\ny", "x", 1),
        (3, "a\nb", "x", 1),
        (4, "a\nb\r", "x", 1),
        (5, "b\nc\ne", "x", 1),
        (6, "q\nq\nq\nq\nq", "x", 1),
    )
    assert got == {
        (1, "x"): ("a\nb\nc\nd", 4, 0),
        (2, "x"): ("z\ny", 7, 5),
        (3, "x"): ("a\nb", 2, 0),
        (4, "x"): ("", 2, 2),
        (5, "x"): ("b\nc\ne", 3, 0),
        (6, "x"): ("q", 5, 4),
    }


def test_odd_rows(odd, none):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(dedup_lines(odd).columns)
    told = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in rows}
    assert told[1, None] == (0, 0) and told[2, ""] == (1, 0) and told[3, " \n\t "] == (2, 0)
    assert told[6, "the same words stand in each of these rows today"] == (1, 0)
    assert told[7, ""] == (1, 1)
    assert dedup_lines(none).collect() == []


def test_a_common_window_in_many_documents(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "concat('own ', id, '\nx\ny\nz') AS text")
    rows = dedup_lines(frame).collect()
    assert sorted(r.doc_id for r in rows if r.n_removed == 0) == [0]
    assert all(r.text == f"own {r.doc_id}" for r in rows if r.doc_id)
