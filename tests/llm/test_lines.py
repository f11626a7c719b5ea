"""Line dedup against a plain reading of its rule."""

import hashlib

from vicinity.llm import lines

BLANK = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    key = lambda x: x.strip(BLANK).translate(UP)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if d is None or len(held.get(key(x), ())) < 3 or max(held[key(x)]) == d]
        out.append((d, len(all_lines), len(all_lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


LONG = "this line is long enough to count"
ROWS = [
    (1, f"{LONG}\nown one\n  {LONG.upper()} \n"), (2, f"x\n{LONG}\t"), (3, LONG), (4, f"{LONG}\n\n{LONG}\nend"), (5, None), (6, ""), (7, "short\nshort"),
    (8, "short"), (9, "short"), (10, "ÄÖÜ lines are not lowered beyond ascii"), (11, "äöü lines are not lowered beyond ascii"), (12, "äöü lines are not lowered beyond ascii"),
    (13, "only in two documents, not in three"), (14, "only in two documents, not in three"), (15, "one document only, but thrice\n" * 3), (None, LONG),
    (16, "\n".join([f"filler number {i} of a very long text" for i in range(3000)] + [LONG])),
]


def test_matches_the_rule_with_nulls_ties_and_long_texts(spark, docs_of):
    got = sorted(map(tuple, lines.line_report(docs_of(ROWS, extra=True)).collect()), key=repr)
    assert got == sorted(expected(ROWS), key=repr)


def test_repeated_rows_are_one_document(spark, docs_of):
    rows = ROWS + [(1, ROWS[0][1]), (3, LONG), (3, "x\n" + LONG)]
    got = sorted(map(tuple, lines.line_report(docs_of(rows)).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)


def test_stage_keeps_columns_and_rows(spark, docs_of):
    df = docs_of(ROWS, extra=True)
    out = lines.line_dedup(df)
    assert out.columns == df.columns and out.count() == len(ROWS)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[1] == "own one\n" and text[4] == "\nend"
    assert text[5] is None and text[16].endswith(LONG)


def test_empty_table(spark, docs_of):
    assert lines.line_report(docs_of([])).count() == 0 and lines.line_dedup(docs_of([])).count() == 0


def test_bitmaps_mark_kept_lines(spark, docs_of):
    maps = {r["id"]: r["keep_words"] for r in lines.keep_bitmaps(docs_of(ROWS)).collect()}
    assert set(maps) == {1, 2, 3, 4} and maps[1] == {0: ~0b101}


def test_first_occurrences_are_streamed_from_a_sorted_range(spark, docs_of):
    rows = [(1, 1, d, p) for d in (3, 1, 2) for p in (5, 2, 9)] + [(1, 2, 1, 0), (2, 1, 1, 7), (2, 1, 1, 7)]
    first = lines.first_occurrences(spark.createDataFrame(rows, "h1 long, h2 long, id long, pos int"))
    assert sorted(map(tuple, first.collect())) == [(1, 1, 1, 2), (1, 1, 2, 2), (1, 1, 3, 2), (1, 2, 1, 0), (2, 1, 1, 7)]
    plan = first._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.index("Window") < plan.index("Sort [h1") < plan.index("rangepartitioning")
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "pos" in plan[plan.index("Sort [h1"):].split("]")[0]
