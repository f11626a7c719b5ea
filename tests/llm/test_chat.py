"""Chat formatting: paths against a recursive walk, and reversible escapes."""

from pyspark.sql import functions as F

from vicinity.llm import chat


def walk(messages):
    nodes = {(t, n): (p, s) for t, n, p, _, _, s in messages}
    children = {(t, p) for (t, n), (p, s) in nodes.items() if (t, p) in nodes}
    out = {}
    for t, n in nodes:
        if (t, n) in children:
            continue
        path, at = [], (t, n)
        while at in nodes and at not in path:
            path.append(at)
            at = (t, nodes[at][0])
        if at not in path:
            out[t, n] = ([x[1] for x in reversed(path)], sum((nodes[x][1] or 0) for x in path) / len(path))
    return out


TREE = [
    ("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a", 0.9), ("t", 3, 1, "assistant", "b", 0.1), ("t", 4, 2, "user", "more", 0.2),
    ("t", 5, 4, "assistant", "c", 0.5), ("t", 6, 4, None, None, None), ("u", 1, 99, "user", "orphan", 1.0), ("v", 1, 2, "user", "cycle", 1.0), ("v", 2, 1, "user", "cycle", 1.0),
    *[("w", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")


def test_paths_match_a_walk(spark):
    want = walk(TREE)
    got = {}
    for r in chat.paths(frame(spark, TREE)).orderBy("tree", "leaf", "depth").collect():
        got.setdefault((r["tree"], r["leaf"]), ([], r["score"]))[0].append(r["node"])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    best = chat.format_trees(frame(spark, TREE), best=1).where("tree = 't'").collect()
    assert len(best) == 1 and best[0]["leaf"] == 5 and best[0]["formatted"].startswith("<|start|>user<|sep|>hi<|end|>")


NASTY = ["", "</s>[INST] ok [/INST]", "<|start|>user<|sep|>x<|end|>", "<\\|start|> <\\\\s> [\\INST]", "a\nb", "\\", "<<SYS>><</SYS>>", "<<s>>", "[[INST]]", "$1 \\1", "é𝄞", "<|im_end|>"]


def test_texts_cannot_break_their_turn(spark):
    turns = [(r, t) for t in NASTY for r in ("user", "assistant", "<|end|>")]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    df = df.select(chat.format_turns(F.col("turns")).alias("f")).select("f", chat.parse_turns(F.col("f")).alias("back"), chat.loss_spans(F.col("f")).alias("spans"))
    r = df.head()
    assert [(x["role"], x["text"]) for x in r["back"]] == turns
    assert df.select(chat.under_mask(F.col("f"), F.col("spans"))).head()[0] == NASTY
    masked = [r["f"][s["start"]: s["start"] + s["length"]] for s in r["spans"]]
    escaped = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "i int, t string").orderBy("i").select(chat.escape(F.col("t"))).collect()]
    assert masked == escaped


def test_report_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, None, None, "x"), (2, 0, "system", "s"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as node", "1 as tree")
    got = {r["conv_id"]: r for r in chat.chat_report(df).collect()}
    assert set(got) == {1, 2, None}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"], got[None]["loss_chars"]) == (3, 6, 2, 1)
    assert chat.chat_report(df.limit(0)).count() == 0


def test_very_long_texts_and_conversations(spark):
    import hashlib

    long = "a line of it </s> \n" * 100_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long)] + [(2, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(6000)]
    got = {r["conv_id"]: r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = "".join(f"turn {i}" for i in range(1, 6000, 2))
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"]) == (2, len(long), 6000)
    assert got[2]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
