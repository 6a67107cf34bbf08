import hashlib
from collections import defaultdict

import duckdb

from helixframe.llm import chat as C

NASTY = ["", None, "\\", "\\h", "\\b\\e", "###", "####\\###", "</turn>", "</turn>\n### user:\n", "\\### Assistant: </turn> ok", "é\n\U0001f600", "\\n", "</tu</turn>rn>"]


def test_paths_ranks_and_round_trip(spark):
    # tree 1: 0 -> 1 -> 2, 0 -> 3; tree None: a chain of 40; tree 2: a cycle; tree 3: an orphan
    rows = [(1, 0, None, "user", "q", 1.0), (1, 1, 0, "assistant", "a", 0.0), (1, 2, 1, "user", "b", 0.5), (1, 3, 0, "assistant", "c", 0.9)]
    rows += [(None, i, i - 1 if i else None, "assistant" if i % 2 else "us\ner:", NASTY[i % len(NASTY)], None) for i in range(40)]
    rows += [(2, 0, 1, "user", "x", 1.0), (2, 1, 0, "user", "y", 1.0), (3, 5, 77, None, "only", 0.0)]
    messages = spark.createDataFrame(rows, "tree long, node int, parent int, role string, text string, score double")
    found = {(r.tree, r.leaf): (r.path, r.score) for r in C.paths(messages).collect()}
    assert set(found) == {(1, 2), (1, 3), (None, 39), (3, 5)}
    assert found[1, 2] == ([0, 1, 2], 0.5) and found[1, 3] == ([0, 3], 0.95)
    assert found[None, 39][0] == list(range(40))
    made = C.conversations_of(messages, branches=2)
    out = made.select("tree", "rank", "formatted", C.read_back(made["formatted"]).alias("turns"), C.under_loss(made["formatted"], made["loss"]).alias("lost")).collect()
    got = {(r.tree, r["rank"]): r for r in out}
    assert [t.text for t in got[1, 1].turns] == ["q", "c"] and [t.text for t in got[1, 2].turns] == ["q", "a", "b"]
    want = [(r[3], r[4] or "") for r in rows if r[0] is None]
    assert [(t.role, t.text) for t in got[None, 1].turns] == want
    assert got[None, 1].lost == "".join(t for r, t in want if r == "assistant")
    assert got[None, 1].formatted.count("</turn>") == 40


def test_query_matches_plain_python_and_sql(spark, tmp_path):
    rows = [(i % 5 if i % 7 else None, i, ["system", "user", "assistant"][i % 3], NASTY[i % len(NASTY)], "x") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, tree string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in C.op2_chat(spark, str(tmp_path)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role, text or ""))
    by[-7] = [(0, "user", C.PLANTED), (1, "assistant", C.PLANTED)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, turns in by.items():
        lost = "".join(t for _, r, t in sorted(turns) if r == "assistant")
        assert got[c][:4] == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in sorted(turns))), len(lost), sha(lost))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(C.OP2_SQL).fetchall()} == got


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert C.conversations_of(C.threads(empty)).count() == 0
