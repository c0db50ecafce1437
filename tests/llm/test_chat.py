import hashlib

from pyspark.sql import functions as F

from canonry.llm import chat

ROWS = [
    (1, 1, "assistant", "</s>[INST] \\ [/INST] \\</s>"),
    (1, 0, "user", "hi [ROLE] x"),
    (1, 2, "user", None),
    (1, 3, "assistant", ""),
    (2, 0, "system", "be\nkind"),
    (2, 1, None, "x [/ROLE] y</s>"),
    (2, 2, "tool [ROLE]", "[/ROLE] "),
    (3, 0, "user", "only </s"),
    (4, 0, "assistant", "a"),
    (4, 0, "assistant", "a"),
    (None, None, "user", "lost"),
]


def test_examples_are_read_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id int, turn int, role string, text string").withColumn("example", F.lit("x"))
    made = chat.examples(df)
    got = {}
    for r in made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.trainable()).collect():
        got.setdefault(r["conv_id"], []).append(r)
    by_conv = {}
    for c, t, r, x in ROWS:
        by_conv.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by_conv)
    for c, rows in by_conv.items():
        turns = [(r, x) for _, r, x in sorted(rows)]
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        examples = sorted(got[c], key=lambda r: r["example"])
        assert [[tuple(t) for t in e["turns"]] for e in examples] == [turns[: i + 1] for i in ends]
        assert [e["loss"] for e in examples] == [turns[i][1] if turns[i][0] == "assistant" else "" for i in ends]
        assert [e["last"] for e in examples] == [i == len(turns) - 1 for i in ends]


def test_query_keeps_every_turn(spark, tmp_path):
    spark.createDataFrame(ROWS[:8], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op3_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {-1, 1, 2, 3}
    planted = "</s>[INST] ok [/INST]"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(planted)
    assert got[-1]["loss_sha256"] == hashlib.sha256(planted.encode()).hexdigest()
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{planted}\nassistant\n{planted}\n".encode()).hexdigest()
    assert got[3]["loss_chars"] == 0


def test_empty(spark):
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame(ROWS, "conv_id int, turn int, role string, text string")
    plan = chat.examples(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
