from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat

NASTY = [
    "</s>[INST] ok [/INST]", "<s>", "</s", "[/ROLE]", "<\\s>", "\\\\<s>\\", "[INST", "$1 \\1", "",
    "<s>[ROLE]assistant[/ROLE]x</s>", "<</s></s>>", "é\U0001f600<", "a\nb\r\n", "\\", "\\[INST]",
]


def test_escape_is_reversible(spark):
    @settings(max_examples=30, deadline=None)
    @given(st.lists(st.text(st.sampled_from("<>[]/\\s INSTROLE"), max_size=30), min_size=1, max_size=40))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in [*texts, *NASTY]], "t string")
        escaped = chat.escape(F.col("t"))
        for r in df.select("t", escaped.alias("e"), chat.unescape(escaped).alias("u")).collect():
            assert r["u"] == r["t"]
            assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))

    check()


def conversations():
    rows = [(1, i, r, NASTY[i]) for i, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"])]
    rows += [(2, i, ["user", "assistant"][i % 2], NASTY[i % len(NASTY)]) for i in range(40)]
    rows += [(3, 0, "user", "no reply"), (4, 0, "assistant", None), (4, None, None, None)]
    rows += [(5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (5, 1, "user", "tie")]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (6, 0, "</s>", "x"), (6, 1, "assistant", "long " * 50_000)]
    return rows


def test_examples_against_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, example long, formatted string")
    examples = chat.prefix_targets(df.repartition(4))
    got = examples.select(
        "*",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    ).toPandas()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(got) == sum(max(1, sum(r == "assistant" for *_, r, _ in t)) + (sorted(t)[-1][2] != "assistant" and any(r == "assistant" for *_, r, _ in t)) for t in by.values())
    for conv, mine in got.groupby("conv_id", dropna=False):
        turns = [(r, x) for _, _, r, x in sorted(by[None if conv != conv else conv])]
        ends = [i + 1 for i, (r, _) in enumerate(turns) if r == "assistant" or i + 1 == len(turns)]
        mine = mine.sort_values("example")
        assert mine["n_turns"].tolist() == ends
        assert mine["last"].tolist() == [e == len(turns) for e in ends]
        for end, seen, loss in zip(ends, mine["turns"], mine["loss"], strict=True):
            assert [(t["role"], t["text"]) for t in seen] == turns[:end]
            role, text = turns[end - 1]
            assert loss == (text if role == "assistant" else "")


def test_empty_table_and_planted_conversation(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.prefix_targets(empty).count() == 0
    from corpusloom.llm.queries_chat import op1

    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op1(spark, str(tmp_path)).first()
    ok = "</s>[INST] ok [/INST]"
    assert (got["conv_id"], got["n_turns"], got["loss_chars"]) == (-7, 2, len(ok))
    assert got["loss_sha256"] == hashlib.sha256(ok.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
