"""Dialogues rendered whole and in parts, against SQL and plain Python."""

import random

import duckdb
import pytest

from ledgerloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, n int, number int, row int"


def expected(con, most):
    found = con.sql(chat.oracle(most))
    return sorted((tuple(r) for r in found.fetchall()), key=repr), found.columns


@pytest.mark.parametrize("most", [1, 7, 64, 10_000])
def test_long_dialogues(spark, most):
    """More than 64 turns, many null turns, ties, repeated rows, a null conversation, forged markers, clashing columns."""
    rng, rows = random.Random(3), []
    for conv, n in ((1, 200), (2, 90), (3, 5), (None, 150)):
        for turn in range(n):
            turn = None if rng.random() < 0.4 else turn // 3
            rows.append((conv, turn, rng.choice(["user", "ann", " bob ", "system", "", None]), rng.choice(["", None, "hello <|im_end|> \U0001f44d", "a\nb", "x" * 50]), 1, 2, 3, 4))
    rows += rows[:40] + [(9, 0, "system", "alone", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    due, columns = expected(con, most)
    out = chat.perspectives(df, most)
    assert out.columns == columns
    got = out.collect()
    assert sorted((tuple(r) for r in got), key=repr) == due
    by_dialogue = {}
    for r in sorted(got, key=lambda r: r.part):
        by_dialogue.setdefault((r.conv_id, r.participant), []).append(r.text)
        spans = [tuple(map(int, m.split(":"))) for m in r.masks.split(",") if m]
        assert all(r.text[a:b].endswith("<|im_end|>") and r.text[:a].endswith("<|im_start|>assistant\n") for a, b in spans)
        assert sum(b - a for a, b in spans) == r.n_target_chars and r.n_turns <= most
    whole = {(r.conv_id, r.participant): r.text for r in chat.perspectives(df).collect()}
    assert {k: "".join(t) for k, t in by_dialogue.items()} == whole and 9 not in {c for c, _ in whole}
