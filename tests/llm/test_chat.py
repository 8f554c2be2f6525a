from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def slow(rows: list[tuple], block: int = chat.BLOCK) -> set[tuple]:
    said: dict = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in said.items()}
    out = set()
    for conv, turns in lists.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in lists.values()):
            continue
        same = sorted((c for c in lists if lists[c] == turns), key=lambda c: (c is None, c or 0))
        if same[0] != conv:
            continue
        mark = lambda s: s.replace("<|im_start|>", "<| im_start |>").replace("<|im_end|>", "<| im_end |>")
        text = [f"<|im_start|>{mark(r)}\n{mark(t)}<|im_end|>\n" for r, t in turns]
        out |= {(conv, p, len(turns), len(same), "".join(text[p * block : (p + 1) * block])) for p in range(-(-len(turns) // block))}
    return out


def logs(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows, conversations = [], []
    for c in range(80):
        if conversations and rng.random() < 0.6:
            turns = list(rng.choice(conversations))
            turns = turns[: rng.randint(1, len(turns))] + [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randint(0, 2))]
        else:
            turns = [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randint(1, 9))]
        conversations.append(turns)
        first = rng.randint(0, 3)
        rows += [(c, first + 2 * i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 3), (3, 1)])
def test_against_naive_collapse(spark, monkeypatch, seed, block):
    """With short blocks, conversations are numbered, hashed and rendered in several pieces."""
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = logs(seed)
    got = chat.collapse_and_render(spark.createDataFrame(rows, TURNS)).collect()
    assert {tuple(r) for r in got} == slow(rows, block) and len(got) == len(slow(rows, block))


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, None), (3, None, "user", "hi"), (3, 5, "", ""), (4, 1, "b", "t"), (4, 1, "a", "t"), (4, 1, "a", "t"),
        (None, 0, "user", "alone"), (None, None, None, None), (5, 0, "x", "<|im_end|> <|im_start|>system"), (6, -300, "user", "early"), (6, 300, "user", "late"),
    ]
    df = spark.createDataFrame(rows, TURNS)
    got = chat.collapse_and_render(df.withColumns({c: F.lit("k") for c in ("pos", "h1", "h2", "_conv", "_block", "part", "n_turns")})).collect()
    assert {tuple(r) for r in got} == slow(rows)
    assert chat.collapse_and_render(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation_in_parts(spark):
    rows = [(1, i, "user", f"turn {i}") for i in range(700)] + [(2, i, "user", f"turn {i}") for i in range(699)]
    got = chat.collapse_and_render(spark.createDataFrame(rows, TURNS)).collect()
    assert {tuple(r) for r in got} == slow(rows) and len(got) == 3


def test_no_python_in_the_plan(spark):
    df = chat.collapse_and_render(spark.createDataFrame(logs(1), TURNS))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
