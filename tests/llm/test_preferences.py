from __future__ import annotations

from nightspark.llm import preferences as p

SCHEMA = "pair long, turn long, role string, text string, part string, _side string"


def rows(spark, turns):
    return spark.createDataFrame([(*t, "q", "z") for t in turns], SCHEMA)


def test_common_prefix_and_completions(spark):
    same = [(1, 0, "system", "s"), (1, 1, "user", "u")]
    chosen = [*same, (1, 2, "assistant", "good"), (1, 3, "user", "more"), (2, 0, "user", "only"), (3, 0, "user", None), (None, 0, "user", "lost"), (4, None, "user", "n"), (4, 0, "user", "m")]
    rejected = [*same, *same, (1, 2, "assistant", "bad"), (3, 0, "user", ""), (4, None, "user", "n"), (4, 0, None, "m"), (5, 2, "assistant", "r")]
    out = {tuple(r) for r in p.preference_rows(rows(spark, chosen), rows(spark, rejected)).collect()}
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert out == {
        (1, "prompt", 0, "system", turn("system", "s"), False), (1, "prompt", 1, "user", turn("user", "u"), False),
        (1, "chosen", 2, "assistant", turn("assistant", "good"), True), (1, "chosen", 3, "user", turn("user", "more"), False),
        (1, "rejected", 2, "assistant", turn("assistant", "bad"), True), (2, "chosen", 0, "user", turn("user", "only"), False),
        (3, "chosen", 0, "user", turn("user", ""), False), (3, "rejected", 0, "user", turn("user", ""), False),
        (4, "prompt", None, "user", turn("user", "n"), False), (4, "chosen", 0, "user", turn("user", "m"), False),
        (4, "rejected", 0, None, turn("", "m"), False), (5, "rejected", 2, "assistant", turn("assistant", "r"), True)}


def test_equal_sides_are_all_prompt_and_no_rows_give_none(spark):
    turns = [(1, i, "assistant", "x" * i) for i in range(4)] + [(1, 2, "user", "two rows of one turn")]
    out = p.preference_rows(rows(spark, turns), rows(spark, turns)).collect()
    assert len(out) == 5 and {r.part for r in out} == {"prompt"} and not any(r.trained for r in out)
    assert p.preference_rows(rows(spark, []), rows(spark, [])).collect() == []
