from pyspark.sql import functions as F

from lodestone.llm import preference

S, E = preference.START, preference.END


def shown(role, text):
    return f"{S}{role}\n{text}{E}"


ROWS = [
    (0, 0, "user", "Hi"), (0, 1, "assistant", "Yes"), (0, 2, "user", "More"), (0, 3, "assistant", "A"),
    (1, 1, "assistant", "Yes"), (1, 0, "user", "Hi"), (1, 2, "user", "More"), (1, 3, "assistant", "B"), (1, 4, "assistant", None),
    (2, 0, "user", "same"), (3, 0, "user", "same"),
    (4, 0, None, "x"),
    (None, 0, "user", "lost"),
    (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "user", "a"),
    (-1, 0, "user", "neg"),
]


def pairs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "turns", "pair", "n", "a", "b")})
    return {r["pair"]: r for r in preference.format_pairs(preference.pairs_by_number(df)).collect()}


def test_prompt_completions_and_masks(spark):
    got = pairs(spark)
    assert sorted(got) == [-1, 0, 1, 2, 3]
    r = got[0]
    assert r["n_prompt_turns"] == 3 and r["prompt"] == shown("user", "Hi") + shown("assistant", "Yes") + shown("user", "More")
    assert r["chosen_completion"] == shown("assistant", "A") and r["rejected_completion"] == shown("assistant", "B") + shown("assistant", "")
    text = r["rejected_completion"]
    assert [text[a:z] for a, z in r["rejected_mask"]] == ["B" + E, E]
    assert [r["chosen_completion"][a:z] for a, z in r["chosen_mask"]] == ["A" + E]


def test_equal_missing_and_repeated(spark):
    got = pairs(spark)
    assert got[1]["prompt"] == shown("user", "same") and got[1]["chosen_completion"] == got[1]["rejected_completion"] == ""
    assert got[2]["n_prompt_turns"] == 0 and got[2]["chosen_completion"] == shown("", "x") and got[2]["chosen_mask"] == []
    assert got[3]["n_prompt_turns"] == 1 and got[3]["chosen_completion"] == shown("user", "a") and got[3]["rejected_completion"] == ""
    assert got[-1]["chosen_completion"] == "" and got[-1]["rejected_completion"] == shown("user", "neg")
    assert pairs(spark, []) == {}
