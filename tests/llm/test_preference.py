"""Preference pairs against plain Python."""

from corpuscat.llm.preference import answers_exchanged, pair_neighbours, preference_pairs

SCHEMA = "conv_id bigint, turn bigint, role string, text string, prompt string"
ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 5, "user", "same"), (3, 9, "assistant", "same"),
    (4, 0, "system", None), (4, 1, None, "x"), (5, 0, "system", ""), (5, 1, "", "x"), (5, 2, "assistant", "tail"),
    (6, 0, "user", "alone"), (9, 0, "assistant", "odd alone"), (None, 0, "user", "lost"),
    (10, 0, "user", "tie"), (10, 0, "assistant", "tie"), (10, None, "user", "null turn"), (10, 0, "user", "tie"),
    (11, 0, "user", "é" * 50_000), (11, 1, "assistant", "ü" * 50_000),
]


def plain(rows):
    talks = {}
    for c, n, r, t in rows:
        if c is not None:
            talks.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    out = {}
    for pair in {c // 2 for c in talks}:
        a, b = (sorted(talks.get(2 * pair + k, [])) for k in (0, 1))
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        texts, spans = [], []
        for part in (a[:n], a[n:], b[n:]):
            text, at = "", []
            for _, r, t in part:
                start = len(text) + len(f"<|{r}|>\n")
                text += f"<|{r}|>\n{t}<|end|>\n"
                if r == "assistant":
                    at += [start, len(text)]
            texts.append(text)
            spans.append(at)
        out[pair] = (2 * pair if a else None, 2 * pair + 1 if b else None, n, *texts, *spans[1:])
    return out


def test_pairs(spark):
    turns = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(5)
    got = {r["pair_id"]: tuple(r)[1:] for r in preference_pairs(turns, pair_neighbours(turns)).collect()}
    assert got == plain(ROWS)
    r = got[0]
    assert r[4][r[6][0] : r[6][1]] == "yes<|end|>\n"


def test_empty_and_native(spark, plan_of):
    turns = spark.createDataFrame([], SCHEMA)
    df = preference_pairs(turns, pair_neighbours(turns))
    assert df.count() == 0 and "Python" not in plan_of(df)


def test_exchanged_answers_share_a_prompt(spark):
    """Every conversation meets itself with its neighbour's last answer; what comes before is the prompt."""
    rows = [(0, 1, "user", "q0", "x"), (0, 2, "assistant", "a0", "x"), (0, 3, "user", "r0", "x"), (0, 4, "assistant", "b0", "x"),
            (1, 1, "user", "q1", "x"), (1, 2, "assistant", "a1", "x"), (1, 3, "user", "thanks", "x"),
            (2, 1, "user", "q2", "x"), (2, 2, "assistant", "a2", "x"), (3, 1, "user", None, "x"), (3, 2, None, "z", "x"), (None, 1, "user", "lost", "x"), (-4, 1, "assistant", "only", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, own string")
    made, pairs = answers_exchanged(turns)
    got = {r["pair_id"]: r for r in preference_pairs(made, pairs).collect()}
    assert sorted(got) == [-4, 0, 1, 2, 3]
    assert got[0]["n_prompt_turns"] == 3 and "b0" in got[0]["chosen"] and "a1" in got[0]["rejected"] and "r0" in got[0]["prompt"]
    assert got[1]["n_prompt_turns"] == 1 and "a1" in got[1]["chosen"] and "b0" in got[1]["rejected"] and "thanks" in got[1]["rejected"]
    assert got[2]["n_prompt_turns"] == 1 and "a2" in got[2]["chosen"] and "<|assistant|>\n<|end|>" in got[2]["rejected"]
    assert got[3]["n_prompt_turns"] == 2 and got[3]["chosen"] == got[3]["rejected"] == ""
    assert got[-4]["n_prompt_turns"] == 0
    a, b = got[0]["chosen_spans"]
    assert got[0]["chosen"][a:b].startswith("b0")
    empty, none = answers_exchanged(turns.limit(0))
    assert preference_pairs(empty, none).count() == 0
