"""Preference formatting of chosen and rejected conversations, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def render(role: Column, text: Column) -> Column:
    """One turn in the chat layout: a role mark, the text, an end mark."""
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), role, F.lit(after), text, F.lit(CLOSE))


def pair_neighbours(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``pair_id, chosen_id, rejected_id``: conversation 2k chosen over conversation 2k + 1.

    The first of each two ids is the preferred one. A conversation whose partner is
    missing is paired with null. Conversations without id are left out.
    """
    ids = turns.select(F.col(f"`{conv_col}`").alias("c")).filter("c is not null").distinct()
    pair = F.floor(F.col("c") / 2).cast("bigint")
    even = F.pmod(F.col("c"), F.lit(2)) == 0
    return ids.groupBy(pair.alias("pair_id")).agg(
        F.min(F.when(even, F.col("c"))).alias("chosen_id"), F.min(F.when(~even, F.col("c"))).alias("rejected_id")
    )


def answers_exchanged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      role: str = TRAINED_ROLE) -> tuple[DataFrame, DataFrame]:
    """Preferences from plain conversations: ``turns, pairs`` for ``preference_pairs``.

    Conversation c is preferred over the same conversation with the last answer, the last
    turn of ``role``, of its neighbour (c + 1 for an even c, c - 1 for an odd one) in place
    of its own; so both share all turns before that answer. The two stand under the ids 2c and
    2c + 1, the pair under c. Without a neighbour, or if that has no answer, the text is
    empty; a conversation without answers is its own opposite. Null roles and texts are
    empty, and conversations without id are left out. Each conversation joins one row of its own and one
    of its neighbour, so no key is hot beyond the turns of one conversation.
    """
    c = F.col(f"`{conv_col}`").cast("bigint")
    said = turns.select(
        c.alias("c"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).filter("c is not null")
    last = said.filter(F.col("role") == role).groupBy("c").agg(F.max(F.struct("turn", "text")).alias("own"))
    beside = last.select((F.col("c") + 1 - 2 * F.pmod("c", F.lit(2))).alias("c"), F.col("own.text").alias("other"))
    both = said.join(last.join(beside, "c", "left"), "c", "left")
    answer = (F.col("role") == role) & F.struct("turn", "text").eqNullSafe(F.col("own"))
    text = F.when(F.coalesce(answer, F.lit(False)), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    made = both.select(F.explode(F.array(
        F.struct((F.col("c") * 2).alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col)),
        F.struct((F.col("c") * 2 + 1).alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), text.alias(text_col)),
    )).alias("t")).select("t.*")
    pairs = said.select("c").distinct().select(F.col("c").alias("pair_id"), (F.col("c") * 2).alias("chosen_id"), (F.col("c") * 2 + 1).alias("rejected_id"))
    return made, pairs


def preference_pairs(turns: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per pair: the shared prompt once, both completions, and their loss spans.

    Columns: ``pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected,
    chosen_spans, rejected_spans``. The prompt is the longest common prefix of turns, equal
    in role and text. Spans are flat lists ``start, end, start, end ...`` of the code
    points within a completion whose tokens are trained: the texts of ``trained_role`` with their end marks. All else,
    prompt included, is masked.

    Turns sort by number, then role, then text; equal rows count as turns each. Null roles
    and texts are empty. A missing conversation has no turns, so the prompt is empty.
    Extra columns are not read. A pair is one training example and so one row; pairs spread
    by their id, and shared first turns make no key hot.
    """
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("chosen_id").alias("c"), F.lit(True).alias("chosen")),
        F.struct(F.col("rejected_id").alias("c"), F.lit(False).alias("chosen")),
    )).alias("s")).select("pair_id", "s.c", "s.chosen").filter("c is not null")
    said = turns.select(
        F.col(f"`{conv_col}`").alias("c"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        ).alias("t"),
    ).filter("c is not null")
    talks = said.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("talk"))
    both = sides.join(talks, "c").groupBy("pair_id").agg(
        F.max(F.when(F.col("chosen"), F.struct("c", "talk"))).alias("a"), F.max(F.when(~F.col("chosen"), F.struct("c", "talk"))).alias("b")
    )
    empty = F.array().cast(both.schema["a"].dataType["talk"].dataType)
    both = both.select("pair_id", F.col("a.c").alias("chosen_id"), F.col("b.c").alias("rejected_id"),
                       F.coalesce("a.talk", empty).alias("a"), F.coalesce("b.talk", empty).alias("b"))
    # Role and text decide, whatever the numbers of the turns are.
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    shared = F.array_position(same, False)
    n = F.when(shared > 0, shared - 1).otherwise(F.size("a")).cast("int")
    both = both.withColumn("n_prompt_turns", n)
    parts = {"prompt": F.slice("a", 1, F.col("n_prompt_turns")), "chosen": F.slice("a", F.col("n_prompt_turns") + 1, F.size("a")), "rejected": F.slice("b", F.col("n_prompt_turns") + 1, F.size("b"))}
    for name, turns_of in parts.items():
        both = both.withColumn(f"_{name}", F.transform(turns_of, lambda t: F.struct(render(t["role"], t["text"]).alias("shown"), F.length(t["role"]).alias("r"), (t["role"] == trained_role).alias("on"))))
    rendered = [F.array_join(F.col(f"_{name}.shown"), "").alias(name) for name in parts]
    return both.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", *rendered, *[_spans(F.col(f"_{k}")).alias(f"{k}_spans") for k in ("chosen", "rejected")])


def _spans(parts: Column) -> Column:
    """Code-point spans of the trained turns in the joined text of ``parts``."""
    span = "array<bigint>"
    head = len(OPEN.format(""))

    def step(acc: Column, p: Column) -> Column:
        end = (acc["at"] + F.length(p["shown"])).cast("bigint")
        one = F.array((acc["at"] + head + p["r"]).cast("bigint"), end)
        return F.struct(end.alias("at"), F.when(p["on"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(span).alias("spans"))
    return F.aggregate(parts, start, step)["spans"]
