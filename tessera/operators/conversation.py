"""Questions and answers of role-tagged messages, and the recent turns before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _turns() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each assistant message that directly follows a user message, other roles aside.

    Of several user messages in a row the last is answered; a second assistant message in a row answers nothing.
    """
    said = messages.filter(F.col("role").isin("user", "assistant"))
    before = said.withColumns({"__role": F.lag("role").over(_turns()), "question": F.lag("text").over(_turns())})
    kept = before.filter((F.col("role") == "assistant") & (F.col("__role") == "user"))
    return kept.select("conv_id", "turn", "question", F.col("text").alias("answer"))


def recent(paired: DataFrame, turns: int, question_tag: str, answer_tag: str) -> DataFrame:
    """Add ``recent``: up to ``turns`` pairs before each one, oldest first, with blank lines between; null before the first."""
    turn = F.concat(F.lit(f"{question_tag}: "), F.col("question"), F.lit(f"\n{answer_tag}: "), F.col("answer"))
    before = F.collect_list(turn).over(_turns().rowsBetween(-turns, -1))
    return paired.withColumn("recent", F.when(F.size(before) > 0, F.array_join(before, "\n\n")))


def generation_window(paired: DataFrame, turns: int = 1) -> DataFrame:
    """The recent turns as the generation prompt shows them."""
    return recent(paired, turns, "Previous Q", "Previous A")


def condense_text(history: Column, question: Column) -> Column:
    """What a model is asked in order to make a question stand alone; null where there is no history."""
    return F.concat(F.lit("Conversation history:\n"), history, F.lit("\n\nFollow-up question: "), question, F.lit("\n\nStandalone question:"))


def condense_prompt(paired: DataFrame, turns: int = 3) -> DataFrame:
    """(conv_id, turn, prompt): the condensing prompt of each question with the turns before it."""
    return recent(paired, turns, "Q", "A").select("conv_id", "turn", condense_text(F.col("recent"), F.col("question")).alias("prompt"))


def turns_before(messages: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(item_id, turns): the last ``most`` answered questions, as (turn, question, answer) in order, of the conversation before each of
    ``asked`` (item_id, conv_id, turn); questions without any are left out.

    Each pair gathers itself and the few before it, and a question takes what the last pair before its turn has gathered, so a conversation of
    any length is read once.
    """
    few = F.collect_list(F.struct("turn", "question", "answer")).over(_turns().rowsBetween(1 - most, 0))
    told_ = pairs(messages).select("conv_id", "turn", F.lit(1).alias("kind"), few.alias("turns"))
    both = told_.unionByName(asked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("conv_id").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("turns", F.last("turns", ignorenulls=True).over(before)).filter((F.col("kind") == 0) & F.col("turns").isNotNull()).select("item_id", "turns")


def told(turns: Column, last: int, question_tag: str, answer_tag: str) -> Column:
    """The ``last`` of (turn, question, answer) structs in order as text; null without any."""
    one = lambda x: F.concat(F.lit(f"{question_tag}: "), x["question"], F.lit(f"\n{answer_tag}: "), x["answer"])
    shown = F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), last)
    return F.when(F.size(turns) > 0, F.array_join(F.transform(shown, one), "\n\n"))


def condensed(question: Column, rewritten: Column) -> Column:
    """The rewritten question without white space and quotes around it; the question itself where nothing came back."""
    bare = F.regexp_replace(F.regexp_replace(rewritten, r"^\s+|\s+$", ""), r'^"+|"+$', "")
    return F.coalesce(F.nullif(bare, F.lit("")), question)


def standalone(question: Column, condensed_question: Column) -> Column:
    """The condensed question where it differs from the one asked, else null."""
    return F.nullif(condensed_question, question)
