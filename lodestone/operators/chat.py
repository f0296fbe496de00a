"""Conversations: histories, pairs of question and answer, exports, feedback that becomes gold samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation (conv_id, turn) with `place` from the oldest."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= n).drop("nth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, answer, question): each assistant message with the user message just before it, if there is one.

    A join on the turn before and not a lag: turns may have gaps.
    """
    answers = messages.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = messages.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return answers.join(asked, ["conv_id", "turn"], "left")


def next_turn(messages: DataFrame) -> DataFrame:
    """(conv_id, last, next_user, next_assistant)."""
    last = F.coalesce(F.max("turn"), F.lit(0))
    return messages.groupBy("conv_id").agg(last.alias("last")).withColumns({"next_user": F.col("last") + 1, "next_assistant": F.col("last") + 2})


def first_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, user, assistant): the first text of either role."""
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn"))).alias(role)
    return messages.groupBy("conv_id").agg(first("user"), first("assistant"))


def markdown(messages: DataFrame) -> DataFrame:
    """(conv_id, markdown): each conversation as a text. It gathers a conversation into one row, which its export needs."""
    line = F.concat(F.lit("**"), F.initcap(F.coalesce("role", F.lit("assistant"))), F.lit(":** "), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    title = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n## Messages\n\n"))
    by = messages.groupBy("conv_id").agg(parts.alias("parts"))
    return by.select("conv_id", F.concat(title, F.array_join(F.transform("parts", lambda x: x["line"]), "")).alias("markdown"))


def first_source(sources: Column) -> Column:
    """(document_id, chunk_index, span) of the first of a JSON array of sources; nulls for anything that isn't one."""
    rows = F.from_json(sources, "array<struct<document_id:string,chunk_index:string,text:string,content:string>>")
    one = F.get(rows, F.lit(0))
    return F.struct(one["document_id"].alias("document_id"), one["chunk_index"].try_cast("int").alias("chunk_index"), F.coalesce(one["text"], one["content"]).alias("span"))


def promote(gold: DataFrame, rated: DataFrame, messages: DataFrame) -> DataFrame:
    """Gold samples (source_id, question, answer) after ratings (conv_id, turn, rating) came in.

    An assistant message rated 1 with a question before it replaces or adds its sample; any other rating takes it away.
    source_id is `conv_id:turn`; samples without one stay. Of several ratings of a message the latest by the column
    `rated_at` counts, without one the highest.
    """
    key = F.concat_ws(":", "conv_id", "turn").alias("source_id")
    when = F.col("rated_at") if "rated_at" in rated.columns else F.lit(0)
    last = F.max(F.struct(when.alias("at"), "rating")).alias("last")
    judged = rated.groupBy(key).agg(last).select("source_id", F.col("last.rating").alias("rating"))
    found = pairs(messages).where("question is not null").select(key, "question", "answer")
    new = found.join(judged.where("rating = 1"), "source_id").select("source_id", "question", "answer")
    return gold.join(judged.select("source_id"), "source_id", "left_anti").unionByName(new)


def without_message(messages: DataFrame, gone: DataFrame, with_partner: bool = True) -> DataFrame:
    """messages without those in gone (conv_id, turn), nor, if wanted, the answer after a user's or the question before
    an assistant's; the partner's turn must be over 0 and of the other role."""
    keys = gone.select("conv_id", "turn").distinct()
    if with_partner:
        roles = messages.join(keys, ["conv_id", "turn"]).select("conv_id", "turn", "role")
        step = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1)
        other = F.when(F.col("role") == "user", "assistant").otherwise("user")
        near = roles.where(step.isNotNull()).select("conv_id", (F.col("turn") + step).alias("turn"), other.alias("role")).where("turn > 0")
        keys = keys.unionByName(messages.join(near, ["conv_id", "turn", "role"], "left_semi").select("conv_id", "turn")).distinct()
    return messages.join(keys, ["conv_id", "turn"], "left_anti")


def feedback(messages: DataFrame, conversations: DataFrame, gold: DataFrame, rating: int | None = None, most: int = 500) -> DataFrame:
    """The newest rated answers (conv_id, turn, rating, collection, gold_id), at most 500: with one rating, or any but 0.

    messages (conv_id, turn, role, rating, created_at), conversations (conv_id, collection), gold (source_id, gold_id)."""
    wanted = F.coalesce(F.col("rating"), F.lit(0)) != 0 if rating is None else F.col("rating") == rating
    own = messages.where((F.col("role") == "assistant") & wanted).join(conversations.select("conv_id", "collection"), "conv_id")
    own = own.orderBy(F.desc("created_at"), "conv_id", "turn").limit(max(1, min(most, 500)))
    own = own.withColumn("source_id", F.concat_ws(":", "conv_id", "turn"))
    return own.join(gold.select("source_id", "gold_id"), "source_id", "left").select("conv_id", "turn", "rating", "collection", "gold_id")


def source_list(sources: Column | str, most: int = 100, length: int = 200) -> Column:
    """An array of (name, chunk_index, score, text) as lines, the first `most`, with the beginning of each text."""
    sources = F.col(sources) if isinstance(sources, str) else sources

    def line(s: Column) -> Column:
        flat = F.replace(F.trim(F.coalesce(s["text"], F.lit(""))), F.lit("\n"), F.lit(" "))
        cut = F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("…"))).otherwise(flat)
        part = lambda c, none: F.coalesce(s[c].cast("string"), F.lit(none))
        return F.concat(F.lit("- "), part("name", "unknown"), F.lit(" (chunk "), part("chunk_index", "?"), F.lit(", score "), part("score", "?"), F.lit("): "), cut)

    return F.array_join(F.transform(F.slice(sources, 1, most), line), "\n")


def confidence(scores: Column | str) -> Column:
    """The mean of an array of scores, 0 for none."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, 0.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
