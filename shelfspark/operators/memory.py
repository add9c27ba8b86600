"""Conversation memory: recent turns, token budget, history and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import fixed_values as V
from shelfspark.config import MemoryConfig, SearchConfig
from shelfspark.functions.text import estimate_tokens, prefix, strip
from shelfspark.operators.keyed import top_per_key
from shelfspark.operators.scan import running
from shelfspark.session import fill, let


def history_line(role: Column, text: Column, max_chars: int) -> Column:
    """``Label: text`` on one line, or null for a blank message."""
    label = F.when(role == "user", F.lit(V.USER_LABEL)).otherwise(F.lit(V.ASSISTANT_LABEL))
    body = F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return let(body, lambda b: F.when(b != "", F.concat(label, F.lit(": "), prefix(b, max_chars, "…"))))


def last_turns(messages: DataFrame, window: int = 5, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``2 * window`` messages; each task cuts a conversation before the shuffle."""
    return top_per_key(messages, [conv], [F.col(turn).desc()], 2 * window, "back")


def format_history(messages: DataFrame, cfg: MemoryConfig = MemoryConfig(), conv: str = "conv_id",
                   turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """History text of the last turns; at most ``2 * window`` lines are gathered per group."""
    recent = last_turns(messages, cfg.window, conv, turn)
    lines = recent.select(conv, turn, history_line(F.col(role), F.col(text), cfg.message_chars).alias("line")).filter("line is not null")
    gathered = lines.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "line"))).alias("l"))
    return gathered.select(conv, F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("history"))


def suffix_sums(df: DataFrame, key: str, pos: str, values: list[str], carry: dict[str, Column] | None = None,
                block: int | None = None) -> DataFrame:
    """Adds ``<value>_after``, the sum over this and all later rows of the same key, and
    ``<value>_total``; ``carry`` adds maxima over the whole key (name -> column).

    A scan over ranges of rows: positions may be times or leave gaps, and even a key with a
    third of all rows is spread over the cluster. ``block`` aims at a number of rows per range.
    """
    names = {f"{v}_after": F.col(v) for v in values}
    out = running(df, [key], [F.col(pos).desc()], names, totals=True, maxima=carry, block=block)
    return out.withColumnsRenamed({f"{v}_after_total": f"{v}_total" for v in values})


def memory_budget(query_tokens: Column, system_tokens: int, cfg: MemoryConfig) -> Column:
    fixed = F.lit(system_tokens + int(cfg.context_chars * cfg.top_k / cfg.chars_per_token) + 64) + query_tokens
    return F.greatest(F.lit(256), F.lit(int(cfg.token_limit * cfg.trigger_ratio)) - fixed).cast("long")


def fit_memory(messages: DataFrame, cfg: MemoryConfig = MemoryConfig(), *, system_tokens: int = 0,
               budget: int | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text", state: DataFrame | None = None) -> DataFrame:
    """Per conversation: where the verbatim history starts so that it fits the budget.

    The last message is the current question. Older messages leave two at a time until
    the formatted rest fits, the last ``2 * min_turns`` always staying. With
    ``state(conv, summarized_idx, summary)`` the count goes on from the given start, and a
    summary takes its own tokens and SUMMARY_EXTRA_TOKENS of the budget. Folding the messages
    that leave into the summary is left to the caller.
    """
    line = history_line(F.col(role), F.col(text), cfg.message_chars)
    m = messages.select(conv, turn, F.coalesce(F.length(line), F.lit(0)).cast("long").alias("chars"),
                        line.isNotNull().cast("long").alias("filled"), F.lit(1).cast("long").alias("one"),
                        estimate_tokens(text, cfg.chars_per_token).alias("own_tokens"))
    last = F.struct(F.col(turn).alias("turn"), "chars", "filled", "own_tokens")
    s = suffix_sums(m, conv, turn, ["chars", "filled", "one"], carry={"last": last})
    # The current question is taken off again, so its conversation needs no join of its own.
    prior = F.col(turn) < F.col("last.turn")
    chars, filled = F.col("chars_after") - F.col("last.chars"), F.col("filled_after") - F.col("last.filled")
    joined = chars + F.greatest(filled - 1, F.lit(0))
    tokens = F.when(joined == 0, F.lit(0)).otherwise(F.floor(joined / F.lit(cfg.chars_per_token)) + 1).cast("long")
    limit = F.lit(budget).cast("long") if budget is not None else memory_budget(F.col("last.own_tokens"), system_tokens, cfg)
    kept = F.col("one_after") - 1
    index = F.col("one_total") - F.col("one_after")
    begin = F.lit(0)
    if state is not None:
        told = strip(F.coalesce("summary", F.lit("")))
        given = state.select(conv, F.greatest(F.col("summarized_idx"), F.lit(0)).alias("_begin"),
                             F.when(told != "", estimate_tokens("summary", cfg.chars_per_token) + V.SUMMARY_EXTRA_TOKENS).otherwise(F.lit(0)).alias("_extra"))
        s = s.join(given, conv, "left").withColumns({"_begin": F.coalesce("_begin", F.lit(0)), "_extra": F.coalesce("_extra", F.lit(0))})
        begin, tokens = F.least("_begin", F.col("one_total") - 1), (tokens + F.col("_extra")).cast("long")
    ok = prior & (index >= begin) & ((index - begin) % 2 == 0) & ((tokens <= limit) | (kept <= 2 * cfg.min_turns))
    cut = s.groupBy(conv).agg(
        F.max("one_total").alias("n_messages"), F.min(F.when(ok, F.struct(index.alias("i"), tokens.alias("t")))).alias("cut"))
    start = F.coalesce("cut.i", F.col("n_messages") - 1)
    return cut.select(conv, "n_messages", start.alias("summarized_idx"), (F.col("n_messages") - 1 - start).alias("kept"),
                      F.coalesce("cut.t", F.lit(0)).cast("long").alias("history_tokens"))


def build_prompts(contexts: DataFrame, queries: DataFrame, system: str = "", warning: str = "",
                  memory_note: str = V.PROMPT_HISTORY_HEAD, history: DataFrame | None = None, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Prompt text per query from its numbered contexts (at most top_k per query).

    ``history(query_id, history[, summary])`` adds, under the note, the running summary of what
    left the window and the verbatim turns.
    """
    block = fill(V.PROMPT_SOURCE, n=F.col("source_idx").cast("string"), title=F.coalesce("title", F.lit(V.NO_TITLE)),
                 author=F.coalesce("author", F.lit(V.NO_AUTHOR)), text=F.substring("text", 1, cfg.context_chars))
    per = contexts.withColumn("_b", block).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("source_idx", "_b"))).alias("c"), F.max("low_confidence").alias("low"))
    q = queries.select("query_id", "query").join(per, "query_id", "left")
    past = F.lit("")
    if history is not None:
        if "summary" not in history.columns:
            history = history.withColumn("summary", F.lit(""))
        q = q.join(history.select("query_id", "history", "summary"), "query_id", "left")
        filled = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
        told = F.concat_ws("\n", F.when(filled("summary") != "", fill(V.PROMPT_SUMMARY, v=filled("summary"))), F.when(F.coalesce("history", F.lit("")) != "", F.col("history")))
        past = F.when(told != "", F.concat(F.lit(memory_note), told, F.lit("\n\n"))).otherwise(F.lit(""))
    body = F.array_join(F.transform(F.coalesce("c", F.array().cast("array<struct<source_idx:long,_b:string>>")), lambda s: s["_b"]), "")
    note = F.when(F.coalesce("low", F.lit(False)), F.lit(warning)).otherwise(F.lit(""))
    prompt = F.concat(F.lit(f"{system}\n\n"), past, F.lit(V.PROMPT_CONTEXT_HEAD), note, F.lit("\n"), body, fill(V.PROMPT_QUESTION, query=F.col("query")))
    return q.select("query_id", prompt.alias("prompt")).withColumn("prompt_tokens", estimate_tokens("prompt"))


def fallback_questions(title: Column, author: Column, has_context: Column, n: int = 3) -> Column:
    """Template questions for when no question generator is available."""
    t, a = F.coalesce(title, F.lit(V.THIS_WORK)), F.coalesce(author, F.lit(V.THIS_AUTHOR))
    about = F.array(*[fill(q, title=t, author=a) for q in V.QUESTIONS_ABOUT])
    general = F.array(*[F.lit(q) for q in V.QUESTIONS_GENERAL])
    return F.slice(F.when(has_context, about).otherwise(general), 1, n)


def export_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Chat export, one JSON and one text block per message, in order within a conversation."""
    label = F.when(F.col(role) == "user", F.lit(V.EXPORT_USER_LABEL)).otherwise(F.lit(V.EXPORT_ASSISTANT_LABEL))
    return messages.select(
        conv, turn, F.to_json(F.struct(F.col(role).alias("role"), F.col(text).alias("content"))).alias("json"),
        F.concat(label, F.lit(":\n"), F.col(text), F.lit("\n"), F.lit("-" * 50)).alias("txt"))
