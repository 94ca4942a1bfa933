"""Context budgets: chat token counts, fit-to-context, keep-last truncation.

SURVEY AG8, RK4, SC9. The tokenizer is pluggable: any function
``Column(string) -> Column(array<string>)``; the default splits on ASCII
whitespace (the reference's BPE tables are not available offline).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keep_last
from ..session import materialize

Tokenizer = Callable[[Column], Column]

# ASCII whitespace; the same class in Java regex and RE2
_WS = r"[ \t\n\r\f\x0B]+"

# Per-message and per-reply overheads of the chat format.
TOKENS_PER_MESSAGE = 3
TOKENS_PER_NAME = 1
TOKENS_PER_REPLY = 3


def whitespace_tokenizer(c: Column) -> Column:
    return F.filter(F.split(c, _WS), lambda x: x != F.lit(""))


def n_tokens(c, tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    return F.size(tokenizer(F.col(c) if isinstance(c, str) else c))


def message_cost(role="role", content="content", tokenizer: Tokenizer = whitespace_tokenizer,
                 name=None) -> Column:
    """3 + tokens(role) + tokens(content) for one message; a message with a
    ``name`` adds tokens(name) + 1."""
    cost = F.lit(TOKENS_PER_MESSAGE) + n_tokens(role, tokenizer) + n_tokens(content, tokenizer)
    if name is None:
        return cost
    name = F.col(name) if isinstance(name, str) else name
    return cost + F.when(name.isNotNull(), n_tokens(name, tokenizer) + F.lit(TOKENS_PER_NAME)).otherwise(0)


def count_message_tokens(messages: DataFrame, conv: str = "conv_id",
                         tokenizer: Tokenizer = whitespace_tokenizer, name: str | None = None, cost: str | None = None) -> DataFrame:
    """AG8: per conversation, sum of message costs + 3 (partial aggregation
    before the shuffle, so a huge conversation costs nothing extra). ``name``
    is the column of the speakers' names, if there is one; ``cost`` one that holds
    the messages' costs already (``tokens.with_message_cost``)."""
    each = F.col(cost) if cost else message_cost("role", "text", tokenizer, name)
    return (messages.groupBy(conv)
            .agg(F.count(F.lit(1)).cast("long").alias("n_messages"),
                 (F.sum(each) + F.lit(TOKENS_PER_REPLY)).cast("long").alias("tokens")))


def fit_messages(messages: DataFrame, limit: int | Column, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", content: str = "text", reserve: int = 0,
                 tokenizer: Tokenizer = whitespace_tokenizer, bounded: bool = False,
                 name: str | None = None, cost: str | None = None) -> DataFrame:
    """RK4: drop the two oldest non-system messages until the chat fits.

    A leading system message is kept. The kept part is a suffix of the
    other messages starting at an even index s; s is the smallest even
    index with system + suffix(s) + 3 <= limit - reserve. Where no such s
    exists (the reference would pop past the end) nothing is kept and
    ``overflow`` is true. Adds ``kept``, ``overflow``, ``tokens_after``.

    A segmented scan: messages are range-partitioned by (conversation, turn)
    and written once, so that a conversation of any length is many slices.
    Each slice counts and sums by itself. Only a conversation that lies in
    several slices, at most one per slice end, needs what its other
    slices hold (messages and cost before, in all, the leading role, the
    smallest start found); these are tables of a row a slice. Nothing joins on
    the conversation. ``bounded=True`` declares conversations bounded (one prompt's messages):
    each is one slice and nothing is written. ``name`` is the column of the
    speakers' names, if there is one. ``limit`` may be a column that is the same
    for all messages of a conversation; ``cost`` names a column that holds the
    messages' costs already (``tokens.with_message_cost``).
    """
    each = F.col(cost) if cost else message_cost(role, content, tokenizer, name)
    costed = messages.withColumn("_cost", each.cast("long"))
    if bounded:
        return _fit_slices(costed.withColumn("_slice", F.lit(0)), messages.columns, conv, turn, role, limit - reserve)
    sliced = materialize(costed.repartitionByRange(conv, turn).withColumn("_slice", F.spark_partition_id()))
    summary = (sliced.groupBy(conv, "_slice")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("_cost").alias("cost"), F.min_by(role, turn).alias("role"),
                    F.min_by("_cost", turn).alias("first_cost")))
    every = Window.partitionBy(conv)
    before = every.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = every.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = materialize(summary.withColumns({
        "_slices": F.count(F.lit(1)).over(every), "_before_n": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "_before_cost": F.coalesce(F.sum("cost").over(before), F.lit(0)), "_all_n": F.sum("n").over(every), "_all_cost": F.sum("cost").over(every),
        "_lead": F.first("role").over(first), "_lead_cost": F.first("first_cost").over(first)})
        .filter("_slices > 1").drop("n", "cost", "role", "first_cost", "_slices"))
    return _fit_slices(sliced, messages.columns, conv, turn, role, limit - reserve, around)


def _fit_slices(m: DataFrame, columns: list[str], conv: str, turn: str, role: str, budget: int, around: DataFrame | None = None) -> DataFrame:
    """The scan of ``fit_messages`` over rows with ``_cost`` and ``_slice``;
    ``around`` holds what lies around the slices of conversations that have several."""
    inside = Window.partitionBy(conv, "_slice")
    sofar = inside.orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = inside.orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = m.withColumns({
        "_n": F.count(F.lit(1)).over(sofar), "_sum": F.sum("_cost").over(sofar), "_all_n": F.count(F.lit(1)).over(whole),
        "_all_cost": F.sum("_cost").over(whole), "_lead": F.first(role).over(whole), "_lead_cost": F.first("_cost").over(whole)})
    if around is not None:
        m = _beside(m, around.withColumn("_here", F.lit(True)), conv, ["_slice"]).withColumn("_several", F.coalesce("_here", F.lit(False)))
        for c in ("_all_n", "_all_cost", "_lead", "_lead_cost"):
            m = m.withColumn(c, F.when(F.col("_several"), F.col(f"_far{c}")).otherwise(F.col(c)))
        m = m.withColumns({"_n": F.col("_n") + F.coalesce("_far_before_n", F.lit(0)), "_sum": F.col("_sum") + F.coalesce("_far_before_cost", F.lit(0))})
    has_system = F.coalesce(F.col("_lead") == F.lit("system"), F.lit(False))
    m = m.withColumn("_has", has_system.cast("long")).withColumns({
        "_sys": has_system & (F.col("_n") == 1), "_sys_cost": F.when(has_system, F.col("_lead_cost")).otherwise(F.lit(0)),
        "_j": F.col("_n") - 1 - F.col("_has"), "_suffix": F.col("_all_cost") - F.col("_sum") + F.col("_cost")})
    floor = F.col("_sys_cost") + F.lit(TOKENS_PER_REPLY)
    fits = ~F.col("_sys") & (F.pmod(F.col("_j"), F.lit(2)) == 0) & (floor + F.col("_suffix") <= F.lit(budget))
    m = m.withColumn("_start", F.when(fits, F.struct(F.col("_j").alias("j"), F.col("_suffix").alias("rest"))))
    best = F.min("_start").over(inside)
    if around is not None:  # the smallest start of all slices, for the conversations that have several
        far = m.filter("_several").groupBy(conv).agg(F.min("_start").alias("best"))
        m = _beside(m.withColumn("_best", best), far, conv, [])
        best = F.when(F.col("_several"), F.col("_farbest")).otherwise(F.col("_best"))
    # every non-system message may go when their number is even
    n = F.col("_all_n") - F.col("_has")
    none = F.when((F.pmod(n, F.lit(2)) == 0) & (floor <= F.lit(budget)), F.struct(n.alias("j"), F.lit(0).cast("long").alias("rest")))
    m = m.withColumn("_start", F.coalesce(best, none))
    out = (m.withColumn("overflow", F.col("_start").isNull())
           .withColumn("kept", F.coalesce(F.col("_sys") | (F.col("_j") >= F.col("_start.j")), F.lit(False)) & F.col("_start").isNotNull())
           .withColumn("tokens_after", (floor + F.col("_start.rest")).cast("long")))
    return out.select(*columns, "kept", "overflow", "tokens_after")


def _beside(m: DataFrame, far: DataFrame, conv: str, on: list[str]) -> DataFrame:
    """``m`` with the columns of ``far``, which has a row per slice at most, as ``_far<name>``."""
    keys = [conv, *on]
    renamed = far.select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)),
                         *(F.col(c).alias(c if c == "_here" else f"_far{c}") for c in far.columns if c not in keys))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & m[c].eqNullSafe(renamed[f"_key_{i}"])
    return m.join(F.broadcast(renamed), same, "left").drop(*(f"_key_{i}" for i in range(len(keys))))


def keep_last_tokens(c, n: int, tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    """SC9: the last n tokens when the text has more (array<string>).

    With the model's context C and answer budget A, n = C - A. A budget of 0
    keeps nothing (the reference's ``[-0:]`` would keep everything)."""
    return keep_last(tokenizer(F.col(c) if isinstance(c, str) else c), n)


def fit_chat(prompts: DataFrame, limit: int | Column, reserve: int = 0,
             tokenizer: Tokenizer = whitespace_tokenizer) -> DataFrame:
    """RK4 inside a pipeline: fit every query's ``messages`` to ``limit``, a
    number or a column of the prompts.

    The messages are exploded (one conversation per query, bounded by the
    number of examples), fitted by ``fit_messages`` and gathered back in
    turn order. Adds ``overflow``; an overflowing query keeps no messages.
    """
    m = (prompts.select("query_id", F.lit(limit).alias("_limit"), F.posexplode("messages").alias("turn", "msg"))
         .select("query_id", "_limit", "turn", F.col("msg.role").alias("role"), F.col("msg.content").alias("text")))
    # one prompt's messages: at most 2 per example + 2, never a hot group
    fitted = fit_messages(m, F.col("_limit"), conv="query_id", reserve=reserve, tokenizer=tokenizer, bounded=True)
    kept = (fitted.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("turn", "role", "text")))).alias("_m"),
                 F.max("overflow").alias("overflow")))
    msgs = F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return (prompts.drop("messages").join(kept, "query_id", "left")
            .withColumn("messages", msgs).drop("_m"))
