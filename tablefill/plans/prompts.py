"""Prompt rendering.

Inputs:
* ``queries``: ``query_id, seeds, description, headers, rows`` (rows already
  cut to the seeds — see ``split_seeds``);
* ``examples``: ``query_id, pos, table_id`` (any sampler's output);
* ``tables``: the example corpus, ``table_id, description, headers, rows``.

Examples are always split at the *query's* N. The per-query example blocks
are built by joining examples to the corpus, then gathered with one
``collect_list`` per query — a group bounded by the number of examples k.
A left join keeps zero-shot queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonlist import json_list
from ..functions.text import json_list_ascii, xml_escape
from ..operators.tables import rest_after, subject


# The text of both prompt templates, in template order.
INSTRUCTION = ("Your mission, as a sequence detective, is to fill in the gaps of the provided partial "
               "data column by identifying the next elements in the sequence. Deliver your solution as "
               "a JSON list, ensuring the values are in their logical sequence.")
INST_OPEN = "[INST] "
DESCRIPTION_LABEL = "Table description:\n"
HEADERS_LABEL = "\nAll table headers:\n"
SUBJECT_LABEL = "\nHeader of column to expand:\n"
COLUMN_LABEL = "\nColumn:\n"
INST_CLOSE = " [/INST]\n"
LEAD = '["'
MESSAGES_OPEN = "<messages>\n"
SYSTEM_OPEN, SYSTEM_CLOSE = "<system>", "</system>\n"
USER_OPEN, USER_CLOSE = "<user>", "</user>\n"
ASSISTANT_OPEN, ASSISTANT_CLOSE = "<assistant>", "</assistant>\n"
MESSAGES_CLOSE = "</messages>"


def _json(ascii_only: bool) -> Callable[[Column], Column]:
    return json_list_ascii if ascii_only else json_list


def _example_parts(queries: DataFrame, examples: DataFrame, tables: DataFrame,
                   ascii_only: bool) -> DataFrame:
    """Rendered pieces of every (query, example) pair.

    An example's pieces depend only on (table, query's N), so they are
    rendered once per distinct pair and joined back: a sample shared by
    all queries is rendered k times, not Q x k, and its hot table ids
    meet a small, deduplicated side (broadcast at run time by AQE).
    """
    js = _json(ascii_only)
    if "seeds" in examples.columns:  # carried by the samplers
        pairs = examples.select("query_id", "pos", "table_id", F.col("seeds").alias("q_seeds"))
    else:
        pairs = (examples.select("query_id", "pos", "table_id")
                 .join(queries.select("query_id", F.col("seeds").alias("q_seeds")), "query_id"))
    needed = pairs.select("table_id", "q_seeds").distinct()
    body = tables.select("table_id", F.col("description").alias("e_desc"),
                         F.col("headers").alias("e_headers"), F.col("rows").alias("e_rows"))
    subj = subject("e_rows")
    parts = needed.join(body, "table_id").select(
        "table_id", "q_seeds", "e_desc",
        js(F.col("e_headers")).alias("e_headers_json"),
        F.col("e_headers")[0].alias("e_header0"),
        js(F.slice(subj, 1, F.col("q_seeds"))).alias("e_seed_json"),
        js(rest_after(subj, F.col("q_seeds"))).alias("e_rest_json"))
    return pairs.join(parts, ["table_id", "q_seeds"]).select(
        "query_id", "pos", "e_desc", "e_headers_json", "e_header0", "e_seed_json", "e_rest_json")


def _gather(blocks: DataFrame, col: str, out: str) -> DataFrame:
    """Concatenate one text per example in ``pos`` order, per query."""
    return (blocks.groupBy("query_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", col))),
                                          lambda x: x[col]), "").alias(out)))


def render_instruct(queries: DataFrame, examples: DataFrame | None, tables: DataFrame | None,
                    ascii_only: bool = False) -> DataFrame:
    """PR1: the instruction prompt; adds ``prompt``. Ends with the lead ``["``."""
    js = _json(ascii_only)
    head = F.lit(INST_OPEN + INSTRUCTION + "\n\n" + DESCRIPTION_LABEL)

    def block(desc, headers_json, header0, col_json, tail):
        return F.concat(head, desc, F.lit(HEADERS_LABEL), headers_json,
                        F.lit(SUBJECT_LABEL), header0, F.lit(COLUMN_LABEL),
                        col_json, F.lit(INST_CLOSE), tail)

    q_block = block(F.col("description"), js(F.col("headers")), F.col("headers")[0],
                    js(subject("rows")), F.lit(LEAD))
    if examples is None:
        return queries.withColumn("prompt", q_block)
    parts = _example_parts(queries, examples, tables, ascii_only)
    ex_blocks = parts.select("query_id", "pos", block(
        F.col("e_desc"), F.col("e_headers_json"), F.col("e_header0"), F.col("e_seed_json"),
        F.concat(F.col("e_rest_json"), F.lit("\n"))).alias("block"))
    gathered = _gather(ex_blocks, "block", "_examples_text")
    return (queries.join(gathered, "query_id", "left")
            .withColumn("prompt", F.concat(F.coalesce("_examples_text", F.lit("")), q_block))
            .drop("_examples_text"))


def _user_text(desc, headers_json, header0, col_json, twice: bool) -> Column:
    first = DESCRIPTION_LABEL * (2 if twice else 1)
    return F.concat(F.lit(first), desc, F.lit(HEADERS_LABEL), headers_json,
                    F.lit(SUBJECT_LABEL), header0, F.lit(COLUMN_LABEL), col_json)


def render_chat(queries: DataFrame, examples: DataFrame | None, tables: DataFrame | None,
                ascii_only: bool = False) -> DataFrame:
    """PR2: the chat prompt as XML text (``prompt``) and as
    ``messages ARRAY<STRUCT<role, content>>`` (unescaped), built side by side.

    Kept quirks: example user turns say "Table description:" twice, a blank
    line precedes the final user turn, no trailing newline, no lead.
    """
    js = _json(ascii_only)
    q_user = _user_text(F.col("description"), js(F.col("headers")), F.col("headers")[0],
                        js(subject("rows")), twice=False)
    system = F.struct(F.lit("system").alias("role"), F.lit(INSTRUCTION).alias("content"))
    head = F.lit(MESSAGES_OPEN + SYSTEM_OPEN + INSTRUCTION + SYSTEM_CLOSE)
    q_xml = F.concat(F.lit("\n" + USER_OPEN), xml_escape(q_user), F.lit(USER_CLOSE + MESSAGES_CLOSE))
    q_msg = F.struct(F.lit("user").alias("role"), q_user.alias("content"))
    if examples is None:
        return (queries.withColumn("prompt", F.concat(head, q_xml))
                .withColumn("messages", F.array(system, q_msg)))
    parts = _example_parts(queries, examples, tables, ascii_only)
    user = _user_text(F.col("e_desc"), F.col("e_headers_json"), F.col("e_header0"), F.col("e_seed_json"),
                      twice=True)
    ex = parts.select(
        "query_id", "pos",
        F.concat(F.lit(USER_OPEN), xml_escape(user), F.lit(USER_CLOSE + ASSISTANT_OPEN),
                 xml_escape(F.col("e_rest_json")), F.lit(ASSISTANT_CLOSE)).alias("xml"),
        F.array(F.struct(F.lit("user").alias("role"), user.alias("content")),
                F.struct(F.lit("assistant").alias("role"), F.col("e_rest_json").alias("content"))).alias("pair"))
    gathered = (ex.groupBy("query_id")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "xml", "pair"))).alias("_ex")))
    empty_msgs = F.array().cast("array<struct<role:string,content:string>>")
    return (queries.join(gathered, "query_id", "left")
            .withColumn("prompt", F.concat(head, F.coalesce(F.array_join(F.transform("_ex", lambda x: x["xml"]), ""),
                                                            F.lit("")), q_xml))
            .withColumn("messages", F.concat(F.array(system),
                                             F.coalesce(F.flatten(F.transform("_ex", lambda x: x["pair"])),
                                                        empty_msgs),
                                             F.array(q_msg)))
            .drop("_ex"))


def render(queries: DataFrame, fn: Callable[[DataFrame], Column], name: str = "prompt") -> DataFrame:
    """PR3: a user's own template — any Column expression over the query
    frame (e.g. with extra literal variables), or a pandas UDF."""
    return queries.withColumn(name, fn(queries))
