"""Pipelines: compose tutor -> proser -> predictor -> extractor as frames.

SURVEY SW1-SW3, SM4, PRJ8. A pipeline is a chain of ``DataFrame``
transformations over *all* queries at once; nothing loops over rows on the
driver. The sweep turns nested benchmark x pipeline loops into one job by
keying every query with its configuration.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keep_last_text
from ..operators.budget import fit_chat
from ..operators.extract import extractor as extractor_fn
from ..operators.infer import Factory, Replay, answer
from ..operators.knn import knn_examples
from ..operators.sampling import fixed_amount, no_examples, sample_examples, sample_fixed_each, subsample
from ..operators.tables import hold_out
from .prompts import render_chat, render_instruct

Transform = Callable[[DataFrame], DataFrame]


def suggest(queries: DataFrame, examples: DataFrame | None, tables: DataFrame | None, model: Factory | Replay,
            template: str | Callable = "instruct", extractor: str = "list", lead: str = '["',
            pre: Transform | None = None, post: Transform | None = None,
            batch_size: int = 64, chat_limit: int | None = None, reserve: int = 0,
            max_prompt_tokens: int | None = None) -> DataFrame:
    """SW3 + PRJ8: suggestions for every query.

    Returns ``query_id``, ``prompt`` (plus ``target`` / ``seeds`` when the
    queries carry them), ``completion``, ``truncated``, ``seconds`` and
    ``suggestions`` (array<string>).
    ``pre``/``post`` are the overridable hooks (identity by default).
    With ``template='chat'`` the model receives the messages as JSON; with
    ``chat_limit`` they are first fitted to the context (RK4), keeping
    ``reserve`` tokens for the answer. ``max_prompt_tokens`` (context minus
    the answer budget) keeps only the end of a longer instruction prompt,
    as a completion backend does before calling the model (SC9).
    ``template`` may be a function ``(queries, examples, tables) -> prompts``
    of the user's own (PR3); ``model`` may be recorded completions.
    """
    q = pre(queries) if pre else queries
    render = renderer(template)
    prompts = render(q, examples, tables)
    if "messages" in prompts.columns:
        if chat_limit is not None:
            prompts = fit_chat(prompts, chat_limit, reserve=reserve)
        prompts = prompts.withColumn("prompt", F.to_json("messages")).drop("messages")
    elif max_prompt_tokens is not None:
        prompts = prompts.withColumn("prompt", keep_last_text("prompt", max_prompt_tokens))
    # only what later steps read crosses into the model workers
    # (Catalyst cannot prune columns through a Python step)
    carried = ["query_id", "prompt"] + [c for c in ("target", "seeds") if c in prompts.columns]
    done = answer(prompts.select(*carried), model, examples, batch_size=batch_size)
    out = done.withColumn("suggestions", extractor_fn(extractor, lead)(F.col("completion")))
    return post(out) if post else out


def renderer(template: str | Callable) -> Callable:
    """The prompt template of a name, or a user's own function."""
    if callable(template):
        return template
    if template not in ("instruct", "chat"):
        raise ValueError(f"Unknown template {template}")
    return render_instruct if template == "instruct" else render_chat


def pick_examples(queries: DataFrame, pool: DataFrame, tables: DataFrame, model: Factory | Replay,
                  amount: int, tries: int, lead: str = '["', extractor: str = "list") -> DataFrame:
    """SM4: validated pick of few-shot examples.

    Round t (0..tries-1) draws ``amount`` of each still-unsolved query's pool
    (seeded by t), runs the inner pipeline on the hold-out query (PRJ4) and
    accepts the draw when the held-out value is among the suggestions.
    Queries never solved fall back to the first ``amount`` of their pool.
    Each round works only on the unsolved queries (left anti join); its
    accepted draws are written to the checkpoint dir, so the rounds'
    lineage stays flat and a recomputation after an executor loss cannot
    change a decision already taken. Returns ``query_id, pos, table_id, round``.
    """
    from ..session import materialize
    unsolved, pool = materialize(hold_out(queries)), materialize(pool)
    left = unsolved.count()
    accepted = []
    for t in range(tries):
        if not left:  # nothing to draw for: no job, no model call
            break
        draw = subsample(pool.join(unsolved.select("query_id"), "query_id", "left_semi"), amount, seed=t)
        s = suggest(unsolved, draw, tables, model, extractor=extractor, lead=lead)
        hit = s.filter(F.array_contains("suggestions", F.col("target"))).select("query_id")
        # pinned: the decision rests on model output, which may not repeat
        ok = materialize(draw.join(hit, "query_id", "left_semi").withColumn("round", F.lit(t)))
        accepted.append(ok)
        left -= ok.select("query_id").distinct().count()
        # derived from pinned tables only, so its lineage stays flat
        unsolved = unsolved.join(ok.select("query_id"), "query_id", "left_anti")
    fallback = (pool.join(unsolved.select("query_id"), "query_id", "left_semi")
                .filter(F.col("pos") <= amount)
                .select("query_id", "pos", "table_id", F.lit(-1).alias("round")))
    out = fallback
    for a in accepted:
        out = out.unionByName(a.select("query_id", "pos", "table_id", "round"))
    return out


# ------------------------------------------------------------------ sweep

TUTORS = ("zero", "fixed", "random", "knn", "subsample")
TEMPLATES = ("instruct", "chat")
EXTRACTORS = ("list", "csv_token", "first_line")
ORDERS = ("lowest first", "highest first", "random")
_CONFIG_COLUMNS = ("config_id", "tutor", "k", "seed", "seeds", "template", "lead", "extractor", "order", "pool", "context")
CONFIG_SCHEMA = ("config_id string, tutor string, k int, seed int, seeds int, template string, lead string, extractor string, "
                 "order string, pool int, context int")


def without_meta(value):
    """A config without its notes: ``meta`` entries are removed at any depth, in lists too."""
    if isinstance(value, dict):
        return {k: without_meta(v) for k, v in value.items() if k != "meta"}
    return [without_meta(v) for v in value] if isinstance(value, (list, tuple)) else value


def canonical(value) -> str:
    """One text for equal configs: no notes, keys in order."""
    return json.dumps(without_meta(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def configs_from_dicts(spark, dicts: Sequence[dict]) -> DataFrame:
    """SW2: configs as data. ``meta`` entries are notes and are dropped
    wherever they stand; nested blocks (``tutor: {class: ..., amount: ...}``,
    ``model: {context: ...}``) are flattened."""
    rows = []
    for d in map(without_meta, dicts):
        tutor = d.get("tutor", {})
        tutor = tutor if isinstance(tutor, dict) else {"class": tutor}
        kind, template, extractor = str(tutor.get("class", "zero")), str(d.get("template", "instruct")), str(d.get("extractor", "list"))
        order = str(tutor.get("order", "lowest first"))
        for what, value, known in (("tutor", kind, TUTORS), ("template", template, TEMPLATES), ("extractor", extractor, EXTRACTORS),
                                   ("order", order, ORDERS)):
            if value not in known:
                raise ValueError(f"Unknown {what} {value}")
        seed = 42 if tutor.get("seed") is None else int(tutor["seed"])
        amount = tutor.get("amount", None if kind == "fixed" else 0)
        if amount is None:  # a number fixed by the seed
            amount = fixed_amount(seed)
        model = d.get("model", {})
        context = model.get("context") if isinstance(model, dict) else None
        rows.append((str(d["config_id"]), kind, int(amount), seed, int(d.get("seeds", 1)), template,
                     str(d.get("lead", '["')), extractor, order, int(tutor.get("pool", 10)), None if context is None else int(context)))
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def config_examples(queries: DataFrame, example_tables: DataFrame, grid: Sequence) -> DataFrame:
    """Examples of queries that carry their configuration (``tutor``, ``k``,
    ``seed``, ``order``, ``pool``, and ``base_id``, the id without the
    configuration): one sampler of each kind, whatever the number of configurations.

    The nearest tables are searched once per table and number of seeds, for
    the largest k or pool; each configuration cuts and orders them by its own columns."""
    found = no_examples(queries).withColumn("seeds", F.lit(0))
    fixed = [(r.k, r.seed) for r in grid if r.tutor == "fixed"]
    if fixed:
        found = found.unionByName(sample_fixed_each(queries.filter("tutor = 'fixed'"), example_tables, fixed))
    random = [r.k for r in grid if r.tutor == "random"]
    if random:
        found = found.unionByName(sample_examples(queries.filter("tutor = 'random'"), example_tables, F.col("k"), F.col("seed"), most=max(random)))
    near = [r.k if r.tutor == "knn" else r.pool for r in grid if r.tutor in ("knn", "subsample")]
    if near:
        mine = queries.filter(F.col("tutor").isin("knn", "subsample"))
        key = F.concat_ws("/", F.col("seeds").cast("string"), "base_id")
        asked = mine.withColumn("query_id", key).select("query_id", "seed_values").dropDuplicates(["query_id"])
        nearest = knn_examples(asked, example_tables, max(near), order="highest first").select(
            F.col("query_id").alias("_near"), F.col("pos").alias("_rank"), "table_id")
        pairs = (mine.select("query_id", "seeds", "tutor", "k", "seed", "order", "pool", key.alias("_near")).join(nearest, "_near")
                 .filter(F.col("_rank") <= F.when(F.col("tutor") == "knn", F.col("k")).otherwise(F.col("pool"))))
        drawn = F.md5(F.concat_ws("|", F.col("seed").cast("string"), "query_id", "table_id"))
        by_draw = (F.col("tutor") == "subsample") | (F.col("order") == "random")
        place = F.when(by_draw, F.lit(0)).when(F.col("order") == "lowest first", -F.col("_rank")).otherwise(F.col("_rank"))
        order = Window.partitionBy("query_id").orderBy(place, F.when(by_draw, drawn).otherwise(F.lit("")), "table_id")
        size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        enough = F.when((F.col("tutor") == "knn") | (size >= F.col("k")), F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit("Sample larger than population or is negative (k="), F.col("k").cast("string"), F.lit(", n="), size.cast("string"),
            F.lit(")"))).cast("boolean"))
        chosen = pairs.withColumn("pos", F.row_number().over(order)).withColumn("_enough", enough).filter("pos <= k AND _enough")
        found = found.unionByName(chosen.select("query_id", "pos", "table_id", "seeds"))
    return found


def sweep(tables: DataFrame, configs: DataFrame, example_tables: DataFrame, model: Factory | Replay,
          chat_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SW1: every query under every configuration in one job.

    Tables are split once per distinct number of seeds and pinned; each
    (config, query) becomes one keyed query ``<config_id>/<query_id>`` that carries the
    configuration's columns: sampler, k, seed, order, pool, template, lead,
    extractor and context size. One sampler of each kind and one render of each template
    serve all configurations. A chat is fitted to its configuration's
    ``context`` (default: ``chat_limit``; null: not at all). Judgments depend on
    the number of seeds alone. Returns (runs, qrels) keyed alike, ready for
    ``evaluate``; ``run_id`` is the config id.
    """
    from ..functions.listparse import extract_list
    from ..operators.extract import extract_csv_token, extract_first_line
    from ..operators.runs import to_run
    from ..operators.tables import qrels_from_split, split_seeds
    from ..session import materialize

    spark = tables.sparkSession
    for name, default in (("order", F.lit("lowest first")), ("pool", F.lit(10)), ("context", F.lit(None).cast("int"))):
        if name not in configs.columns:
            configs = configs.withColumn(name, default)
    grid = configs.collect()  # one row per configuration
    unknown = ([r.tutor for r in grid if r.tutor not in TUTORS] + [r.template for r in grid if r.template not in TEMPLATES]
               + [r.extractor for r in grid if r.extractor not in EXTRACTORS] + [r.order for r in grid if r.order not in ORDERS])
    if unknown:
        raise ValueError(f"Unknown setting {unknown[0]}")
    counts = spark.createDataFrame([(n,) for n in sorted({r.seeds for r in grid})], "n int")
    split = materialize(split_seeds(tables.crossJoin(F.broadcast(counts)), F.col("n")).drop("n"))
    example_tables = materialize(example_tables)
    settings = F.broadcast(spark.createDataFrame([tuple(r[c] for c in _CONFIG_COLUMNS) for r in grid], CONFIG_SCHEMA))

    def keyed(frame: DataFrame) -> DataFrame:
        return (frame.withColumnRenamed("query_id", "base_id").join(settings, "seeds")
                .withColumn("query_id", F.concat_ws("/", "config_id", "base_id")))

    queries = keyed(split)
    examples = None
    if any(r.tutor != "zero" for r in grid):  # written once: both templates and recorded answers read it
        examples = materialize(config_examples(queries, example_tables, grid))
    prompts = []
    for template in sorted({r.template for r in grid}):
        ids = [r.config_id for r in grid if r.template == template]
        mine = None if examples is None else examples.filter(F.substring_index("query_id", "/", 1).isin(ids))
        made = renderer(template)(queries.filter(F.col("template") == template), mine, example_tables)
        if "messages" in made.columns:
            made = fit_chat(made, F.coalesce("context", F.lit(chat_limit).cast("int"), F.lit(1 << 30)))
            made = made.withColumn("prompt", F.to_json("messages"))
        prompts.append(made.select("query_id", "prompt"))
    done = answer(reduce(DataFrame.unionByName, prompts), model, examples).select("query_id", "completion")
    settings = spark.createDataFrame([(r.config_id, r.extractor, r.lead) for r in grid],
                                     "run_id string, extractor string, lead string")
    done = (done.withColumn("run_id", F.substring_index("query_id", "/", 1))
            .join(F.broadcast(settings), "run_id"))  # one row per configuration
    suggestions = done.withColumn(
        "suggestions",
        F.when(F.col("extractor") == "list", extract_list(F.concat("lead", "completion")))
        .when(F.col("extractor") == "csv_token", extract_csv_token("completion"))
        .otherwise(extract_first_line("completion")))
    runs = to_run(suggestions, tag="sweep")
    judged = qrels_from_split(split.withColumn("query_id", F.concat_ws("/", F.col("seeds").cast("string"), "query_id")))
    judged = (judged.withColumn("seeds", F.substring_index("query_id", "/", 1).cast("int"))
              .withColumn("query_id", F.expr("substring(query_id, instr(query_id, '/') + 1)")))
    columns = [c for c in judged.columns if c not in ("query_id", "seeds")]
    names = F.broadcast(spark.createDataFrame([(r.config_id, r.seeds) for r in grid], "config_id string, seeds int"))
    return runs, judged.join(names, "seeds").select(F.concat_ws("/", "config_id", "query_id").alias("query_id"), *columns)
