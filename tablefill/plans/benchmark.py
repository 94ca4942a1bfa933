"""Folder-level workflows: what the reference's scripts do, as Spark jobs.

* ``run_benchmark``  — a corpus folder, a seed count and a pipeline ->
  one run folder (rows + metadata);
* ``score_runs``     — every run under a root, scored against the qrels of
  its (split, seeds), one leaderboard row per run;
* ``ensemble_runs``  — eligible members fused by votes and written as a run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import evaluate, leaderboard, summarize
from ..operators.infer import Factory
from ..operators.knn import knn_examples
from ..operators.runs import ensemble, ensemble_eligible, to_run
from ..operators.sampling import sample_examples, sample_fixed, subsample
from ..operators.tables import split_seeds
from ..session import dropping_pinned, materialize
from ..sinks.trec import write_completions, write_run
from ..sources.corpus import read_tables
from ..sources.trec import read_baselines, read_run_meta, read_runs
from .suggest import Transform, pick_examples, suggest


TUTORS = ("zero", "fixed", "random", "knn", "subsample", "pick")


def choose_examples(queries: DataFrame, tables: DataFrame, model: Factory, tutor: str, k: int | None, seed: int,
                    order: str, pool: int, tries: int, extractor: str, lead: str) -> DataFrame | None:
    """The examples of a tutor: ``subsample`` draws ``k`` of the ``pool``
    nearest tables, ``pick`` validates draws from ``pool`` random ones."""
    if tutor == "zero":
        return None
    if tutor == "fixed":
        return sample_fixed(queries, tables, k=k, seed=seed)
    if tutor == "random":
        return sample_examples(queries, tables, k=k, seed=seed)
    if tutor == "knn":
        return knn_examples(queries, tables, k, order=order, seed=seed)
    if tutor == "subsample":
        return subsample(knn_examples(queries, tables, pool, order="highest first"), k, seed=seed)
    if tutor == "pick":
        return pick_examples(queries, sample_examples(queries, tables, k=pool, seed=seed), tables, model,
                             amount=k, tries=tries, lead=lead, extractor=extractor)
    raise ValueError(f"Unknown tutor {tutor}")


def run_benchmark(spark: SparkSession, folder: str, seeds: int, model: Factory, out_root: str,
                  examples_folder: str | None = None, tutor: str = "zero", k: int | None = 0, seed: int = 42,
                  template: str | Callable = "instruct", extractor: str = "list", lead: str = '["',
                  run_id: str | None = None, debug: bool = False, chat_limit: int | None = None,
                  order: str = "lowest first", pool: int = 10, tries: int = 2, model_name: str | None = None,
                  pre: Transform | None = None, post: Transform | None = None) -> str:
    """Run every query of ``folder`` at ``seeds`` and write the run.

    ``tutor`` is one of TUTORS (``k`` examples; ``order`` for the nearest
    ones, ``pool`` and ``tries`` for those that choose from a pool);
    ``template='chat'`` with ``chat_limit`` fits the messages to the model's
    context, and ``template``, ``pre`` and ``post`` may be the user's own. The
    run id defaults to the start time (as the reference names its run
    folders). The run's metadata holds all settings and the fixed tutor's
    picks; completions with their seconds are written beside the rows.
    Returns the run id.
    """
    if tutor not in TUTORS:
        raise ValueError(f"Unknown tutor {tutor}")
    run_id = run_id or time.strftime("%Y-%m-%d_%H-%M-%S")
    with dropping_pinned(spark):
        # parsed once: the CSV parse is Python, so its readers cannot prune it
        queries = split_seeds(materialize(read_tables(spark, folder)), seeds)
        examples, tables = None, None
        if tutor != "zero":
            tables = materialize(read_tables(spark, examples_folder))
            examples = choose_examples(queries, tables, model, tutor, k, seed, order, pool, tries, extractor, lead)
        s = suggest(queries, examples, tables, model, template=template, extractor=extractor, lead=lead,
                    pre=pre, post=post, chat_limit=chat_limit)
        done = materialize(s.select("query_id", "completion", "truncated", "seconds", "suggestions"))
        task = {"tutor": tutor, "k": k, "seed": seed, "order": order, "extractor": extractor, "lead": lead,
                "template": template if isinstance(template, str) else getattr(template, "__name__", "own"),
                "chat_limit": chat_limit, "model": model_name or getattr(model, "__qualname__", type(model).__name__)}
        if tutor in ("subsample", "pick"):
            task |= {"pool": pool, "tries": tries}
        if tutor == "fixed":  # one sample for all queries: k rows
            task["sample"] = [r.table_id for r in examples.select("pos", "table_id").distinct().orderBy("pos").collect()]
        write_completions(done.select("query_id", "completion", "truncated", "seconds"), f"{out_root.rstrip('/')}/{run_id}/completions")
        write_run(to_run(done.select("query_id", "suggestions"), run_id=run_id, tag="trec"), out_root, run_id,
                  folder=folder, seeds=seeds, task=task, debug=debug)
    return run_id


def run_grid(spark: SparkSession, folders: Sequence[str], seeds: Sequence[int], pipelines: dict[str, dict],
             out_root: str) -> list[str]:
    """Every pipeline (a name and the settings of ``run_benchmark``) on every
    folder and number of seeds: one run each, named after all three."""
    return [run_benchmark(spark, folder, n, out_root=out_root, run_id=f"{name}_{folder.rstrip('/').rsplit('/', 1)[-1]}_s{n}", **settings)
            for folder in folders for n in seeds for name, settings in pipelines.items()]


def score_runs(spark: SparkSession, out_root: str, qrels: DataFrame, baselines: str | None = None,
               baseline_seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Score every completed run under ``out_root``.

    ``qrels`` carries ``split, seeds, query_id, doc_id, relevance`` (a qrels
    table written ``partitionBy("split", "seeds")``); each run meets the
    judgments of its own (split, seeds). ``baselines``, a
    folder of published outputs, adds one row per file and number of seeds."""
    meta = read_run_meta(spark, out_root).filter(F.col("completed"))
    runs = read_runs(spark, out_root).join(meta.select("run_id"), "run_id", "left_semi")
    if baselines is not None:
        rows = read_baselines(spark, baselines, baseline_seeds)  # one scan for all files
        runs = runs.unionByName(rows.select(*runs.columns))
        meta = meta.unionByName(rows.select("run_id", F.lit("data/benchmark").alias("folder"), "seeds").distinct().withColumns(
            {"completed": F.lit(True), "debug": F.lit(False), "validation": F.lit(False)}), allowMissingColumns=True)
    # queries are keyed by their (split, seeds), in runs and judgments alike: no
    # judgment is copied per run; both key tables have a row per run at most
    split = F.when(F.col("validation"), F.lit("validation")).otherwise(F.lit("benchmark")).alias("split")
    keys = meta.select("run_id", split, "seeds")
    key = F.concat_ws("\u0001", "split", F.col("seeds").cast("string"), "query_id")
    keyed_runs = runs.join(F.broadcast(keys), "run_id").withColumn("query_id", key)
    keyed_qrels = qrels.join(F.broadcast(keys.select("split", "seeds").distinct()), ["split", "seeds"]).withColumn("query_id", key)
    return leaderboard(summarize(evaluate(keyed_runs, keyed_qrels)), meta)


def ensemble_runs(spark: SparkSession, out_root: str, members: Sequence[str],
                  run_id: str = "ensemble") -> DataFrame:
    """Fuse the members that share the first member's benchmark; write the
    result as a run whose meta records the members. Returns the eligibility."""
    meta = read_run_meta(spark, out_root)
    order = spark.createDataFrame([(m, i) for i, m in enumerate(members)], "run_id string, run_pos int")
    elig = ensemble_eligible(meta, order)
    keep = elig.filter("eligible").select("run_id", "run_pos")
    fused = ensemble(read_runs(spark, out_root).join(keep.select("run_id"), "run_id", "left_semi"),
                     keep, run_id=run_id)
    first = meta.join(order.filter(F.col("run_pos") == 0), "run_id").first()
    kept = [r.run_id for r in keep.orderBy("run_pos").collect()]  # the member list (one row per run)
    write_run(fused, out_root, run_id, folder=first.folder, seeds=first.seeds, task={"ensemble": kept},
              members=kept)
    return elig
