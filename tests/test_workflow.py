"""Folder workflows end to end: corpus -> runs -> scores -> ensemble."""

import pytest
import json
import os

from pyspark.sql import functions as F

from sequence_model import SequenceModel
from tablefill.operators.infer import replay_model
from tablefill.operators.tables import qrels_from_split, split_seeds
from conftest import SF001
from tablefill.plans.suggest import configs_from_dicts, suggest, sweep
from tablefill.sources import derived
from tablefill.plans.benchmark import ensemble_runs, run_benchmark, score_runs
from tablefill.sources.corpus import read_tables
from tablefill.sources.trec import baseline_files, qrels_for, read_run_meta, read_runs


def _write_corpus(root):
    os.makedirs(root, exist_ok=True)
    for t in range(4):
        with open(f"{root}/t{t}.csv", "w") as f:
            f.write("Name,Id\n" + "".join(f"Item#{t * 10 + i:04d},{i}\n" for i in range(0, 12, 1 + t % 2)))
        with open(f"{root}/t{t}_meta.json", "w") as f:
            json.dump({"queryId": f"q{t}", "pgTitle": f"Table {t}", "secondTitle": "", "caption": "x"}, f)


def test_benchmark_score_ensemble(spark, scratch):
    corpus = os.path.join(scratch, "data", "benchmark")
    _write_corpus(corpus)
    out = os.path.join(scratch, "output")
    model = SequenceModel(n=5, max_chars=1000)
    r1 = run_benchmark(spark, corpus, 1, model, out, run_id="run_s1")
    r2 = run_benchmark(spark, corpus, 2, model, out, run_id="run_s2")
    r3 = run_benchmark(spark, corpus, 1, model, out, run_id="run_s1_b", extractor="first_line")
    # the other tutors and the chat path run through the same workflow
    r4 = run_benchmark(spark, corpus, 1, model, out, run_id="run_knn", examples_folder=corpus, tutor="knn", k=2,
                       template="chat", lead="", chat_limit=120)
    tables = read_tables(spark, corpus)
    qrels = None
    for n in (1, 2):
        q = qrels_from_split(split_seeds(tables, n)).withColumn("split", F.lit("benchmark")).withColumn("seeds", F.lit(n))
        qrels = q if qrels is None else qrels.unionByName(q)
    qpath = os.path.join(scratch, "qrels")
    qrels.write.partitionBy("split", "seeds").parquet(qpath)
    board = {r.run_id: r for r in score_runs(spark, out, spark.read.parquet(qpath)).collect()}
    assert set(board) == {r1, r2, r3, r4}
    assert board["run_knn"].success_1 == board["run_s1"].success_1
    # the sequence model counts on from the last seed: item ids step by 1 or 2
    assert board["run_s1"].success_1 == 0.5 and board["run_s1"].queries == 4
    assert board["run_s1_b"].success_1 == 0.0
    assert board["run_s1"].report.startswith("name=             run_s1, seeds=1, queries=   4, success_1=50.0%")
    elig = {r.run_id: r.eligible for r in ensemble_runs(spark, out, [r1, r2, r3], run_id="ens").collect()}
    assert elig == {r1: True, r2: False, r3: True}
    ens = read_runs(spark, out).filter(F.col("run_id") == "ens")
    assert ens.count() > 0
    meta = {r.run_id: r for r in read_run_meta(spark, out).collect()}
    assert json.loads(meta["ens"].members) == [r1, r3]


def test_samplers_records_and_baselines_of_runs(spark, scratch):
    from tablefill.plans.benchmark import run_grid
    corpus = os.path.join(scratch, "data", "benchmark")
    _write_corpus(corpus)
    out = os.path.join(scratch, "output")
    model = SequenceModel(n=5, max_chars=1000)
    made = run_grid(spark, [corpus], [2, 3], {
        "fixed": {"model": model, "examples_folder": corpus, "tutor": "fixed", "k": 2, "seed": 3},
        "sub": {"model": model, "examples_folder": corpus, "tutor": "subsample", "k": 2, "pool": 3}}, out)
    made.append(run_benchmark(spark, corpus, 3, model, out, run_id="picked", examples_folder=corpus, tutor="pick", k=1, pool=3,
                              model_name="counter"))
    assert made == ["fixed_benchmark_s2", "sub_benchmark_s2", "fixed_benchmark_s3", "sub_benchmark_s3", "picked"]
    meta = {r.run_id: json.loads(r.task) for r in read_run_meta(spark, out).collect()}
    assert len(meta["fixed_benchmark_s2"]["sample"]) == 2 and meta["picked"]["tries"] == 2 and meta["picked"]["model"] == "counter"
    completions = spark.read.parquet(f"{out}/picked/completions")
    assert completions.count() == 4 and completions.filter("seconds < 0 OR truncated").count() == 0
    with pytest.raises(ValueError):
        run_benchmark(spark, corpus, 1, model, out, tutor="nearest")
    base = os.path.join(scratch, "baselines")
    os.makedirs(base)
    q = qrels_from_split(split_seeds(read_tables(spark, corpus), 3))
    best = sorted({(r.query_id, r.doc_id) for r in q.collect()})
    with open(f"{base}/BL3_coX_3.txt", "w") as f:
        f.writelines(f"{a}\tQ0\t{d}\t{i + 1}\t{-i}\tbl\n" for i, (a, d) in enumerate(best))
    qrels = q.selectExpr("'benchmark' AS split", "3 AS seeds", *q.columns)
    board = {r.run_id: r for r in score_runs(spark, out, qrels, baselines=base, baseline_seeds=(3,)).collect()}
    assert set(board) == {"fixed_benchmark_s3", "sub_benchmark_s3", "picked", "BL3_coX_3"}
    assert board["BL3_coX_3"].success_1 == 1.0 and board["BL3_coX_3"].queries == 4


def test_pinned_tables_go_with_their_job(spark):
    from tablefill.session import dropping_pinned, materialize
    with dropping_pinned(spark):
        path = materialize(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_a_table_without_its_meta_file_is_an_error(spark, scratch):
    corpus = os.path.join(scratch, "data", "benchmark")
    _write_corpus(corpus)
    os.remove(f"{corpus}/t1_meta.json")
    with pytest.raises(Exception, match="t1.csv"):
        read_tables(spark, corpus).collect()


def test_qrels_for_prunes_by_split_and_seeds(spark, scratch):
    q = spark.createDataFrame([("benchmark", 1, "a", "d1", 1), ("benchmark", 3, "a", "d3", 1),
                               ("validation", 3, "a", "v3", 1)],
                              "split string, seeds int, query_id string, doc_id string, relevance int")
    path = os.path.join(scratch, "qrels")
    q.write.partitionBy("split", "seeds").parquet(path)
    meta = spark.createDataFrame([("r", "data/validation", 3, True)], "run_id string, folder string, seeds int, validation boolean")
    j = qrels_for(meta, spark.read.parquet(path))
    assert [(r.run_id, r.doc_id) for r in j.collect()] == [("r", "v3")]
    assert "PartitionFilters" in j._jdf.queryExecution().executedPlan().toString()


def test_baseline_files_largest_first(spark, scratch):
    for name, n in (("BL3_coA_3.txt", 10), ("BL3_coB_3.txt", 50), ("BL3_coC_2.txt", 99)):
        with open(os.path.join(scratch, name), "w") as f:
            f.write("q\tQ0\td\t1\t1.0\tx\n" * n)
    got = [os.path.basename(r.path) for r in baseline_files(spark, scratch, 3).orderBy("size_rank").collect()]
    assert got == ["BL3_coB_3.txt", "BL3_coA_3.txt"]
    runs = read_runs(spark, scratch, pattern="BL3_co*3.txt", kind="baseline")
    assert {r.run_id for r in runs.collect()} == {"BL3_coA_3", "BL3_coB_3"}


def test_replay_model(spark):
    p = spark.createDataFrame([("c", "q1", "p1"), ("c", "q2", "p2")], "config_id string, query_id string, prompt string")
    rec = spark.createDataFrame([("c", "q1", "answer")], "config_id string, query_id string, completion string")
    got = {r.query_id: r.completion for r in replay_model(p, rec).collect()}
    assert got == {"q1": "answer", "q2": None}


def test_configs_from_dicts_drops_meta(spark):
    from tablefill.plans.suggest import configs_from_dicts
    rows = configs_from_dicts(spark, [
        {"config_id": "a", "seeds": 3, "extractor": "list", "meta": {"note": "x"},
         "tutor": {"class": "fixed", "amount": 2, "seed": 7, "meta": {"sample": ["t1"]}}},
        {"config_id": "b", "tutor": "zero"},
    ]).collect()
    got = {r.config_id: (r.tutor, r.k, r.seed, r.seeds, r.extractor, r.lead) for r in rows}
    assert got == {"a": ("fixed", 2, 7, 3, "list", '["'), "b": ("zero", 0, 42, 1, "list", '["')}


def test_sweep_with_knn_and_random_tutors(spark):
    from conftest import SF001
    from tablefill.operators.evaluate import evaluate, summarize
    from tablefill.plans.suggest import configs_from_dicts, sweep
    from tablefill.sources import derived
    configs = configs_from_dicts(spark, [
        {"config_id": "k2", "seeds": 2, "tutor": {"class": "knn", "amount": 2, "seed": 1}},
        {"config_id": "r1", "seeds": 2, "tutor": {"class": "random", "amount": 1, "seed": 1}},
    ])
    runs, qrels = sweep(derived.customer_tables(spark, SF001), configs, derived.part_tables(spark, SF001),
                        SequenceModel(n=5, max_chars=1000))
    got = {(r.run_id, r.metric): r.score for r in summarize(evaluate(runs, qrels)).collect()}
    assert {k[0] for k in got} == {"k2", "r1"}
    # the model ignores the examples: both tutors score alike
    assert all(got[("k2", m)] == got[("r1", m)] for m in ("success_1", "success_5", "P_5"))


def test_config_values_are_kept(spark):
    from tablefill.operators.sampling import fixed_amount
    from tablefill.plans.suggest import configs_from_dicts
    rows = configs_from_dicts(spark, [
        {"config_id": "a", "tutor": {"class": "fixed", "seed": 0, "amount": None}, "template": "chat"},
        {"config_id": "b", "tutor": {"class": "knn", "seed": 3, "amount": 2, "meta": "note"}, "lead": ""}]).collect()
    assert [(r.seed, r.k, r.template, r.lead) for r in rows] == [(0, fixed_amount(0), "chat", '["'), (3, 2, "instruct", "")]
    for bad in ({"tutor": {"class": "nearest"}}, {"template": "poem"}, {"extractor": "xml"}):
        with pytest.raises(ValueError):
            configs_from_dicts(spark, [{"config_id": "x", **bad}])


def test_sweep_and_pick_see_the_examples(spark):
    """Replayed answers depend on the chosen examples, so the samplers differ and
    the validated pick accepts in different rounds."""
    from conftest import SF01
    from tablefill.plans.catalog import REGISTRY
    scores = {}
    for r in REGISTRY["sweep_grid"](spark, SF01).collect():
        tutor, rest = r.config_id.split("_", 1)
        scores.setdefault(rest, {}).setdefault(tutor, []).append((r.metric, r.score))
    assert any(len({tuple(sorted(v)) for v in by.values()}) == 3 for by in scores.values())
    rounds = {r.round for r in REGISTRY["pick_first_hit"](spark, SF01).select("round").distinct().collect()}
    assert rounds == {0, 1, -1}


def test_user_template_and_hooks(spark):
    from pyspark.sql import functions as F
    q = spark.createDataFrame([("q1", ["a"]), ("q2", ["b"])], "query_id string, seed_values array<string>")
    s = suggest(q, None, None, lambda: (lambda prompts: [p.upper() for p in prompts]), extractor="first_line",
                template=lambda queries, examples, tables: queries.select("query_id", F.concat_ws(",", "seed_values").alias("prompt")),
                pre=lambda d: d.filter("query_id = 'q1'"), post=lambda d: d.withColumn("seen", F.lit(True)))
    assert [(r.query_id, r.suggestions, r.seen) for r in s.collect()] == [("q1", ["A"], True)]
    with pytest.raises(ValueError):
        suggest(q, None, None, lambda: None, template="poem")


def test_sweep_settings_are_columns(spark):
    """Order, pool sampler, context size per configuration: each equals its own pipeline run alone."""
    from tablefill.operators.knn import knn_examples
    from tablefill.operators.sampling import subsample
    from tablefill.plans import suggest as plans
    base = {"seeds": 3, "extractor": "list"}
    dicts = [dict(base, config_id=c, tutor=t, **more) for c, t, more in (
        ("near", {"class": "knn", "amount": 2, "seed": 5}, {}),
        ("far", {"class": "knn", "amount": 3, "order": "highest first"}, {}),
        ("mixed", {"class": "knn", "amount": 3, "order": "random", "seed": 9}, {}),
        ("pool", {"class": "subsample", "amount": 2, "pool": 4, "seed": 3}, {}),
        ("short", {"class": "fixed", "amount": 2, "seed": 7}, {"template": "chat", "model": {"context": 60, "meta": "note"}}),
        ("long", {"class": "fixed", "amount": 2, "seed": 7}, {"template": "chat", "model": {"context": 4000}}))]
    configs = configs_from_dicts(spark, dicts)
    tables, parts = derived.customer_tables(spark, SF001), derived.part_tables(spark, SF001)
    seen = {}
    real = plans.answer
    try:
        def answer(prompts, model, examples, **more):
            for r in prompts.collect():
                seen[r.query_id] = r.prompt
            return real(prompts, model, examples, **more)
        plans.answer = answer
        plans.sweep(tables, configs, parts, SequenceModel(n=3, max_chars=500))
    finally:
        plans.answer = real
    q = split_seeds(tables, 3)
    for name, k, order, seed in (("near", 2, "lowest first", 5), ("far", 3, "highest first", 42), ("mixed", 3, "random", 9)):
        mine = q.withColumn("query_id", F.concat(F.lit(f"{name}/"), "query_id"))
        want = plans.renderer("instruct")(mine, knn_examples(mine, parts, k, order=order, seed=seed), parts)
        assert {r.query_id: r.prompt for r in want.collect()} == {i: p for i, p in seen.items() if i.startswith(f"{name}/")}
    mine = q.withColumn("query_id", F.concat(F.lit("pool/"), "query_id"))
    want = plans.renderer("instruct")(mine, subsample(knn_examples(mine, parts, 4, order="highest first"), 2, seed=3), parts)
    assert {r.query_id: r.prompt for r in want.collect()} == {i: p for i, p in seen.items() if i.startswith("pool/")}
    sizes = {c: {len(json.loads(p)) for i, p in seen.items() if i.startswith(f"{c}/")} for c in ("short", "long")}
    assert sizes["long"] == {6} and max(sizes["short"]) < 6


def test_sweep_plan_does_not_grow_with_the_configurations(spark):
    tables, parts = derived.customer_tables(spark, SF001), derived.part_tables(spark, SF001)

    def exchanges(n):
        configs = configs_from_dicts(spark, [
            {"config_id": f"c{i}", "seeds": 1 + i % 3, "tutor": {"class": ("zero", "fixed", "random")[i % 3], "amount": 0 if i % 3 == 0 else 2, "seed": i}}
            for i in range(n)])
        runs, _ = sweep(tables, configs, parts, SequenceModel(n=3, max_chars=500))
        return runs._jdf.queryExecution().executedPlan().toString().count("Exchange hash")

    assert exchanges(3) == exchanges(12) <= 12


def test_notes_make_no_difference():
    from tablefill.plans.suggest import canonical, without_meta
    a = {"b": [{"class": "X", "meta": {"why": 1}, "k": [1, {"meta": 2, "z": None}]}], "a": 1.5, "meta": "note"}
    b = {"a": 1.5, "b": [{"k": [1, {"z": None}], "class": "X"}]}
    assert canonical(a) == canonical(b) and without_meta(a) == b
    assert canonical({"a": 1}) != canonical({"a": 2})
