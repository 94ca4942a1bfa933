"""CSV corpus reader (FIXTURES C), TREC round trip, run metadata."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tablefill.operators.runs import to_run
from tablefill.sinks.trec import write_run
from tablefill.sources.corpus import list_table_files, read_tables
from tablefill.sources.trec import list_runs, read_qrels, read_run_meta, read_runs


def _corpus(root):
    os.makedirs(f"{root}/a", exist_ok=True)
    os.makedirs(f"{root}/a-b", exist_ok=True)
    with open(f"{root}/a/t1.csv", "w", encoding="utf-8") as f:
        f.write('Name,Year,Name\n"O""Brien",1990,x\n"two\nlines",NA,y\n,null,Zoë\n')
    with open(f"{root}/a/t1_meta.json", "w") as f:
        json.dump({"queryId": "q1", "pgTitle": " P ", "secondTitle": "P", "caption": "Cap"}, f, indent=2)
    with open(f"{root}/a-b/t2.csv", "w") as f:
        f.write("Only\nv1\nv2\n")
    with open(f"{root}/a-b/t2_meta.json", "w") as f:
        json.dump({"queryId": "q2", "pgTitle": "", "secondTitle": " ", "caption": ""}, f)


def test_read_tables_golden(spark, scratch):
    _corpus(scratch)
    t = {r.table_id: r for r in read_tables(spark, scratch).collect()}
    t1 = t["t1"]
    assert t1.headers == ["Name", "Year", "Name.1"]
    assert t1.rows == [["O\"Brien", "1990", "x"], ["two\nlines", None, "y"], [None, None, "Zoë"]]
    assert t1.query_id == "q1" and t1.description == "P - Cap"
    assert t["t2"].headers == ["Only"] and t["t2"].rows == [["v1"], ["v2"]] and t["t2"].description == ""


def test_path_order_by_component(spark, scratch):
    _corpus(scratch)
    files = list_table_files(spark, scratch).orderBy("parts").collect()
    assert [os.path.basename(r.path) for r in files] == ["t1.csv", "t2.csv"]
    # plain string order would put 'a-b/' first ('-' < '/')
    assert sorted(r.path for r in files)[0].endswith("a-b/t2.csv")


def test_not_a_directory(spark, scratch):
    with pytest.raises(FileNotFoundError):
        list_table_files(spark, os.path.join(scratch, "missing"))


def test_run_round_trip_and_meta(spark, scratch):
    s = spark.createDataFrame([("q1", ["a b", "c#", "a b"]), ("q 2", [])], "query_id string, suggestions array<string>")
    run = to_run(s, run_id="2024-01-01_00-00-00", tag="trec")
    write_run(run, scratch, "2024-01-01_00-00-00", folder="data/benchmark", seeds=3, task={"k": 2})
    back = read_runs(spark, scratch).collect()
    assert sorted((r.run_id, r.query_id, r.doc_id, r.rank, r.score) for r in back) == sorted(
        (r.run_id, r.query_id, r.doc_id, r.rank, r.score) for r in run.collect())
    with pytest.raises(Exception):
        write_run(run, scratch, "2024-01-01_00-00-00", folder="data/benchmark", seeds=3)
    meta = read_run_meta(spark, scratch).collect()
    assert len(meta) == 1 and meta[0].completed and not meta[0].validation and meta[0].seeds == 3
    assert [r.run_id for r in list_runs(spark, scratch).collect()] == ["2024-01-01_00-00-00"]


def test_newline_in_doc_id_rejected(spark, scratch):
    run = spark.createDataFrame([("r", "q", "a\nb", 1, 1.0, "t")],
                                "run_id string, query_id string, doc_id string, rank int, score double, tag string")
    with pytest.raises(Exception):
        write_run(run, scratch, "r", folder="data/benchmark", seeds=1)


def test_read_qrels(spark, scratch):
    p = os.path.join(scratch, "seeds_1.qrel")
    with open(p, "w") as f:
        f.write('12\t0\t"quoted\t1\n12\t0\tx\t0\n')
    rows = read_qrels(spark, p).collect()
    assert [(r.query_id, r.doc_id, r.relevance) for r in rows] == [("12", '"quoted', 1), ("12", "x", 0)]


def test_read_run_folders_original_layout(spark, scratch):
    from tablefill.sources.trec import read_run_folders
    layout = {
        "2024-01-01_10-00-00": ("data/benchmark", 3, ["keep.flag"]),
        "2024-01-02_10-00-00": ("data/validation", 1, ["keep.flag", "debug.flag"]),
        "2024-01-03_10-00-00": ("data/benchmark", 2, []),
    }
    for run, (folder, seeds, flags) in layout.items():
        os.makedirs(os.path.join(scratch, run))
        with open(os.path.join(scratch, run, "benchmark.yaml"), "w") as f:
            f.write(f"class: SubjectSuggestionBenchmark\nfolder: {folder}\nmeta:\n  output_folder: data/output\n"
                    f"seeds: {seeds}\n")
        with open(os.path.join(scratch, run, "trec.log"), "w") as f:
            f.write("q1\tQ0\ta\t1\t1.0\ttrec\n")
        for flag in flags:
            open(os.path.join(scratch, run, flag), "w").close()
    os.makedirs(os.path.join(scratch, "no_run_here"))
    open(os.path.join(scratch, "no_run_here", "keep.flag"), "w").close()
    got = {r.run_id: (r.folder, r.seeds, r.completed, r.debug, r.validation)
           for r in read_run_folders(spark, scratch).collect()}
    assert got == {"2024-01-01_10-00-00": ("data/benchmark", 3, True, False, False),
                   "2024-01-02_10-00-00": ("data/validation", 1, True, True, True),
                   "2024-01-03_10-00-00": ("data/benchmark", 2, False, False, False)}
    runs = read_runs(spark, scratch).collect()
    assert {r.run_id for r in runs} == set(layout)


def test_write_completions(spark, scratch):
    from tablefill.sinks.trec import write_completions
    df = spark.createDataFrame([("q1", "p", "c", False, 0.5)],
                               "query_id string, prompt string, completion string, truncated boolean, seconds double")
    path = os.path.join(scratch, "completions")
    write_completions(df, path)
    assert spark.read.parquet(path).first().seconds == 0.5
    with pytest.raises(Exception):
        write_completions(df, path)


def test_listings_are_made_by_tasks(spark, scratch):
    """Empty files are seen, names beginning with _ or . are not, and nothing asks the JVM's file system."""
    from tablefill.sources.listing import list_folders
    for run in ("2024-02-01_00-00-00", "2024-02-02_00-00-00", "_run_meta", "empty"):
        os.makedirs(os.path.join(scratch, run))
    for run in ("2024-02-01_00-00-00", "2024-02-02_00-00-00", "_run_meta"):
        for name in ("trec.log", "keep.flag", "_SUCCESS"):
            open(os.path.join(scratch, run, name), "w").close()
    rows = sorted((r.folder, r.name, r.is_folder, r.bytes) for r in list_folders(spark, scratch).collect())
    assert rows == [(f"2024-02-0{i}_00-00-00", n, False, 0) for i in (1, 2) for n in ("keep.flag", "trec.log")]
    assert [r.run_id for r in list_runs(spark, scratch).collect()] == ["2024-02-01_00-00-00", "2024-02-02_00-00-00"]
    assert list_folders(spark, os.path.join(scratch, "missing")).count() == 0


def test_a_job_lost_between_rows_and_metadata(spark, scratch, monkeypatch):
    import tablefill.sinks.trec as sink
    s = spark.createDataFrame([("q1", ["a", "b"])], "query_id string, suggestions array<string>")
    run = to_run(s, run_id="r1", tag="trec")

    def lost(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(sink, "publish_meta", lost)
        with pytest.raises(RuntimeError):
            write_run(run, scratch, "r1", folder="data/benchmark", seeds=3)
    assert not sink.is_finished(spark, scratch, "r1")
    write_run(run, scratch, "r1", folder="data/benchmark", seeds=3)  # repeated
    write_run(to_run(s, run_id="r2", tag="trec"), scratch, "r2", folder="data/benchmark", seeds=3)
    with pytest.raises(FileExistsError):
        write_run(run, scratch, "r1", folder="data/benchmark", seeds=3)
    sink.publish_meta(spark, scratch, ("r1", "data/benchmark", 3, "{}", None, True, False))  # a second attempt of the last step
    assert sorted(r.run_id for r in read_run_meta(spark, scratch).collect()) == ["r1", "r2"]
    assert sorted((r.run_id, r.doc_id) for r in read_runs(spark, scratch).collect()) == [(r, d) for r in ("r1", "r2") for d in "ab"]


def test_baselines_of_all_seeds_in_one_scan(spark, scratch):
    from tablefill.sources.trec import read_baselines
    for name in ("BL3_coA_1.txt", "BL3_coA_3.txt", "BL3_coB13.txt", "BL3_coC_9.txt", "other_3.txt"):
        with open(os.path.join(scratch, name), "w") as f:
            f.write("q\tQ0\td\t1\t1.0\tx\n")
    df = read_baselines(spark, scratch, (1, 3, 13))
    got = sorted((r.run_id, r.seeds) for r in df.collect())
    assert got == [("BL3_coA_1", 1), ("BL3_coA_3", 3), ("BL3_coB13_s13", 13), ("BL3_coB13_s3", 3)]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_only_a_local_master_gets_a_scratch_folder():
    import pytest
    from tablefill.session import _scratch_dir
    assert _scratch_dir("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            _scratch_dir(master)
