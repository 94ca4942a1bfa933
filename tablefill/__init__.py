"""tablefill: subject suggestion for incomplete tables, as Spark jobs.

Layout: ``sources`` (readers and derived corpora), ``sinks`` (run writers),
``functions`` (column functions), ``operators`` (table, example, run and
evaluation operators), ``plans`` (prompt rendering, pipelines, registered
queries), ``streaming`` (micro-batch run logging).

The main entry points are re-exported here.
"""

__version__ = "0.1.0"

from .operators.evaluate import best_config, covered_queries, evaluate, leaderboard, summarize  # noqa: E402
from .operators.infer import complete, constant_model, embed, embed_hash, replay_model  # noqa: E402
from .operators.knn import knn_examples, knn_topk, order_examples  # noqa: E402
from .operators.runs import ensemble, ensemble_eligible, side_by_side, to_run  # noqa: E402
from .operators.sampling import sample_examples, sample_fixed, subsample  # noqa: E402
from .operators.tables import hold_out, qrels_from_split, split_seeds  # noqa: E402
from .plans.benchmark import ensemble_runs, run_benchmark, score_runs  # noqa: E402
from .plans.prompts import render, render_chat, render_instruct  # noqa: E402
from .plans.suggest import pick_examples, suggest, sweep  # noqa: E402
from .sources.corpus import read_tables  # noqa: E402
from .sources.trec import read_qrels, read_run_folders, read_run_meta, read_runs  # noqa: E402
from .sinks.trec import write_run  # noqa: E402

__all__ = [
    "best_config", "complete", "constant_model", "covered_queries", "embed", "embed_hash", "ensemble",
    "ensemble_eligible", "ensemble_runs", "evaluate", "hold_out", "knn_examples", "knn_topk", "leaderboard",
    "order_examples", "pick_examples", "qrels_from_split", "read_qrels", "read_run_folders", "read_run_meta",
    "read_runs", "read_tables", "render", "render_chat", "render_instruct", "replay_model", "run_benchmark",
    "sample_examples", "sample_fixed", "score_runs", "side_by_side", "split_seeds", "subsample", "suggest",
    "summarize", "sweep", "to_run", "write_run",
]
