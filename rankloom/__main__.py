"""python -m rankloom list | run NAME... --data FOLDER [--out FOLDER] | stage STAGE --data FOLDER [--out FOLDER]."""

from __future__ import annotations

import argparse

#: What a stage of a rebuild runs, in order; "all" runs every stage.
STAGES = {
    "data": ["scan_tsv_articles", "scan_tsv_behaviors", "scan_session_ids", "scan_engagement_history", "temporal_split_counts", "split_summary", "popularity_train"],
    "retrieve": ["query_build", "bm25_topk", "knn_exact_topk", "recall_at_k"],
    "rerank": ["feature_table_fused", "gbt_train_score", "ablation_incremental", "ablation_pair"],
    "evaluate": ["metrics_by_slice", "novelty", "coverage", "diversity", "bootstrap_ci", "paired_bootstrap"],
    "anti_gaming": ["position_removal"],
    "serving_scale": ["memory_report", "latency_percentiles", "cost_qps", "serving_request"],
    "submit": ["sink_rank_lines", "sink_zip"],
}


def main(args: list[str] | None = None) -> int:
    from rankloom.plans.catalog import QUERIES

    parser = argparse.ArgumentParser(prog="rankloom", description=__doc__)
    parser.add_argument("command", choices=["list", "run", "stage"])
    parser.add_argument("names", nargs="*")
    parser.add_argument("--data", help="folder of the tables")
    parser.add_argument("--out", help="folder to write results to, one Parquet table a query; without it 20 rows are shown")
    asked = parser.parse_args(args)
    if asked.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    names = asked.names
    if asked.command == "stage":
        names = [q for s in (list(STAGES) if names == ["all"] else names) for q in STAGES[s]]
    if unknown := [n for n in names if n not in QUERIES]:
        parser.error(f"no such query: {', '.join(unknown)}")
    if not names or not asked.data:
        parser.error("names and --data are needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rankloom").getOrCreate()
    for name in names:
        result = QUERIES[name](spark, asked.data)
        if asked.out:
            result.write.mode("overwrite").parquet(f"{asked.out}/{name}")
        else:
            print(name)
            result.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
