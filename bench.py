"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loomspan.plans.catalog import QUERIES
from loomspan.plans.construction import graph
from loomspan.session import local_session

HEADLINE = (
    "chain_optional_distinct", "five_pattern_chain", "path_closure_count", "union_then_optional", "filter_decimal_bind", "construct_rows",
    "deadline_durations", "article_mentions", "content_items", "merged_layers", "deleted_nodes", "property_completeness", "interlinking",
    "connectivity_summary", "clustering_coefficients", "page_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # the session is up before the clock starts

    def timed(run) -> float:
        began = time.time()
        run()
        return round(time.time() - began, 3)

    saved = lambda name: lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {name: timed(saved(name)) for name in HEADLINE}
    # the twenty questions ask one graph, which is built first; their times stand beside the headline's
    questions = {"graph": timed(lambda: graph(spark, sf_dir))} | {name: timed(saved(name)) for name in QUERIES if name.startswith(("cq", "llm"))}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "questions": questions, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
