"""Headline jobs over the whole tables of $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    from pyspark.sql import SparkSession

    import veilspan as v
    from checks.fixtures import documents, prompts
    from veilspan.operators.tables import cut_lineage
    from veilspan.operators.vault import vault_entries

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("veilspan-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = documents(spark, SF_DIR, ("doc_id", "source"))
    dense = cut_lineage(prompts(spark, SF_DIR))
    dense = dense.select("prompt_id", "text")
    vault = v.build_vault(vault_entries(dense), "k")
    replies = cut_lineage(v.scrub_tokens(dense, secret="k", vault=vault))

    jobs = {
        "strip_invisible": lambda: v.strip_invisible(docs),
        "has_pii": lambda: v.has_pii(docs),
        "detect_spans": lambda: v.detect_spans(docs, ["doc_id"]),
        "pii_summary": lambda: v.pii_summary(docs, ["doc_id"]),
        "pii_report": lambda: v.pii_report(docs, ["source"]),
        "scrub_labels": lambda: v.scrub_labels(docs),
        "scrub_with_mapping": lambda: v.scrub_with_mapping(docs),
        "build_vault": lambda: v.build_vault(vault_entries(docs), "k"),
        "scrub_tokens": lambda: v.scrub_tokens(docs, secret="k"),
        "detect_spans_dense": lambda: v.detect_spans(dense, ["prompt_id"]),
        "scrub_labels_dense": lambda: v.scrub_labels(dense),
        "build_vault_dense": lambda: v.build_vault(vault_entries(dense), "k"),
        "scrub_tokens_dense": lambda: v.scrub_tokens(dense, secret="k", vault=vault),
        "restore_tokens_dense": lambda: v.restore_tokens(replies, vault),
        "unresolved_tokens_dense": lambda: v.unresolved_tokens(
            replies, vault.filter("entity <> 'date'"), ["prompt_id"]
        ),
    }
    times = {}
    for name, job in jobs.items():
        runs = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": f"total seconds of {len(times)} scrub jobs, best of {REPEATS}",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
