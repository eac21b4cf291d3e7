"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then REPEATS times; its figure is the median.  Start-up is
reported apart.  ``rows_per_second`` compares with a copy and a three-column masked copy."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 5


def main() -> None:
    from millrace.functions import masking as m
    from millrace.plans import QUERIES
    from millrace.session import session

    began = time.time()
    scratch = tempfile.mkdtemp(prefix="millrace-bench-")
    spark = session(f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.checkpoint.dir": f"file://{scratch}/shared"})
    spark.sparkContext.setLogLevel("ERROR")
    startup = time.time() - began
    out = f"{scratch}/out"
    from pyspark.sql import functions as F

    lineitem = f"{SF_DIR}/lineitem.parquet"
    rows = spark.read.parquet(lineitem).count()

    def copied():
        return spark.read.parquet(lineitem)

    def masked():
        df = spark.read.parquet(lineitem)
        new = {"l_orderkey": m.sync_email(F.col("l_orderkey")), "l_partkey": m.sync_phone(F.col("l_partkey")), "l_suppkey": m.sync_name(F.col("l_suppkey"))}
        return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])

    jobs = {"raw_copy": copied, "masked_copy_3": masked}
    for name in ("flagship_masked_customers", "audit_mask_report", "fk_lineitem_orders", "left_join_rollup", "upsert_do_update", "agg_category_topk", "mask_card_luhn", "batch_tracker", "redact_text_pii", "audit_pii_patterns", "copy_with_transform", "mask_hmac_sha256"):
        jobs[name] = lambda f=QUERIES[name]: f(spark, SF_DIR)
    figures, spread = {}, {}
    for name, job in jobs.items():
        times = []
        for _ in range(REPEATS + 1):
            t = time.time()
            if name in ("raw_copy", "masked_copy_3"):
                job().write.mode("overwrite").parquet(out)
            else:
                job().write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        figures[name] = round(statistics.median(times[1:]), 4)
        spread[name] = [round(min(times[1:]), 4), round(max(times[1:]), 4)]
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    per = {k: round(rows / figures[k]) for k in ("raw_copy", "masked_copy_3")}
    print(json.dumps({"metric": "total_query_time", "value": round(sum(figures.values()), 4), "unit": "sec", "queries": figures, "spread": spread, "rows_per_second": per, "startup_sec": round(startup, 2), "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
