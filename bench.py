"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from quern import conformance, queries
from quern.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Writes and streams commit tables; one run of each is measured.
ONCE = ("retention_keep_newest", "upsert_merge", "delete_rows", "compare_and_delete", "batch_coalesce", "append_replay_sequence", "schema_evolution", "stream_append")


QUERIES = queries.QUERIES
#: Besides, writes and refusals of the conformance queries, once each; the total leaves them out, to stay comparable.
MORE = conformance.QUERIES


def main() -> None:
    spark = session("bench", **{"spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in QUERIES.items():
        runs = []
        for _ in range(1 if name in ONCE else 4):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:] or runs), 4)
    total = round(sum(seconds.values()), 3)
    for name, query in MORE.items():
        start = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 4)
    print(json.dumps({"metric": "total wall seconds of all queries (median of 3 after a warm-up)", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
