"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from hushql.plans import queries as reference

HEADLINE = ["count_star_grouped", "count_star_global", "sum_double", "multi_aid_count", "multi_aid_sum", "join_two_identifiers", "led_merge", "count_distinct_aid", "count_distinct_values", "suppress_bin", "noisy_counts"]
PLAIN = {
    "count_star_grouped": "SELECT c_mktsegment, count(*) n FROM customer GROUP BY 1",
    "sum_double": "SELECT o_orderstatus, sum(o_totalprice) s FROM orders GROUP BY 1",
    "multi_aid_count": "SELECT l_returnflag, l_linestatus, count(*) n FROM lineitem GROUP BY 1, 2",
    "multi_aid_sum": "SELECT l_returnflag, sum(l_extendedprice) s FROM lineitem GROUP BY 1",
    "join_two_identifiers": "SELECT c_mktsegment, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "led_merge": "SELECT c_nationkey, c_mktsegment, floor(c_acctbal / 5000) b, count(*) n FROM customer GROUP BY 1, 2, 3",
}


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        runs = []
        for _ in range(3):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        return round(median(runs[1:] or runs), 3)

    queries = reference.queries()
    took = {name: timed(lambda q=queries[name]: q(spark, sf_dir)) for name in HEADLINE}
    plain = {name: timed(lambda t=text: spark.sql(t)) for name, text in PLAIN.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "plain": plain, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
