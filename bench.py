"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line with the median seconds of three warm runs.

All run over the whole of lineitem (600,000 rows at sf0.1), whose order is l_orderkey, l_linenumber, so that times per row compare; every result is computed in full.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from rillway import pipeline

PLANS = {
    "flagship": 'filter "l_quantity > 25" | derive rev=l_extendedprice*(1-l_discount) | group-agg l_returnflag rev:sum:revenue l_quantity:avg:avg_qty | sort l_returnflag',
    "passthrough": "flatten",
    "filter": 'filter "l_quantity > 25"',
    "select": "select l_orderkey,l_extendedprice",
    "derive": "derive net=l_extendedprice*(1-l_discount) per=l_extendedprice/l_quantity k=l_orderkey+l_linenumber",
    "head": "head 1000",
    "sort": "sort -l_extendedprice",
    "top": "top 1000 l_extendedprice",
    "unique": "unique l_partkey",
    "stats": "select l_quantity,l_extendedprice | stats",
    "group_agg": "group-agg l_returnflag l_extendedprice:sum:s l_extendedprice:avg:a l_extendedprice:count:n",
    "frequency": "frequency l_returnflag",
    "pivot_sum": "select l_suppkey,l_returnflag,l_quantity | pivot l_returnflag l_quantity sum",
    "skip": "skip 1000",
    "step_running_sum": "step l_quantity running-sum",
    "window_avg": "window l_quantity 5 avg",
    "fill_down": "fill-down l_discount,l_tax",
    "ewma": "ewma l_quantity 0.3",
    "expr_text": "derive u=upper(l_returnflag) c=concat(l_returnflag,'/',l_linestatus) l=left(l_linestatus,1) n=len(l_returnflag) | select l_orderkey,u,c,l,n",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name, text in PLANS.items():
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
            pipeline(text).apply(df, order=["l_orderkey", "l_linenumber"]).df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries over lineitem, median of three warm runs", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
