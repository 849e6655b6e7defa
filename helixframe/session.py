"""A local session for tests, the benchmark and the comparison; on a cluster the given session is used as it is."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None, **conf: str) -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-")
    base = {
        "spark.master": f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1", "spark.local.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.checkpoint.dir": f"{scratch}/checkpoint",
    }
    spark = SparkSession.builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
