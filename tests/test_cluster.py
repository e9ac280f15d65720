"""What holds only where executors are processes of their own."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
from quern import workload
from quern.sources import connectors

spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.host", "127.0.0.1").getOrCreate()
got = sorted(tuple(r) for r in workload.QUERIES["jdbc_upsert"](spark, "/root/testdata/sf0.001").collect())
want = [(r[0] + 1000, r[1]) if r[2] == 3 else (r[0], r[1].upper() + "!") if r[2] == 2 else (r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()]
assert got == sorted(want), got
c = connectors.open_connector(spark, "jdbc", url="jdbc:derby:memory:kinds;create=true")
df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS s, DATE '2024-01-02' AS d, TIMESTAMP '2024-01-02 03:04:05' AS t, 1.5D AS f, CAST(2.25 AS DECIMAL(5,2)) AS n UNION ALL SELECT 2, 'é', NULL, NULL, NULL, NULL")
c.write(df, "kinds", mode="overwrite")
c.write(df.filter("a = 2"), "kinds")
assert sorted(map(repr, c.read("kinds").collect())) == sorted(map(repr, [*df.collect(), *df.filter("a = 2").collect()]))
print("as wanted")
"""


def test_embedded_database_of_the_driver():
    env = os.environ | {"PYTHONPATH": REPO}
    r = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, timeout=240, cwd=REPO, env=env)
    assert "as wanted" in r.stdout, r.stderr[-3000:]
