import os
import subprocess
import sys

import pandas as pd
from pyspark.sql import functions as F

from gridspark.llm.common import ascii_lower, by_size, free_name, written

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("op3_packing", "op5_simhash", "op1_chat_formatting"):
    print(name, e.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_any_folder(tmp_path):
    """Only the driver's path holds the package, as on a cluster without it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ALONE.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=300)
    counts = dict(line.split() for line in out.stdout.splitlines() if line.startswith("op"))
    assert set(counts) == {"op3_packing", "op5_simhash", "op1_chat_formatting"}, out.stderr[-2000:]
    assert counts["op5_simhash"] == "200"


def test_written_table_has_the_rows_and_types(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    back = written(df, "test")
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, back.collect())) == [(1, None), (2, "x")]
    assert written(df.limit(0), "test").count() == 0


def test_ascii_lower_and_names(spark):
    df = spark.createDataFrame([("ABC xyz",), ("ÀÉ ABCZ İ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(ascii_lower(F.col("t"))).collect()] == ["abc xyz", "ÀÉ abcz İ", None, ""]
    assert free_name(df, "u") == "u" and free_name(df, "T") == "T_1"


def test_parts_of_bounded_size():
    frame = pd.DataFrame({"t": ["aaaa", None, "bb", "c" * 50, "", "dd"], "k": range(6)})
    parts = list(by_size(iter([frame, frame.iloc[:0]]), "t", 6))
    assert [p.k.tolist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
