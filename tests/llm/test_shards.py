import os
from collections import Counter

from pyspark.sql import functions as F

from vitaframe.llm import shards


def test_files_hold_every_row_once(spark, tmp_path):
    rows = [(None, "n" * 300, i) for i in range(20)] + [(7, "r" * 300, 100 + i) for i in range(20)] + [(1000 + i, "u" * 50, 200 + i) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, more int").repartition(3)
    shards.write_shards(docs, str(tmp_path / "out"), 1000)
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name()).collect()
    assert Counter((r.doc_id, r.text, r.more) for r in got) == Counter(rows + rows[:3])
    sizes = Counter()
    for r in got:
        sizes[os.path.dirname(r.file)] += len(r.text)
    assert len(sizes) > 5 and max(sizes.values()) <= 1000
