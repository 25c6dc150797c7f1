"""Recall of op4_embedding_near_dedup against brute force on a folder of tables: python tests/llm/recall.py /root/testdata/check_s"""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[2]))
from kindred.llm.queries import op4_embedding_near_dedup  # noqa: E402

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    rows = spark.read.parquet(f"{sys.argv[1]}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = np.concatenate([(x[i : i + 1000] @ x.T >= 0.95).sum(axis=1) for i in range(0, len(x), 1000)]) - 1
    got = {r.vec_id: r.n_links for r in op4_embedding_near_dedup(spark, sys.argv[1]).collect()}
    found = np.array([got[r.vec_id] for r in rows])
    print(f"{len(x)} vectors, {true.sum() // 2} links, found {found.sum() // 2}, recall {found.sum() / max(1, true.sum()):.4f}, vectors with more than there are {int((found > true).sum())}")
