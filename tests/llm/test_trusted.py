import numpy as np
import pytest
from pyspark.sql import functions as F

from modspark.llm import quality_rules as Q


@pytest.mark.parametrize("apart", [1, 1 << 20])
def test_every_good_document_is_counted(spark, apart):
    """More good documents than any sample held, with ids close together and far apart, and a join that doesn't broadcast."""
    n = 20_500
    docs = spark.range(n + 100).select(((F.col("id") - 300) * apart).alias("doc_id"), F.when(F.col("id") < n, F.concat(F.lit("good"), F.col("id"))).otherwise("junk").alias("text"))
    docs = docs.unionByName(docs.where(F.col("doc_id") == 7 * apart)).unionByName(spark.createDataFrame([(None, "junk")], "doc_id long, text string"))
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") < (n - 300) * apart).cast("int").alias("quality"))
    assert Q.trusted(labels).count() == n
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ratio = Q.fit(docs, Q.trusted(labels))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    raw, target = np.zeros(1 << Q.BITS), np.zeros(1 << Q.BITS)
    for doc, text in docs.collect():
        b = Q.ngram_buckets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
        np.add.at(raw, b, 1)
        np.add.at(target, b, doc is not None and doc < (n - 300) * apart)
    assert np.allclose(ratio, np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw))))
