"""Same results for 1, 4 and 64 shuffle partitions (order and randomness
depend only on keys and hashes, never on partitioning)."""

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
QUERIES = ["file_md5_index", "general_tokens", "registry_a", "caption_examples", "mlm_chunks",
           "mlm_batches"]


def test_partition_count_invariance(spark):
    qs = E.queries()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = {}
        for parts in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            for name in QUERIES:
                rows = sorted(tuple(r) for r in qs[name](spark, SMALL).collect())
                results.setdefault(name, []).append(rows)
        for name, runs in results.items():
            assert runs[0] == runs[1] == runs[2], name
            assert len(runs[0]) > 0, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
