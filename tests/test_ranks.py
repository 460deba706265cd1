"""Plans by ranges and grouped passes, against plain Python."""

import hashlib


def test_revision_is_the_digest_of_all_ids_in_order(spark):
    from tracelode.plans import ranks

    rows = [(k, str(i)) for k, n in (("a", 500), ("b", 1), (None, 30)) for i in range(n)] + [("a", None), ("empty", None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.key: (r.n, r.revision) for r in ranks.revisions(spark.createDataFrame(rows, "key string, id string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for key in ("a", "b", None, "empty"):
        ids = [i for k, i in rows if k == key]
        assert got[key] == (len(ids), hashlib.md5(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest())
