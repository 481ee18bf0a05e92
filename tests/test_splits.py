import os

from pyspark.sql import functions as F

from brindle.plans import pairs as P
from brindle.session import checkpoint


def test_no_cluster_of_near_duplicates_stands_in_two_splits(spark, tmp_path):
    root = str(tmp_path)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    base = "the {} report names turbine{k} gearbox{k} harbour{k} salvage{k} crane{k} and ballast{k}"
    texts = [base.format("first" if i % 2 else "second", k=i // 2) if i < 30 else f"wholly other story {i} about matter {i * 7}" for i in range(60)]
    write("messages", [(i, t, f"2025-02-{i % 28 + 1:02d} 10:00:00", "", "{}") for i, t in enumerate(texts)], "id long, text string, received_at string, published_at string, raw_event_json string")
    write("candidate_pairs", [(i, f"X:{k}", k, ("train", "test", "val")[i % 3], "news", t, 1) for i, t in enumerate(texts) for k in (0, 1)], "message_id long, candidate_code string, label int, split string, source_type string, message_text string, real_candidate_count int")
    clusters = {r["id"]: r["cluster"] for r in P.near_dup_clusters(spark, root).collect()}
    assert len(set(clusters[i] for i in range(30))) < 30
    for query in (P.leak_free_split, P.leak_free_frozen_split):
        rows = query(spark, root).collect()
        assert len(rows) == 60 and all(r["cluster"] == clusters[r["message_id"]] for r in rows)
        of = {}
        for r in rows:
            of.setdefault(r["cluster"], set()).add(r["split"])
        assert all(len(s) == 1 for s in of.values()) and len({s for v in of.values() for s in v}) >= 2
    frozen = {r["cluster"]: r["split"] for r in rows}
    assert all(frozen[clusters[i]] == "test" for i in range(60) if i % 3 == 1)


def test_a_replaced_table_is_deleted(spark):
    folder = lambda df: df._checkpoint.removeprefix("file://")
    a = checkpoint(spark.range(5))
    b = checkpoint(a.where("id > 1"), instead_of=a)
    assert not os.path.exists(folder(a)) and os.path.exists(folder(b)) and b.agg(F.sum("id")).first()[0] == 9
    assert checkpoint(b.select("id"), instead_of=b.select("id")).count() == 3 and b.count() == 3
