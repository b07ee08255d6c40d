"""op7 makes the training order of all copies, and its rows come from it."""

from corvane.llm import mixing, queries, shared

SF = "/root/testdata/sf0.001"


def test_op7_writes_the_training_order(spark, monkeypatch):
    made = []
    settle = shared.settle
    monkeypatch.setattr(shared, "settle", lambda df, name: made.append(settle(df, name)) or made[-1])  # the order; sizes are settled by mixing itself
    got = queries.op7_mixing(spark, SF).collect()
    order = made[0].collect()
    want = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "position").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    copies = {}
    for r in order:
        assert (r.round == 0) == (r.taken == 0) == (r.position is None) and (r.position is None or 0 <= r.position <= 1)
        copies.setdefault(r.doc_id, []).append(r)
    assert all(len(x) == max(1, -(-x[0].taken // max(x[0].size, 1))) for x in copies.values())
