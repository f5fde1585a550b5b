"""How often operator 5 exchanges its documents and what it sends of them."""

from netquarry.llm import suffix_dedup


def test_documents_and_surroundings_are_exchanged_once(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (2, "before " + text), (3, "x" * 200), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.report(spark, df)
    assert sorted(map(tuple, out.collect())) == sorted(suffix_dedup.brute_force(rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert "Scan parquet" not in plan  # nothing of it is written in between
    assert plan.count("ReusedExchange") == 2  # of the documents: for the hashes, the surroundings and the cut
