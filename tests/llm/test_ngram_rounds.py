from corvane.llm import ngram_join


def test_components_settle_by_stars(spark):
    """A long chain, a hot node and a pair; settled edges are stars of the smallest node, others aren't."""
    frame = lambda pairs: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "a binary, b binary")
    assert ngram_join._settled(frame([(2, 1), (3, 1), (9, 8)])) and ngram_join._settled(frame([]))
    assert not ngram_join._settled(frame([(2, 1), (3, 2)])) and not ngram_join._settled(frame([(3, 1), (3, 2)]))
    edges = frame([(k, k + 1) for k in range(30)] + [(200, k) for k in range(100, 140)] + [(50, 51), (51, 50), (60, 60)])
    want = {bytes([k]): bytes([0]) for k in range(31)} | {bytes([k]): bytes([100]) for k in [*range(100, 140), 200]} | {bytes([k]): bytes([50]) for k in (50, 51)}
    got = ngram_join.components(edges).collect()
    assert len(got) == len(want) and {bytes(r.node): bytes(r.label) for r in got} == want


def test_joins_are_shuffled(spark):
    """No table of the join goes through the driver as a broadcast, however small it is."""
    out = ngram_join.component_table(spark.createDataFrame([(k, f"a b c d e f {k % 3}") for k in range(9)], "doc_id bigint, text string"))
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
