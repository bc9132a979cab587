from siftline.plans import fixtures, search

SF = "/root/testdata/sf0.01"


def test_every_request_has_a_query(spark):
    """Also where the benchmark has fewer items than there are requests."""
    hits, items = fixtures.hits(spark, SF), fixtures.queries(spark, SF)
    found = {r.query_id: r.q for r in search.request_queries(hits, items).collect()}
    own = {r.query_id: r.q for r in items.collect()}
    assert set(found) == {r.query_id for r in hits.select("query_id").distinct().collect()} and set(found) - set(own)
    assert all(q == own.get(i, own[i % len(own)]) for i, q in found.items())
