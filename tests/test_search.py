from folio.operators import instruments as ins

HIT = "symbol string, name string, exchange string, currency string"


def test_hits_alike_but_for_exchange(spark):
    """Which of them stays does not depend on the order of the rows."""
    none = spark.createDataFrame([], HIT)
    for exchanges in (("NMS", "UNKNOWN"), ("UNKNOWN", "NMS")):
        world = spark.createDataFrame([("TK21", "Brand#1", e, None) for e in exchanges], HIT).coalesce(1)
        assert [tuple(r) for r in ins.search_merge(none, none, world).collect()] == [("TK21", "Brand#1", "NMS", None, 2)]
