"""Documents of sessions against the flat tables they are made of; plans of the report's windows."""

from pyspark.sql import functions as F

from levelscope.operators import document as D
from levelscope.operators import report as P
from levelscope.plans import report_queries
from levelscope.plans.queries import tape_of

from .registered import SF_DIR, check, duck


def test_documents_equal_their_flat_tables(spark):
    """Every part of the stored documents, read by their schema, has the rows and values of its own table."""
    parts, back = report_queries._whole_documents(tape_of(spark, SF_DIR))
    assert len(parts) == 7
    back = back.cache()
    for name, (flat, order) in parts.items():
        got = D.part_rows(back, name)
        assert sorted(got.columns) == sorted(flat.columns)
        columns = sorted(flat.columns)
        a, b = (sorted((repr(tuple(r)) for r in df.select(*columns).collect()), key=str) for df in (got, flat))
        assert a == b, name
        rows = back.select("symbol", "session_id", F.col("report").getField(name).alias("p")).collect()
        for r in rows:
            keys = [tuple(x[c] for c in order) for x in r["p"]]
            assert keys == sorted(keys, key=lambda k: tuple((x is not None, x) for x in k))
    check(spark, duck(), report_queries.QUERIES["report_document"], report_queries.ORACLES["report_document"])


def test_documents_of_nothing_and_of_parts_without_rows(spark):
    a = spark.createDataFrame([("S", "S_1", 2, None, [1.5]), ("S", "S_1", 1, "x", [])], "symbol string, session_id string, k int, t string, v array<double>")
    b = spark.createDataFrame([("S", "S_2", "m")], "symbol string, session_id string, m string")
    rows = {r["session_id"]: r["report"] for r in D.session_documents({"a": (a, ["k"]), "b": (b, ["m"])}).collect()}
    assert [tuple(x) for x in rows["S_1"]["a"]] == [(1, "x", []), (2, None, [1.5])] and rows["S_1"]["b"] == []
    assert rows["S_2"]["a"] == [] and [tuple(x) for x in rows["S_2"]["b"]] == [("m",)]
    assert D.session_documents({"a": (a.limit(0), ["k"])}).count() == 0


def test_moments_meet_the_ticks_of_their_slices(spark):
    """No join of ticks with moments or moves goes by the session alone, and one reading of the stream serves a summary."""
    numbers = "last_price atr trade_count total_volume buy_volume sell_volume unknown_volume delta relative_aggression".split()
    stream = spark.createDataFrame([], "symbol string, session_id string, ts_ms long, " + ", ".join(f"{n} double" for n in numbers))
    markers = spark.createDataFrame([], "marker_id string, symbol string, session_id string, ts_ms long, marker_type string, direction_bias string, notes string")
    for df in (P.event_markers(stream, markers), P.chain_moves(stream, P.chain_nodes(markers))):
        plan = df._jdf.queryExecution().analyzed().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert len(joins) == 1 and joins[0].count("_slice#") == 2
