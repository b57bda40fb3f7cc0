from grainery.operators import intervals as I

SYMBOLS = [("f", "wide", 1, 50), ("f", "narrow", 5, 12), ("f", "narrow", 5, 12), ("f", "also", 5, 12), ("f", "late", 60, 61), ("g", "only", 9, 9), ("f", "open", 70, None), (None, "lost", 1, 9), ("h", "x", None, 3)]


def test_enclosing_symbol_sorts_no_pairs(spark):
    """Pairs of a file's lines and symbols were sorted before their best was taken, several times as many rows as both tables have."""
    symbols = spark.createDataFrame(SYMBOLS, 'file string, name string, start long, `end` long')
    calls = spark.createDataFrame([("f", 10), ("f", 10), ("f", 40), ("f", 65), ("f", 80), ("f", 0), ("g", 8), ("h", 2), (None, 3), ("z", 1)], "file string, line long")
    got = I.enclosing_symbol(calls, symbols)
    assert sorted(tuple(r) for r in got.collect()) == [("f", 10, "also", True), ("f", 40, "wide", True), ("f", 65, "late", False), ("f", 80, "open", False)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_chunk_of_symbol_gathers_by_file(spark):
    symbols = spark.createDataFrame(SYMBOLS, 'file string, name string, start long, `end` long')
    chunks = spark.createDataFrame([("f", 2, 1, 10), ("f", 1, 4, 6), ("f", 3, 55, 65), ("g", 0, 10, 20), ("h", 0, 1, 9), (None, 0, 1, 9)], "file string, idx int, first long, last long")
    got = I.chunk_of_symbol(symbols, chunks)
    assert sorted(tuple(r) for r in got.collect()) == [("f", "also", 5, 1), ("f", "late", 60, 3), ("f", "narrow", 5, 1), ("f", "wide", 1, 2)]
    assert "collect_set" in got._jdf.queryExecution().executedPlan().toString()
