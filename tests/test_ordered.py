from loomgraph.operators.ordered import prefix_sums


def test_against_plain_sums(spark):
    rows = [("a" if i % 3 else f"g{i % 7}", (i * 7919) % 1009, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, n long")
    got = {(r.g, r.o): (r._row, r._before) for r in prefix_sums(df, "g", ["o"], "n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for k, (_, o, n) in enumerate(sorted(r for r in rows if r[0] == g)):
            want[g, o] = (k, total)
            total += n
    assert got == want


def test_empty(spark):
    assert prefix_sums(spark.createDataFrame([], "g string, o long, n long"), "g", ["o"], "n").count() == 0
