import random
import statistics

from folioscan.operators import evaluate


def test_exact_median(spark):
    rng = random.Random(1)
    values = {"a": [rng.gauss(0, 1) for _ in range(5001)], "b": [5.0] * 4000 + [7.0] * 4000, "c": [1.0], None: [rng.randint(0, 3) * 1.0 for _ in range(300)], "d": [rng.random() ** 9 * 1e6 for _ in range(20_000)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("e", None), ("a", None)]
    df = spark.createDataFrame(rows, "status string, ms double").repartition(4)
    got = {r.status: (r.n, r.median) for r in evaluate.exact_median(df, "status", "ms").collect()}
    assert got == {k: (len(v), statistics.median(v)) for k, v in values.items()}
    assert evaluate.exact_median(df, "status", "ms", accuracy=100).count() == len(values)
    assert evaluate.exact_median(df.limit(0), "status", "ms").collect() == []
