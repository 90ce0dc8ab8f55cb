import random

from pyspark.sql import functions as F

from tessera.operators.ranges import interval_join
from tessera.operators.ranking import numbered, ranked


def test_intervals_against_all_pairs(spark):
    rng = random.Random(4)

    def some(n):
        out = []
        for i in range(n):
            lo = rng.randrange(-500, 500)
            out.append((i, None if rng.random() < 0.05 else lo, None if rng.random() < 0.05 else lo + rng.choice([0, 1, 3, 40, 900, -2])))
        return out + [(n, -(2**63), 2**63 - 1), (n + 1, 2**63 - 1, 2**63 - 1), (n + 2, 5, 5), (n + 3, 5, 5)]

    a, b = some(80), some(70)
    x, y = spark.createDataFrame(a, "i int, alo long, ahi long"), spark.createDataFrame(b, "j int, blo long, bhi long")
    least, most = -(2**70), 2**70
    ends = lambda r: (least if r[1] is None else r[1], most if r[2] is None else r[2])
    want = sorted((p[0], q[0]) for p in a for q in b for (s, e), (t, f) in [(ends(p), ends(q))] if s <= e and t <= f and s <= f and t <= e)
    got = interval_join(x, y, ("alo", "ahi"), ("blo", "bhi")).select("i", "j").collect()
    assert sorted(map(tuple, got)) == want
    assert interval_join(x.limit(0), y, ("alo", "ahi"), ("blo", "bhi")).count() == 0
    by = interval_join(x.withColumn("g", F.col("i") % 3), y.withColumn("g", F.col("j") % 3), ("alo", "ahi"), ("blo", "bhi"), ["g"]).select("i", "j").collect()
    assert sorted(map(tuple, by)) == [(i, j) for i, j in want if i % 3 == j % 3]


def test_numbers_and_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(200)], "v int, i int")
    got = {r["i"]: r["_row"] for r in numbered(df, [F.col("v"), F.col("i")]).collect()}
    order = sorted(range(200), key=lambda i: (i * 7 % 50, i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    ranks = {(r["v"], r["_rank"]) for r in ranked(df, [(F.col("v"), True)], [F.col("i")]).collect()}
    assert ranks == {(v, 1 + 4 * (49 - v)) for v in range(50)}
    assert numbered(df.limit(0), [F.col("v")]).count() == 0


def test_programs_use_the_range_join(db, rows):
    t = "a[k, s, e] <- [[1, 0, 5], [2, 10, 12], [3, 9, 4]] b[m, u, v] <- [[7, 5, 9], [8, 11, 30], [9, 100, 90]] "
    q = t + "?[k, m] := a[k, s, e], i = make_interval(s, e), b[m, u, v], j = make_interval(u, v), interval_intersects(i, j)"
    assert rows(q) == {(1, 7), (2, 8)}
    plan = db.run(q)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert rows(t + "?[k, m] := a[k, s, e], b[m, u, v], i = make_interval(s, e), j = make_interval(u, v), interval_intersects(j, i), m > 7") == {(2, 8)}


def test_pairs_of_rows_told_apart_are_not_shuffled_again(spark, db):
    text = "?[k, s] := *a{k, lo}, i = make_interval(lo, lo + 3), *b{s, at}, j = make_interval(at, at + 2), interval_intersects(i, j)"

    def run(a, b):
        db.attach("a", spark.createDataFrame(a, "k long, lo long"))
        db.attach("b", spark.createDataFrame(b, "s long, at long"))
        df = db.run(text)
        return sorted(map(tuple, df.collect())), df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].count("Aggregate")

    got, again = run([(1, 0), (2, 5)], [(7, 1), (8, 100)])
    assert got == [(1, 7)] and again == 0
    # a key that stands twice still gives a set
    got, again = run([(1, 0), (1, 1), (2, 5)], [(7, 1), (8, 100)])
    assert got == [(1, 7)] and again == 1
