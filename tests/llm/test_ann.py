import numpy as np

from axonframe.llm.ann import Settings, SortedArrays, brute_force, nearest

SCHEMA = "vec_id long, embedding array<float>, id string, score double"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "c", 0.0) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, **options).collect())


def test_small_table_is_exact_with_ties_and_odd_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(0, 30)] + [(100, [0.0, 0.0]), (200, None), (300, [float("nan"), 1.0]), (400, [1.0, None]), (500, []), (600, [float("inf"), 0.0]), (None, [1.0, 1.0]), (700, [1.0, 2.0, 3.0])]
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows[:30]}
    got = run(spark, rows, every=10)
    assert got == sorted(brute_force(good, 10, 10))
    assert run(spark, rows[:4], every=1, k=10) == sorted(brute_force(dict(list(good.items())[:4]), 10, 1))
    assert run(spark, []) == []


def test_repeated_rows(spark):
    got = run(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0])])
    assert [(a, b, c) for a, b, c, _ in got] == [(0, 1, 0), (0, 2, 5), (0, 3, 5)]  # all rows but the query's own
    got = run(spark, [(100, [1.0, 0.0]), (100, [1.1, 0.0]), (7, [9.0, 0.0])])
    assert [(a, b, c) for a, b, c, _ in got] == [(100, 1, 100), (100, 2, 7)] and abs(got[0][3] - 0.1) < 1e-6


def test_recall_over_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 64))
    table = centres[rng.integers(0, 10, 3000)] * 0.3 + rng.standard_normal((3000, 64))
    table = (table / np.linalg.norm(table, axis=1, keepdims=True)).astype(np.float32)
    want = {(q, i) for q, _, i, _ in brute_force({i: v.astype(float) for i, v in enumerate(table)}, 10, 100)}
    got = run(spark, [(i, [float(x) for x in v]) for i, v in enumerate(table)], s=Settings(block=1000))
    assert len(got) == len(want)
    assert len(want & {(q, i) for q, _, i, _ in got}) >= 0.9 * len(want)
    exact = {(q, i): float(np.sqrt(((table[q].astype(float) - table[i].astype(float)) ** 2).sum())) for q, _, i, _ in got}
    assert all(abs(exact[q, i] - d) < 1e-12 for q, _, i, d in got)


def test_collision_counting_verifies_few_vectors_and_finds_the_nearest():
    rng = np.random.default_rng(11)
    table = rng.standard_normal((16_384, 64))
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    index, found, verified = SortedArrays(table, Settings()), 0, 0
    for q in range(0, 16_384, 820):
        places, distances, n = index.search(table[q], 11)
        exact = np.sqrt(((table - table[q]) ** 2).sum(axis=1))
        assert np.allclose(exact[places], distances) and (np.diff(distances) >= 0).all()
        found += len({*places[:11].tolist()} & {*np.argsort(exact)[:11].tolist()} - {q})
        verified += n
    print("verified", verified / 20 / 16_384, "recall", found / 200)
    assert verified < 0.05 * 20 * 16_384 and found >= 0.9 * 200


def test_a_vector_that_a_third_of_all_rows_have(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    got = run(spark, rows, every=500, s=Settings(least=32))
    assert [(q, r, v) for q, r, v, _ in got if q == 1000] == [(1000, r, 1000 + r) for r in range(1, 11)]
    assert all(score == 0 for q, _, _, score in got if q == 1000)
