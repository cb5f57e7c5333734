from collections import Counter

import corpus_pipeline
from axonframe.llm.decontaminate import drop_contaminated
from axonframe.llm.mixing import mix_digest, mixed_documents
from axonframe.llm.interleave import shard_digest, sharded_documents
from axonframe.llm.quality import keep_good

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "a b c", "en", "s1", 5), (2, "a b", "en", "s1", 3), (3, None, "en", "s1", 0), (4, "q " * 40, "en", "s2", 80), (5, "", "en", None, 0),
    (6, "z z z z", "en", None, 7), (None, "n", "en", "s2", 1), (7, "x y", None, "", None), (7, "x y", None, "", None), (8, "w " * 9000, "en", "s2", 18000),
]


def test_mix_edge_cases(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA + ", target string, size int")
    got = mix_digest(df).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for _, text, _, source, _ in ROWS:
        sizes[source] += len((text or "").split())
    total, weights = sum(sizes.values()), dict(zip(["", "s1", "s2", None], [3, 1, 2, 3]))
    capped, level = set(), 0.0
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in capped)
        level = rest / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s, w in weights.items() if s not in capped and w * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 2 * sizes[s] if s in capped else weights[s] * level for s in weights}
    by_id = {r[0]: r[3] for r in ROWS}
    for r in got:
        assert abs(r.target - want[by_id[r.doc_id]]) < 1e-6 and r.taken <= 2 * r.size
    for source in weights:
        taken = sum(r.taken for r in got if by_id[r.doc_id] == source)
        assert abs(taken - want[source]) <= max([r.size for r in got if by_id[r.doc_id] == source])
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    copies = Counter(str(r.doc_id) for r in mixed_documents(docs).collect())
    for r in got:
        if r.size:
            assert copies[str(r.doc_id)] == r.taken // r.size * sum(x[0] == r.doc_id for x in ROWS)
    assert mix_digest(df.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_shards_follow_the_mixture(spark):
    rows = [(i, "t" * (i % 50), "en", "big" if i % 3 else f"s{i % 7}", i) for i in range(1000)] + ROWS
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", law string, slot int")
    got = shard_digest(df).collect()
    counts = Counter(r.shard for r in got)
    assert sum(counts.values()) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    source = {r[0]: r[3] for r in rows[:1000]}
    big = Counter(r.shard for r in got if source.get(r.doc_id) == "big")
    assert max(big.values()) - min(big.values()) <= 4
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    whole = sharded_documents(docs)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    assert Counter(str(r[:5]) for r in whole.collect()) == Counter(str(tuple(r)) for r in docs.collect())
    assert shard_digest(df.limit(0)).count() == 0 and sharded_documents(docs.limit(0)).count() == 0
    assert Counter(r.shard for r in shard_digest(df.limit(5)).collect()).most_common(1)[0][1] == 1


def test_run_on_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.columns == [*docs.columns, "shard", "slot"]
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1


def test_columns_that_clash_stay_as_they_are(spark):
    names = "shard slot law _i _s _z _k _n _c _row _size _copies _copy _hash _rank _part node sha".split()
    df = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in ROWS], SCHEMA + "".join(f", {n} string" for n in names))
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and {str(tuple(r)) for r in mixed.collect()} <= {str(tuple(r)) for r in df.collect()}
    kept = [n for n in df.columns if n not in ("shard", "slot")]
    whole = sharded_documents(df)
    assert whole.columns == [*kept, "shard", "slot"]
    assert Counter(str(tuple(r)[:-2]) for r in whole.collect()) == Counter(str(tuple(r)) for r in df.select(*kept).collect())
    benchmark = spark.createDataFrame([(1, "z z z z z z z z z z z z", "x")], "item_id long, text string, _key string")
    rest = drop_contaminated(df, benchmark)
    assert rest.columns == df.columns and rest.count() == len(ROWS)
    good = keep_good(df, spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, text string"))
    assert good.columns == df.columns


def test_ties_of_ids_do_not_depend_on_the_order_of_rows(spark):
    rows = [(5, f"{'t ' * (i % 7)}{i % 3}", "en", "s", i) for i in range(60)]
    one, two = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (rows, rows[::-1]))
    assert sorted(map(tuple, shard_digest(one).drop("grown_shard").collect())) == sorted(map(tuple, shard_digest(two).drop("grown_shard").collect()))
