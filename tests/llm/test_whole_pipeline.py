"""The pipeline against plain versions of its stages, one after the other."""

from collections import Counter

import duckdb
import pandas as pd
from test_decontaminate import brute as brute_contamination
from test_quality import plain_scores
from test_simhash_dedup import shingle_set, slow_coverage, union_find

import corpus_pipeline
from axonframe.llm.quality import Settings
from axonframe.llm.queries import ORACLES


def test_run_equals_the_plain_stages(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert len({d[0] for d in docs}) == len(docs)

    scores = dict(plain_scores(docs, labels, Settings()))
    good = [d for d in docs if scores[str(d[0])] >= 0.3]

    texts = {d[0]: d[1] or "" for d in good}
    having = {}
    for i, text in texts.items():
        for x in shingle_set(text):
            having.setdefault(x, set()).add(i)
    pairs = {(a, b) for ids in having.values() for a in ids for b in ids if a < b}
    groups = union_find(texts, [p for p in pairs if slow_coverage(texts[p[0]], texts[p[1]]) >= 0.8])
    single = [d for d in good if groups[d[0]] == d[0]]

    stems = set().union(*(shingle_set(t) for _, t in items))
    found = {d for d, _ in brute_contamination([d[:2] for d in single if not stems.isdisjoint(shingle_set(d[1] or ""))], items)}
    clean = [d for d in single if d[0] not in found]
    assert len(clean) < len(single) < len(good) <= len(docs)

    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(clean, columns=["doc_id", "text", "lang", "source", "n_chars"]))
        copies = {i: taken // size for i, size, taken in db.sql(f"SELECT doc_id, size, taken FROM ({ORACLES['op8_mixing']})").fetchall() if size}
    wanted = Counter({d: copies.get(d[0], 0) for d in clean if copies.get(d[0], 0)})

    rows = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    got = Counter(r[:5] for r in rows)
    assert {k: n for k, n in got.items() if (k[1] or "").split()} == dict(wanted)
    shards = Counter(r[5] for r in rows)
    assert set(shards) == set(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(r[6] for r in rows if r[5] == k) == list(range(n)) for k, n in shards.items())
