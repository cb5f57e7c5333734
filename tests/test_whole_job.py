"""Queries take the whole of their tables."""

from itertools import combinations

import numpy as np

from axonframe.plans import queries


def test_correlations_of_five_cells(spark, sf_dir):
    vectors = np.array([r.embedding[:16] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()])
    spins = np.where(vectors > 0, 1, -1)
    got = {tuple(r.subset): r["corr"] for r in queries.QUERIES["k_corr_5"](spark, sf_dir).collect()}
    assert set(got) == set(combinations(range(16), 5))
    for subset in list(got)[::97]:
        assert abs(got[subset] - spins[:, list(subset)].prod(axis=1).mean()) < 1e-6


def test_no_query_simulates_or_runs_on_rows_of_its_own():
    assert not {"metropolis_sweep", "magnetization_curve", "system_size", "mch_fit", "verify_fit"} & set(queries.QUERIES)
    assert set(queries.ORACLES) == set(queries.QUERIES)
