"""The search over cells and codes finds what a whole scan finds."""

import numpy as np
import pytest

from tarnlight.operators import ann
from tarnlight.queries import _recalls


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_neighbours_beyond_cells_and_candidates(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[300:] = x[0] + 0.001 * rng.normal(size=(300, 16))  # more near copies than candidates
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>").repartition(3)
    found = ann.centres(rows, "v")
    index = ann.indexed(rows, "v", found).cache()
    y = x.astype(np.float32).astype(float)
    for q in (y[0], y[5], np.ones(16)):
        score = {"cosine": y @ q / np.linalg.norm(y, axis=1), "l2": -np.sqrt(((y - q) ** 2).sum(1)), "dot": y @ q}[metric]
        got = [r.id for r in ann.search(index, "v", found, q.tolist(), 10, metric=metric).collect()]
        assert got == np.argsort(-score, kind="stable")[:10].tolist()


def test_recall_of_the_set(spark):
    rows = _recalls(spark, "/root/testdata/sf0.001").collect()
    assert {r.query for r in rows} == {0, 100, 200, 300, 400} and min(r.recall for r in rows) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_many_queries_find_what_one_finds(spark, metric, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    x[200:300] = x[1]  # copies, cut by their ids
    x[300:400] = x[2] + 0.001 * rng.normal(size=(100, 16))
    x[400] = 0
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, [None] * 16)]
    rows = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    found = ann.centres(rows.filter("id < 900"), "v")
    index = ann.indexed(rows.filter("id < 900"), "v", found).cache()
    monkeypatch.setattr(ann, "ASKED", 4)
    asked = x[[0, 1, 2, 7, 250, 400]].astype(np.float32).astype(float)
    of = lambda df: {q: [(r.id, r._score) for r in sorted((r for r in got if r.query == q), key=lambda r: (r._score if metric == "l2" else -r._score, r.id))] for got in [df.collect()] for q in range(len(asked))}
    for complete in (True, False):
        many = of(ann.search_many(index, "v", found, asked, 10, candidates=20, metric=metric, complete=complete))
        for k, q in enumerate(asked):
            one = [(r.id, r._score) for r in ann.search(index, "v", found, q.tolist(), 10, candidates=20, metric=metric, complete=complete).collect()]
            assert [i for i, _ in many[k]] == [i for i, _ in one] and [s for _, s in many[k]] == pytest.approx([s for _, s in one], abs=1e-12)
        if complete:
            assert of(ann.exact_many(rows, "v", asked, 10, metric)) == many


def test_recall_asks_all_queries_in_a_bounded_number_of_jobs(spark, tmp_path):
    """Queries were asked one by one, each with three scans: the jobs grew with the table."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 8))
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.sparkContext.setJobGroup("recalls", "recalls")
    rows = _recalls(spark, str(tmp_path)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("recalls"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.query for r in rows} == set(range(0, 4000, 100)) and {r.recall for r in rows} == {1.0}
    assert jobs < 40
