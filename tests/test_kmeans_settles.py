"""``kmeans_fit`` goes on until the centroids settle; packed rounds equal plain ones."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle_check import rows_of
from __spark_entry__ import oracle_sql, queries
from credence.operators import kmeans as KM
from credence.operators import tfidf as X
from credence.operators import vectors as VF
from credence.operators.clusters import Centroids
from credence.plans.detector import KMEANS_TOL, ClusterDetector
from credence.sources.tables import corpus


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """240 articles of the same eight words in any order: k-means needs more than a few rounds."""
    rng, path = random.Random(7), tmp_path_factory.mktemp("mixed")
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(8)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 8))) for _ in range(240)]
    ids = list(range(240))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * 240, "source": ["s"] * 240, "n_chars": [len(t) for t in texts]}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": [1] * 240, "toxic": [int(rng.random() < 0.4) for _ in ids]}), path / "labels.parquet")
    return str(path)


def _settled(x, centroids, tol):
    """Plain Lloyd rounds until the summed squared shift is at most ``tol``: nearest centroid of each row, distances, rounds."""
    for rounds in range(1, 301):
        near = ((x[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
        after = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centroids[j] for j in range(len(centroids))])
        shift, centroids = ((after - centroids) ** 2).sum(), after
        if shift <= tol:
            break
    d2 = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    return d2.argmin(axis=1), np.sqrt(d2.min(axis=1)), rounds


def test_kmeans_fit_settles(spark, folder):
    docs = corpus(spark, folder, by_doc=True)
    terms = X.detector_terms(docs)
    vocab = X.fit_vocabulary(X.term_frequencies(terms), 240, X.DETECTOR_MAX_FEATURES, X.DETECTOR_MIN_DF)
    sparse = VF.sparse_counts(terms, vocab).cache()
    scaler = X.fit_scaler(VF.long_weights(sparse, vocab), 240, len(vocab))
    rows = sparse.collect()
    x, fake = np.array([KM._vector(r, vocab, scaler) for r in rows]), np.array([r["is_fake"] for r in rows])
    near, distance, rounds = _settled(x, np.array(KM.seeds(sparse, vocab, scaler, 3, 42).values), KMEANS_TOL)
    assert 4 < rounds < 300
    got = {r["cluster"]: r for r in queries()["kmeans_fit"](spark, folder).collect()}
    assert set(got) == set(near.tolist())
    for j, r in got.items():
        own = distance[near == j]
        assert r["size"] == len(own)
        assert [r["mean"], r["std"], r["max"], r["fake_ratio"]] == pytest.approx([own.mean(), own.std(), own.max(), fake[near == j].mean()], abs=2e-6)
    model, _ = ClusterDetector.fit(docs)
    assert model.settled and model.rounds == rounds


def test_kmeans_fit_equals_its_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df, res = queries()["kmeans_fit"](spark, folder), con.execute(oracle_sql()["kmeans_fit"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())
    sql = oracle_sql()["kmeans_fit"]
    shifts = [v for v, in con.execute(sql[:sql.rindex("SELECT cluster, size")] + "SELECT value FROM lloyd WHERE cluster < 0 ORDER BY round").fetchall()]
    assert len(shifts) > 5 and shifts[-1] <= KMEANS_TOL < min(shifts[:-1])


@pytest.mark.parametrize("block_rows", [2, 2048])
def test_a_packed_round(spark, monkeypatch, block_rows):
    """Rows without terms, rows that come twice, a tie and a cluster without members; whatever the blocks and partitions."""
    monkeypatch.setattr(KM, "BLOCK_ROWS", block_rows)
    rows = [(1, [0, 1], [1.0, 2.0]), (2, [1], [3.0]), (2, [1], [3.0]), (3, [0], [1.0]), (4, [], []), (5, [0, 2], [2.0, 2.0]), (None, [2], [1.0])]
    vocab, scaler = X.Vocabulary(("a", "b", "c", "d"), (3, 3, 2, 1), (4, 8, 3, 1), 7), X.Scaler((0.0,) * 4, (1.0,) * 4, (0.5, 2.0, 1.0, 1.0))
    before = Centroids(((1.0, 0.0, 0.0, 0.0), (0.0, 0.4, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 9.0, 7.0)))
    x, old = np.array([KM._vector({"_ids": r[1], "_counts": r[2]}, vocab, scaler) if r[1] else (0.0,) * 4 for r in rows]), np.array(before.values)
    near = ((x[:, None] - old[None]) ** 2).sum(axis=2).argmin(axis=1)
    want = np.stack([x[near == j].mean(axis=0) if (near == j).any() else old[j] for j in range(4)])
    assert not (near == 2).any() and not (near == 3).any()
    for parts in (1, 3, 12):
        sparse = spark.createDataFrame(rows, "doc_id long, _ids array<int>, _counts array<double>").repartition(parts)
        blocks = KM.packed(sparse, vocab, scaler)
        np.testing.assert_allclose(np.array(KM.moved(blocks, before).values), want, atol=1e-12)
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
    assert KM.packed(sparse, vocab, scaler).count() >= (len(rows) + block_rows - 1) // block_rows


def test_articles_without_a_vocabulary(spark):
    articles = spark.createDataFrame([(i, None, f"only{chr(97 + i)} word{chr(97 + i)}", i == 1) for i in range(4)], "doc_id bigint, title string, text string, is_fake boolean")
    model, scores = ClusterDetector.fit(articles.withColumn("title", articles.text), k=3, min_df=2)
    assert len(model.vocab) == 0 and model.settled and scores.count() == 4
