import numpy as np
import pytest

from tidewell.operators import vector_index
from tidewell.operators.knn import KnnError, VectorTables, knn, rewrite
from tidewell.plans.pipeline import Engine
from tidewell.sources.context import Source

SCHEMA = "id long, v array<float>, tag string"


@pytest.fixture(scope="module")
def groups(spark):
    """4,000 vectors of 32 dimensions: a third of them in one group, the rest in 59 others."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32)) * 4
    of = np.where(np.arange(4000) % 3 == 0, 0, rng.integers(1, 60, 4000))
    x = (centres[of] + rng.normal(size=(4000, 32))).astype(np.float32)
    rows = [(i, [float(a) for a in v], "ab"[i % 2]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache(), x


def nearest(x, q, metric, k=10):
    x, q = x.astype(float), np.asarray(q, float)
    far = ((x - q) ** 2).sum(axis=1) if metric == "l2" else 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return set(np.lexsort((np.arange(len(x)), far))[:k].tolist())


def test_recall_in_groups(spark, groups, tmp_path):
    df, x = groups
    for metric in ("l2", "cosine"):
        index = vector_index.build(df, "v", f"{tmp_path}/{metric}", metric)
        assert index.rows.sum() == 4000 and index.table([int(c) for c in index.cells]).count() == 4000
        hits, read = 0, 0
        for i in range(0, 4000, 400):
            q = [float(a) for a in x[i]]
            hits += len(nearest(x, q, metric) & {r.id for r in index.search(q, 10).collect()})
            read += int(index.rows[np.isin(index.cells, index.probed(q, 10))].sum())
        assert hits >= 90 and read <= 0.4 * 10 * 4000


def test_recall_of_evenly_spread_vectors(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vector_index.build(df, "embedding", f"{tmp_path}/even")
    queries = df.filter("vec_id % 100 = 0").collect()
    hits = 0
    for r in queries:
        want = {y.vec_id for y in knn(df, "embedding", r.embedding, 10).collect()}
        hits += len(want & {y.vec_id for y in index.search(r.embedding, 10).collect()})
    assert hits >= 0.9 * 10 * len(queries)


def test_all_cells_give_the_exact_search(spark, groups, tmp_path):
    df, x = groups
    odd = [(5000, None, "a"), (5001, [1.0, 2.0], "a"), (5002, [float("nan")] * 32, "b"), (5003, [0.0] * 32, "b"), (5004, [None] * 32, None), (5005, [], "a")]
    df = df.unionByName(spark.createDataFrame(odd, SCHEMA))
    for metric in ("l2", "cosine"):
        index = vector_index.build(df, "v", f"{tmp_path}/{metric}", metric)
        assert index.rows.sum() == 4006
        every = len(index.cells)
        for q, k in (([float(a) for a in x[7]], 20), ([1.0, 2.0], 3), ([0.0] * 32, 3), ([float(a) for a in x[1]], 5000)):
            got, want = index.search(q, k, probes=every), knn(df, "v", q, k, metric=metric)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_filter_reads_on_until_k_rows_pass(spark, groups, tmp_path):
    df, x = groups
    index = vector_index.build(df, "v", f"{tmp_path}/l2")
    q = [float(a) for a in x[0]]
    got = [r.id for r in index.search(q, 3, "id IN (5, 1001, 3998)", probes=1).collect()]
    assert got == [r.id for r in knn(df, "v", q, 3, "id IN (5, 1001, 3998)").collect()]


def test_sql_reads_the_index(spark, groups, tmp_path):
    df, x = groups
    df.write.parquet(f"{tmp_path}/table")
    index = vector_index.build(df, "v", f"{tmp_path}/index")
    engine = Engine(spark, [Source("near", "vectors", path=f"{tmp_path}/table", options={"index": f"{tmp_path}/index"})])
    literal = ", ".join(f"{a:.9e}" for a in x[8])
    call = f"SELECT k.id, k.tag, k._distance FROM knn('near', 'v', [{literal}], 10) AS k"
    found = engine.sql(call)
    assert all("__cell=" in f for f in found.inputFiles()) and len(found.inputFiles()) <= len(index.table([int(c) for c in index.cells]).inputFiles())
    want = index.search([float(a) for a in x[8]], 10)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
    filtered = engine.sql(call.replace("10) AS", "10, 'id < 50') AS"))
    assert not any("__cell=" in f for f in filtered.inputFiles()) and filtered.count() == 10


def test_what_has_no_index(spark, groups, tmp_path):
    df, _ = groups
    with pytest.raises(KnnError):
        vector_index.build(df, "v", f"{tmp_path}/dot", "dot")
    with pytest.raises(KnnError):
        vector_index.build(df.withColumn("__cell", df.id), "v", f"{tmp_path}/clash")
    index = vector_index.build(df.limit(0), "v", f"{tmp_path}/empty")
    assert index.rows.sum() == 0 and index.search([1.0] * 32, 3).count() == 0
    tables = VectorTables()
    with pytest.raises(KnnError):
        tables.register("t", "cosine", index)
    tables.register("t", "l2", index)
    df.limit(0).createOrReplaceTempView("t")
    assert spark.sql(rewrite(spark, "SELECT * FROM knn('t', 'v', array(1.0), 2) AS k", tables)).count() == 0
