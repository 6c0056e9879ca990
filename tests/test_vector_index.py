import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.guard import Refused
from lodestrata.operators import retrieval, vector_index


def clustered(seed, n, width=24, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    rows = centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, width))
    rows[5], rows[6] = 0, rows[7]  # a zero vector, two alike
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1, 3000))] + [(9999, None)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("chunk_id % 20 = 0 or chunk_id in (5, 6)").select(F.col("chunk_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vector_index.build(vectors, f"file://{tmp_path_factory.mktemp('vectors')}/x")


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def test_exact_search_is_the_scan_and_prunes(spark, vectors, asked, index):
    some, every = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = rows_of(vector_index.search_exact(index, asked, 50, multiplied=some, all_pairs=every))
    assert got == rows_of(retrieval.dense(vectors, asked, 50))
    assert 0 < some.value < 0.5 * every.value


@pytest.mark.parametrize(("depth", "probes"), [(1, 1), (5, 2), (4000, 1)])
def test_exact_search_at_other_depths(vectors, asked, index, depth, probes):
    few = asked.limit(12) if depth > 100 else asked
    assert rows_of(vector_index.search_exact(index, few, depth, probes)) == rows_of(retrieval.dense(vectors, few, depth))


def test_recall_of_the_approximate_search(vectors, asked, index):
    exact = retrieval.dense(vectors, asked.where("query_id <> 5"), 50)
    found = vector_index.recall(vector_index.search(index, asked, 50), exact)
    assert found.agg(F.avg("recall")).first()[0] >= 0.9


def test_every_vector_is_indexed_and_in_its_nearest_cell(vectors, index):
    vector_index.unassigned(index, vectors)
    with pytest.raises(Refused, match="not in the index"):
        vector_index.unassigned(vector_index.VectorIndex(index.vectors.where("chunk_id <> 17"), index.cells, index.codebook), vectors)
    assert index.vectors.count() == 3000
    numbers, centres, radii = vector_index._cells(index)
    for r in index.vectors.where("chunk_id % 100 = 1").collect():
        unit = np.array(r["embedding"]) / np.linalg.norm(r["embedding"])
        distance = np.linalg.norm(centres - unit, axis=1)
        assert numbers[distance.argmin()] == r["cell"] and abs(distance.min() - r["apart"]) < 1e-6 <= radii[distance.argmin()]
    assert index.vectors.where("cell = -1").count() == 1


def test_a_sample_fits_the_cells_but_all_are_assigned(vectors, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE", 300)
    small = vector_index.build(vectors, f"file://{tmp_path}/x", cells=9)
    assert small.vectors.count() == 3000 and small.cells.count() <= 9
    assert rows_of(vector_index.search_exact(small, asked, 50)) == rows_of(retrieval.dense(vectors, asked, 50))


def test_blocks_of_queries(vectors, asked, index, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK_BYTES", 24 * 8 * 40)
    assert rows_of(vector_index.search_exact(index, asked, 10)) == rows_of(retrieval.dense(vectors, asked, 10))


def test_nothing_and_other_widths(spark, tmp_path):
    schema = "chunk_id string, embedding array<float>"
    none = vector_index.build(spark.createDataFrame([("a", None)], schema), f"file://{tmp_path}/none")
    question = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<float>")
    assert vector_index.search(none, question).collect() == [] == vector_index.search_exact(none, question).collect()
    one = vector_index.build(spark.createDataFrame([("a", [0.0, 2.0]), ("b", [1.0, 0.0])], schema), f"file://{tmp_path}/one")
    assert [(r["chunk_id"], r["score"]) for r in vector_index.search_exact(one, question).orderBy("rank").collect()] == [("b", 0.0), ("a", 1.0)]
    assert vector_index.search_exact(one, question.where("query_id = 2")).collect() == []
    with pytest.raises(Refused):
        vector_index.build(spark.createDataFrame([("a", [0.0, 2.0]), ("b", [1.0])], schema), f"file://{tmp_path}/two")


def test_blocks_of_queries_are_bounded_and_each_is_searched_once(spark, tmp_path, monkeypatch):

    points = np.random.default_rng(4).normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "chunk_id long, embedding array<double>")
    asked = vectors.where("chunk_id < 90").withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(vectors, f"{tmp_path}/blocks")
    monkeypatch.setattr(vector_index, "MOST_ASKED", 40)
    blocks = [ids for _, ids, _ in vector_index._query_blocks(asked)]
    assert len(blocks) == 3 and sorted(q for ids in blocks for q in ids) == list(range(90))
    want = retrieval.dense(vectors, asked, 5)
    assert sorted(map(tuple, vector_index.search_exact(index, asked, 5).collect())) == sorted(map(tuple, want.collect()))
