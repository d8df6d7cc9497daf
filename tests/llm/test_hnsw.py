import numpy as np

from kinweave.llm import hnsw

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score string"


def exact(ids, x, own, q, k=10):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_on_clusters_with_copies(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 16))
    x = (centre[rng.integers(0, 8, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:900] = x[500]  # equal rows
    x[900:1500] = x[900] + 0.01 * rng.normal(size=(600, 16)).astype(np.float32)  # one dense heap
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in hnsw.neighbours(df, df.where("vec_id % 50 = 0"), shard_rows=800).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    full, hits, ids = x.astype(np.float64), 0, np.arange(3000)
    for q in range(0, 3000, 50):
        want = exact(ids, full, q, full[q])
        hits += len({i for i, _ in want} & {i for i, _ in got[q]})
        assert all(abs(np.sqrt(((full[i] - full[q]) ** 2).sum()) - s) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (r[1], r[0]))
    assert hits / 600 >= 0.95
    assert [i for i, _ in got[550]] == list(range(500, 510))  # ties go to the smaller ids


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (100, [1.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = [tuple(r) for r in hnsw.neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, _, v, _ in got] == [(100, 1), (100, 2)] and got[0][3] == 0.0
    assert hnsw.neighbours(df.limit(0), df.limit(0)).collect() == []


def test_flat_arrays_come_back():
    rng = np.random.default_rng(2)
    g = hnsw.Graph.build(np.arange(300), rng.normal(size=(300, 8)))
    h = hnsw.Graph.of(g.row(), 8)
    assert g.search(g.vectors[7], -1, 10, 60) == h.search(h.vectors[7], -1, 10, 60)


def recall(g, x, queries, beam=100):
    ids = np.arange(len(x))
    hits = 0
    for q, got in zip(queries, g.search_all(x[queries], np.array(queries), 10, beam)):
        hits += len({i for i, _ in exact(ids, x, q, x[q])} & {i for _, i in got})
    return hits / 10 / len(queries)


def test_insertion_makes_the_graph(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 12))
    queries = list(range(0, 2000, 40))
    g = hnsw.Graph.build(np.arange(2000), x)
    assert len(g.sizes) > 1 and recall(g, g.vectors[np.argsort(g.ids)], queries) > 0.97
    for level, links in enumerate(g.links):
        assert links.max() < g.sizes[level] and len(links) == g.sizes[level]
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() and i not in r for i, r in enumerate(links))
    monkeypatch.setattr(hnsw.Graph, "_answer", lambda self, links, out, lo: None)  # without links back the first nodes lead nowhere
    one_way = hnsw.Graph.build(np.arange(2000), x)
    assert recall(one_way, x, queries) < 0.5


def test_values_of_any_size(spark):
    rows = [(100, [1e300, 0.0]), (1, [-1e300, 0.0]), (2, [1e-300, 1e300]), (3, [1e308, 1e308]), (200, [1e-5, 0.0])]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA.replace("float", "double"))
    got = hnsw.neighbours(df, df.where("vec_id % 100 = 0")).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [200, 2, 1, 3] and all(np.isfinite(r.score) for r in got)
    assert got[2].score == 2e300


def test_a_repeated_id_with_another_vector_is_another_query(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = sorted((r.rank, r.vec_id) for r in hnsw.neighbours(df, df.where("vec_id % 100 = 0")).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_every_graph_travels_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0, "") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 7)  # many blocks of queries, several shards
    got = hnsw.neighbours(df, df.where("vec_id % 3 = 0"), k=4, shard_rows=200)
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    hits, found = 0, {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 900, 3):
        hits += len({i for i, _ in exact(np.arange(900), x, q, x[q])[:4]} & found[q])
    assert hits / 1200 > 0.97
    one = hnsw.neighbours(df, df.where("vec_id % 300 = 0"), k=4, shard_rows=100_000)
    assert one.count() == 12
