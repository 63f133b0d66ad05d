import numpy as np

from feedspan.llm.embeddings import SAFE_VISITS, embedding_duplicates, enough_visits, fit, lower_bound, ranks, visits


def brute(rows, least=0.98):
    ok = []
    for i, (_, v, y) in enumerate(rows):
        if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(i)
    links, parent = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ok):
        a = np.array(rows[i][1], dtype=np.float64)
        for j in ok[:n]:
            b = np.array(rows[j][1], dtype=np.float64)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {r[0]: (links[i], rows[find(i)][0]) for i, r in enumerate(rows)}


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, links int, node string")


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(2)
    x, books = rng.normal(size=(40, 6)), (rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    d = ((x[:, None, :3] - books[0]) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - books[1]) ** 2).sum(2)[:, None, :]
    want = np.argsort(d.reshape(40, -1), axis=1)[:, :6]
    assert (visits(x, books, 6) == want).all()


def test_planted_groups_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, vec_id = [], 0
    for _ in range(40):
        centre = rng.normal(size=16)
        for k in range(int(rng.integers(1, 9))):
            noise = rng.choice([0.0, 0.02, 0.05])
            rows.append((vec_id, (centre + noise * rng.normal(size=16)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            vec_id += 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_recall_on_whole_table(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = embedding_duplicates(data).toPandas().set_index("vec_id")
    table = data.toPandas()
    x = np.stack(table.embedding.to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (table.label.to_numpy()[:, None] == table.label.to_numpy()[None, :])
    want = near.sum(1) - 1
    have = got.loc[table.vec_id].n_links.to_numpy()
    assert len(got) == len(table) and (have <= want).all() and have.sum() >= 0.9 * want.sum()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1),
        (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1),
        (11, [1.0, 0.0], 1), (12, [1.0], 1), (13, [-0.0, 3.0], 1), (14, [0.0, 3.0], 1),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}
    assert got[0][0] == 2
    assert embedding_duplicates(frame(spark, [])).count() == 0
    assert embedding_duplicates(frame(spark, [(1, None, None)])).first().kept
    twice = embedding_duplicates(frame(spark, [(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)])).collect()
    assert [r.n_links for r in twice] == [2, 2, 2] and {r.component_id for r in twice} == {3}


def test_visits_rest_on_pairs_of_the_whole_table(spark):
    """A small sample holds hardly a pair; the queries' pairs with all rows do."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 60, axis=0) + 0.12 * rng.normal(size=(3600, 16))
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x[rng.permutation(len(x))])]
    got = embedding_duplicates(frame(spark, rows), sample=200).agg({"n_links": "sum"}).first()[0]
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert got >= 0.97 * ((x @ x.T >= 0.98).sum() - len(x))


def test_few_pairs_leave_a_safe_number_of_visits(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 1) for i in range(400)]
    rows.append((400, [v * 1.001 + 1e-6 for v in rows[0][1]], 1))
    assert fit(frame(spark, rows), 0.98)[16][2] >= SAFE_VISITS


def test_more_visits_than_at_first_and_bounds():
    found = np.array([[q, 40 if q == 3 else 1, 5] for q in range(200)], dtype=float)
    assert enough_visits(found, 16, 1.0) is None and enough_visits(found, 64, 1.0) == 40
    assert enough_visits(found, 16, 0.99) == 1
    assert 0.97 < lower_bound(1.0, 100) < 0.98 and lower_bound(1.0, 0) == 0
    assert ranks(np.array([[1, 2, 3]]), np.array([[9, 3, 8]])).tolist() == [3]
    assert ranks(np.array([[1, 2, 3]]), np.array([[7, 8, 9]])).tolist() == [4]
