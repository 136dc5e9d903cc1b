"""Near-duplicate vectors against all cosines in double precision."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import vector_join
from wayfarer.llm.queries import ORACLE_SQL


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs."""
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for length in {len(rows[k][1]) for k in fine}:
        at = [k for k in fine if len(rows[k][1]) == length]
        v = np.array([rows[k][1] for k in at], float)
        v /= np.abs(v).max(1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for i, js in enumerate(v @ v.T >= cosine):
            for j in np.flatnonzero(js):
                if i < j:
                    n[at[i]] += 1
                    n[at[j]] += 1
                    a, b = find(at[i]), find(at[j])
                    root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k))
        yield i, n[k], c, None if i is None or c is None else i == c


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def cloud(seed, dim=16):
    """Random vectors, pairs about the limit, a group of copies, a group of near copies in which some are not linked."""
    r = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    v = unit(r.normal(size=(120, dim)))
    near = [unit(c * v[:60] + np.sqrt(1 - c * c) * unit(r.normal(size=(60, dim)))) for c in (0.89, 0.93)]
    copies, centre = np.repeat(v[:1], 30, 0), unit(r.normal(size=dim))
    group = unit(centre + r.uniform(0.1, 0.55, (90, 1)) * unit(r.normal(size=(90, dim))))
    return [(int(k), [float(np.float32(x)) for x in row]) for k, row in enumerate(np.concatenate([v, *near, copies, group, 3 * group[:5]]))]


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [None, *[1.0] * 15]), (904, [float("nan"), *[1.0] * 15]), (905, [float("inf"), *[1.0] * 15]), (906, [1.0]), (907, [2.0]), (908, [-1.0]), (None, [5.0] * 16), (None, [5.0] * 16), (909, [5.0] * 16), (909, [-0.0] * 15 + [1.0]), (None, None)]


@pytest.mark.parametrize(("seed", "kind", "block"), [(0, "float", 2048), (1, "double", 16), (2, "float", 8)])
def test_against_all_pairs(spark, monkeypatch, seed, kind, block):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    monkeypatch.setattr(vector_join, "ASKING", 4 * block)
    monkeypatch.setattr(vector_join, "REACH", 4.0)  # all lists within reach: no pair may be lost, counted twice or made up
    rows = cloud(seed) + ODD
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(0) for c in ("label", "k1", "cid", "uid", "cell", "vec", "n", "copies", "links", "a", "b")}).repartition(3)
    assert got(vector_join.near_vectors(df)) == sorted(plain(rows), key=str)


def test_no_vector(spark):
    for rows in ([], ODD[:6]):
        assert got(vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == sorted(plain(rows), key=str)


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e-320, 0.0]), (4, [1.0, 0.0])]
    assert got(vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == sorted(plain(rows), key=str)


def test_recall_with_the_registered_parameters(spark):
    """Pairs at 0.90 to 0.97 amid vectors in 64 dimensions: nothing made up, and nearly nothing lost."""
    r = np.random.default_rng(5)
    v = r.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c, w = r.uniform(0.9, 0.97, (3000, 1)), r.normal(size=(3000, 64))
    w -= (w * v).sum(1, keepdims=True) * v
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    rows = [(k, x.tolist()) for k, x in enumerate(np.concatenate([v, c * v + np.sqrt(1 - c * c) * w]))]
    found = {x[0]: x for x in got(vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))}
    want = list(plain(rows))
    assert all(found[i][1] <= n for i, n, _, _ in want)
    assert sum(x[1] for x in found.values()) >= 0.99 * sum(x[1] for x in want)


def test_codes_are_off_by_no_more_than_they_say():
    r = np.random.default_rng(3)
    v = r.normal(size=(500, 10))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lists = vector_join.Lists(v, 500, 0)
    home = int(lists.home(v)[0])
    codes, off = lists.codes(v, home)
    assert (np.abs(lists.looked_up(v[:50], home, codes) - v[:50] @ v.T) <= off + 1e-12).all()


def test_sql(spark):
    rows = cloud(7)[:200] + ODD[:3] + ODD[6:8] + [(909, [5.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    embeddings = df.toPandas()  # noqa: F841  DuckDB reads it by its name
    found = duckdb.sql(ORACLE_SQL["op12_embedding_near_dedup"])
    names = ["vec_id", "n_links", "component_id", "kept"]
    want = sorted((tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall()), key=str)
    assert want == sorted(plain(rows), key=str) == got(vector_join.near_vectors(df))
