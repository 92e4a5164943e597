"""Designs on clustering features against the dense method, and the selection against all choices."""

from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest

from hyposcape.operators import summaries
from hyposcape.operators.kernels import Kernel, distances
from hyposcape.operators.solver import median_of

SCHEMA = "dataset string, id bigint, v array<double>"


def blobs(seed: int, n: int, dims: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(m, 0.5, size=(n, dims)) for m in (0.0, 4.0, 9.0)])


def frame(spark, x: np.ndarray, name: str = "a"):
    return spark.createDataFrame(pd.DataFrame({"dataset": name, "id": np.arange(len(x)), "v": list(x)}), SCHEMA)


def dense_pick(x: np.ndarray, n_pick: int, min_size: int) -> np.ndarray:
    """Every cut in turn on the whole distance matrix."""
    d = distances(x, x, True)
    k = Kernel("rbf", median_of(d)).of_distance(d)
    merges = summaries.ward_merges(np.clip(1 - k, 0, None))
    best = None
    for cut in range(2, len(k) // min_size + 1):
        labels = summaries.cut_tree(merges, len(k), cut)
        valid = np.flatnonzero(np.bincount(labels) >= min_size)
        if len(valid) >= n_pick and (best is None or len(valid) > len(best[1])):
            best = labels, valid
    labels, valid = best
    centre = {c: k[labels == c].mean(0) for c in valid}
    picked = [max(valid, key=lambda c: (labels == c).sum())]
    while len(picked) < n_pick:
        picked.append(max((c for c in valid if c not in picked), key=lambda c: min(np.linalg.norm(centre[c] - centre[s]) for s in picked)))
    out = np.full(len(x), -1)
    for i, c in enumerate(picked):
        out[labels == c] = i
    return out


def test_weighted_merges_equal_merges_of_repeated_rows():
    x, w = np.random.default_rng(1).normal(size=(12, 2)), np.array([1, 3, 2, 1, 1, 4, 1, 2, 1, 1, 5, 1])
    short = summaries.ward_merges(distances(x, x, True), w)[:, 2]
    rows = np.repeat(x, w, axis=0)
    long = summaries.ward_merges(distances(rows, rows, True))[:, 2]
    assert np.allclose(short, long[-11:]) and np.allclose(long[:-11], 0, atol=1e-6)
    merges = summaries.ward_merges(distances(x, x, True), w)
    large = summaries.large_clusters(merges, w, 4)
    for cut in range(1, 13):
        assert large[cut] == (np.bincount(summaries.cut_tree(merges, 12, cut), w) >= 4).sum()


def test_weighted_median_equals_median_of_repeats():
    rng = np.random.default_rng(2)
    for n in (1, 4, 5, 9):
        v, w = rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n)
        assert summaries.weighted_median(v, w) == np.median(np.repeat(v, w))


def test_ward_selection_equals_dense_and_holds_on_summaries(spark):
    x = blobs(3, 60)
    both = frame(spark, x).unionByName(frame(spark, blobs(4, 40), "b"))
    got = summaries.ward_selection(both, min_size=20).toPandas().sort_values(["dataset", "id"])
    a = got[got.dataset == "a"]
    assert (a.selected.to_numpy() == dense_pick(x, 2, 20)).all() and np.allclose(a.spread, 0, atol=1e-6)
    assert (got[got.dataset == "b"].selected.to_numpy() == dense_pick(blobs(4, 40), 2, 20)).all()
    few = summaries.ward_selection(frame(spark, x), n_pick=3, min_size=40, most=30).toPandas().sort_values("id")
    assert len(few) == 180 and few.spread.max() > 0
    assert all(len(set(few.selected[i : i + 60])) == 1 for i in (0, 60, 120)) and set(few.selected) == {0, 1, 2}


def test_ward_selection_repeated_rows_and_missing_vectors(spark):
    """A third of the rows are equal; a row without a vector takes no part; too large a minimum raises."""
    x = np.concatenate([np.zeros((50, 2)), blobs(5, 35, 2) + 3])
    df = frame(spark, x).unionByName(spark.createDataFrame([("a", 999, None)], SCHEMA))
    got = summaries.ward_selection(df, min_size=20).toPandas()
    assert len(got) == len(x) and len(set(got[got.id < 50].selected)) == 1
    with pytest.raises(Exception, match="no cut has"):
        summaries.ward_selection(df, min_size=100).collect()
    assert summaries.ward_selection(df.where("id < 0")).count() == 0


def test_similarity_selection_near_the_largest_objective(spark):
    x = np.random.default_rng(6).normal(size=(14, 2))
    d = distances(x, x, True)
    k = Kernel("rbf", median_of(d)).of_distance(d)
    np.fill_diagonal(k, 0)

    def value(rows, lab):
        sub, lab = k[np.ix_(rows, rows)], np.array(lab)
        same = lab[:, None] == lab[None]
        return sub[same].sum() / 2 - sub[~same].sum() / 4

    best = max(value(r, lab) for r in combinations(range(14), 5) for lab in product((0, 1), repeat=5) if lab[0] == 0 and sum(lab) > 0)
    got = summaries.similarity_selection(frame(spark, x), 5, 2).toPandas()
    reached = got.objective.iloc[0]
    assert len(got) == 5 and reached == pytest.approx(value(got.id.to_numpy(), got.cluster.to_numpy()))
    assert 0.8 * best <= reached <= best + 1e-9


def test_similarity_selection_ends_where_no_exchange_gains(spark):
    """Two datasets, blocks of few rows: no single row gains more than the weakest member."""
    x = blobs(7, 60)
    both = frame(spark, x).unionByName(frame(spark, blobs(8, 20), "b"))
    got = summaries.similarity_selection(both, 12, 3).toPandas()
    assert got.groupby("dataset").size().to_dict() == {"a": 12, "b": 12} and not got.duplicated(["dataset", "id"]).any()
    sel = got[got.dataset == "a"]
    d = distances(x, x, True)
    st = summaries.Selection(Kernel("rbf", median_of(d)), 3)
    st.rows = {i: (x[i], c) for i, c in zip(sel.id, sel.cluster)}
    out, own = st.weakest()
    st.rows.pop(out)
    assert st.best_of(dict(enumerate(x)))[0] <= own + 1e-9


class Local:
    """Stands for joined blocks; the function of a pass runs here, where its memory can be seen."""

    def __init__(self, rows: list[dict]):
        self.rows = rows

    def mapInPandas(self, fn, schema):
        return pd.concat(fn(iter([pd.DataFrame(self.rows)])))


def test_passes_over_blocks_hold_few_rows_at_once(monkeypatch):
    """A block of 4,096 rows against 2,000 centres: 65 MB of distances if held whole, with two or more such arrays."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(4096, 3)), rng.normal(size=(2000, 3))
    row = {"ids": np.arange(4096), "x": x.ravel(), "m": 2000, "c": c.ravel()}
    monkeypatch.setattr(summaries, "attach", lambda blocks, features, by: Local([row]))
    tracemalloc.start()
    got = summaries.assign(Local([]), (), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got.s.to_numpy() == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    assert peak < 40e6


def test_median_distance_of_weighted_rows():
    """Summaries that stand for copies: the median of all pairs of the rows."""
    rng = np.random.default_rng(4)
    mean, n = rng.normal(size=(40, 3)), rng.integers(1, 6, 40)
    rows = np.repeat(mean, n, axis=0)
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))[np.triu_indices(len(rows), 1)]
    assert np.isclose(summaries.median_distance(mean, n, np.zeros(40)), np.median(d))
    assert summaries.median_distance(mean[:1], np.array([1]), np.zeros(1)) == 0.0
