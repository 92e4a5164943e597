"""Whitening and vector codes against plain versions, with odd vectors, ties, repeats and empty tables."""

import collections
from fractions import Fraction

import numpy as np
import pytest

from hyposcape.llm import vector_codes, vectors, whitening
from hyposcape.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x double, component long"
NAN, INF = float("nan"), float("inf")


def odd_rows(n=700, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    base = (rng.normal(size=(n, dim)) * np.linspace(0.05, 1, dim)).astype(np.float32)
    base[n // 2 :] = base[: n - n // 2]  # copies
    rows = [(i * 2, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(base)]
    rows += [(1, None, 1), (3, [], 1), (5, [None] * dim, 1), (7, [NAN] * dim, None), (9, [INF] + [0.0] * (dim - 1), 2), (11, [1.0] * (dim - 1), 0)]
    rows += [rows[4], rows[4], (None, [0.25] * dim, None), (None, [-0.0] * dim, 2)]
    return [(*r, "c", 0.5, 7) for r in rows]


def kept(rows, dim=8):
    return [r for r in rows if r[1] and len(r[1]) == dim and all(c is not None and np.isfinite(c) for c in r[1])]


# ---- integers


def test_limb_products_are_exact():
    rng = np.random.default_rng(0)
    for top in (5, 1 << 20, 1 << 27):
        a, b = rng.integers(-top, top + 1, (40, 16)), rng.integers(-top, top + 1, (30, 16))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert vectors.exact_products(a, b).tolist() == want
        assert (sum(part.astype(np.int64) << (7 * k) for k, part in enumerate(vectors.limbs(a, 7))) == a).all()
    assert vectors.exact_products(np.zeros((2, 3), np.int64), a[:, :3]).tolist() == [[0] * 40] * 2
    assert vectors.floored(np.array([[-0.1, 3e38, -1e308]]), 1024, 100).tolist() == [[-100, 100, -100]]


def test_gram_sums_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 31):
        y = rng.integers(-top, top + 1, (50, 4))
        got = whitening.gram_sums(y)
        for i in range(4):
            for j in range(4):
                assert sum(int(g[i, j]) << (16 * k) for k, g in enumerate(got)) == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True))


# ---- eigenvectors


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(2).uniform(1, 100, 40),
        [7.0] * 5 + [3.0] * 4 + [1.0],
        [100, 100 - 1e-10, 100 - 2e-10, 90, 1, 1 + 1e-14],
        [100, 100 * (1 - 1e-6), 50, 0, 0],
        10.0 ** -np.arange(0, 16, 0.5),
        [4.0],
    ],
)
def test_refined_axes(values):
    """Residual and orthogonality far below double precision; separated vectors are the ones the matrix was made of."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d) - q.T @ q / 2)
    made = np.array(values, np.longdouble)
    a = (q * made) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    size = np.abs(a).max()
    assert np.abs(a @ x - x * found).max() < 1e-17 * size and np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    assert np.abs(found - np.sort(made)[::-1]).max() < 1e-17 * size * d
    order = np.argsort(-made)
    alone = [k for k in range(d) if all(abs(made[order[k]] - m) > 1e-7 * size for i, m in enumerate(made) if i != order[k])]
    dots = np.abs((q[:, order] * x).sum(0))
    assert all(abs(dots[k] - 1) < 1e-9 for k in alone)


def test_refinement_needs_its_steps():
    """Single-precision vectors alone are far from it."""
    a = np.cov(np.random.default_rng(1).normal(size=(20, 200)))
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    values, x = whitening.refine(a, start)
    assert np.abs(start.T @ start - np.eye(20)).max() > 1e-8 > 1e-14 > np.abs(x.T @ x - np.eye(20)).max()
    assert np.allclose(np.sort(values), np.linalg.eigvalsh(a), rtol=1e-13)


# ---- whitening


def brute_whitening(rows):
    x = {r: [int(np.floor(256 * np.float64(c))) for c in np.array(r[1], np.float32)] for r in map(lambda r: (r[0], tuple(r[1])), rows)}
    fit = sorted({tuple(v) for v in x.values()})
    n, dim = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(dim)]
    y = [[Fraction(v[k]) - Fraction(s[k], n) for k in range(dim)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(dim)] for i in range(dim)])
    return x, n, s, cov


def test_whitening_matches_fractions(spark):
    given = odd_rows(300)
    table = spark.createDataFrame(given, SCHEMA).repartition(3)
    got = whitening.whitened(table).collect()
    rows = kept(given)
    x, n, s, cov = brute_whitening(rows)
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["vec_id"], r["component"]].append(r)
    sign = {}
    for r in rows:
        v = x[r[0], tuple(r[1])]
        away = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        for k in range(4):
            want = float((np.array(v) - np.array(s) / n) @ w[:, k] / np.sqrt(e[k]))
            near = [q for q in by_id[r[0], k + 1] if q["deviation"] == away]
            assert near and all(abs(q["explained"] - e[k] / cov.trace()) < 1e-12 for q in near)
            sign.setdefault(k, 1 if abs(near[0]["whitened"] - want) < abs(near[0]["whitened"] + want) else -1)
            assert min(abs(q["whitened"] * sign[k] - want) for q in near) < 1e-10
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-12
    again = whitening.whitened(table.repartition(5)).collect()
    plain = lambda t: sorted((str(r["vec_id"]), r["component"], r["deviation"], r["whitened"], r["explained"]) for r in t)
    assert plain(again) == plain(got)  # the covariance is exact, so partitions change nothing


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None)], "vec_id long, embedding array<double>")
    got = whitening.whitened(one).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(got)] == [
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)
    ]
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitened(flat).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and len(got) == 27
    assert {round(r["explained"], 9) for r in got if r["component"] == 1} == {1.0} and got[0]["identity_error"] < 1e-12
    huge = spark.createDataFrame([(i, [1e30 * i, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert whitening.whitened(huge).count() == 6
    empty = spark.createDataFrame([(3, None)], "vec_id long, embedding array<double>")
    assert whitening.whitened(empty).count() == 0 == whitening.whitened(empty.limit(0)).count()
    assert whitening.whitened(empty).columns == whitening.whitened(flat).columns


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 30, 0], [1, 2]])
    n, sums = 1 << 20, ((1 << 30) + 1, 2)
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening.deviations(x, n, sums).to_pylist() == [w if w < 1 << 63 else None for w in want]
    assert whitening.deviations(x, 3, sums).to_pylist() == [sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


# ---- codes


def brute_codes(rows, entries=256, rounds=4, parts=4):
    """Plain Python integers; rows ordered as the first codebook takes them."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(1024 * np.float64(c))) for c in np.array(r[1], np.float32)] for r in rows]
    d = len(x[0])
    cut = [k * d // parts for k in range(parts + 1)]
    books = [[v[a:b] for v in x[:entries]] for a, b in zip(cut, cut[1:], strict=False)]

    def assign(k):
        out = []
        for v in x:
            part = v[cut[k] : cut[k + 1]]
            apart = [sum((p - q) ** 2 for p, q in zip(part, e, strict=True)) for e in books[k]]
            best = min(range(len(apart)), key=lambda j: (apart[j], j))
            out.append((best, apart[best]))
        return out

    for _ in range(rounds):
        for k in range(parts):
            groups = collections.defaultdict(list)
            for v, (e, _) in zip(x, assign(k), strict=True):
                groups[e].append(v[cut[k] : cut[k + 1]])
            for e, members in groups.items():
                books[k][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    final = [assign(k) for k in range(parts)]
    codes = ["".join(f"{final[k][i][0]:02x}" for k in range(parts)) for i in range(len(x))]
    errors = [sum(final[k][i][1] for k in range(parts)) for i in range(len(x))]
    by_label = collections.Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    import hashlib

    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True)]


@pytest.mark.parametrize("entries", [256, 12])
def test_codes_match_plain_integers(spark, entries):
    given = odd_rows(400)
    got = vector_codes.coded(spark.createDataFrame(given, SCHEMA).repartition(4), entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_codes(kept(given), entries))


def test_codes_of_odd_tables(spark):
    rows = [(2, [0.5, -0.25, 1.0, 0.0, 3.0], None), (1, [0.5, -0.25, 1.0, 0.125, 3.0], None), (1, [0.5, -0.25, 1.0, 0.125, 3.0], 4)]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert collections.Counter(map(tuple, vector_codes.coded(few).collect())) == collections.Counter(brute_codes(rows))
    huge = spark.createDataFrame([(i, [1e300 * i, 1.0, -1e300, 0.0], "text") for i in range(3)], "vec_id long, embedding array<double>, label string")
    assert vector_codes.coded(huge).count() == 3
    none = few.where("vec_id > 9")
    assert vector_codes.coded(none).count() == 0 and vector_codes.coded(none).columns == vector_codes.coded(few).columns


def test_codes_sql_on_odd_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(odd_rows(400), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLE["op12_vector_codes"]).fetchall()
    got = [tuple(r) for r in QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()]
    assert collections.Counter(got) == collections.Counter(want) and len(got) > 400
