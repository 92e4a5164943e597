"""Objectives, fits, predictions, cross-validation, cluster designs and whole experiment flows on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expit, hash_uniform
from ..operators import centred, clustering, density, kernels, metrics, sampling, solver, spectrum, summaries, tuning
from ..operators.kernels import BlockKernel, Kernel, Points
from ..operators.solver import GLOBAL_PRESETS, SolverConfig, make_config
from ..plans import experiments
from ..plans.model import SpatialNullEstimator
from ..session import cut_lineage
from ..sources.fixtures import hyp_points, points
from ..sources.tables import status_log as write_status
from ..sources.tables import table
from .registry import POINTS, hash_sql, ppf_sql, query, rnd, uniform_sql

K15 = Kernel("matern", 1.0, 1.5)

# hypotheses on the embeddings with Gaussian-shift densities and the Matern 3/2 kernel matrix
MODEL = f"""{POINTS}, zed AS (SELECT *, {ppf_sql('1e0-least(1e0-1e-10,greatest(1e-10,p))')} AS z FROM pts),
par AS (SELECT avg(z) FILTER (WHERE p<0.2e0) AS mu, stddev_pop(z) FILTER (WHERE p<0.2e0) AS sg FROM zed),
dn AS (SELECT id, v, label, 1e0 AS f0, least(5000e0, exp((z*z-((z-mu)/sg)*((z-mu)/sg))/2e0)/sg) AS f1 FROM zed, par),
km AS MATERIALIZED (SELECT i, j, (1e0+sqrt(3e0)*d)*exp(-sqrt(3e0)*d) AS k FROM (SELECT a.id AS i, b.id AS j,
 CASE WHEN a.id=b.id THEN 0e0 ELSE list_distance(a.v,b.v) END AS d FROM pts a, pts b))"""

FIXED_C = f"cc AS (SELECT *, ({uniform_sql('id', 'coef')}-0.3e0)*0.02e0 AS c FROM dn), st AS (SELECT cc.*, al AS alpha FROM cc JOIN (SELECT i, sum(k*c) AS al FROM km JOIN cc ON cc.id=j GROUP BY 1) ON i=id)"


def densities(spark, sf):
    return density.with_gaussian_shift(hyp_points(spark, sf), by=[])


def fixed_state(spark, sf):
    """Rows (id, f0, f1, c, alpha) for given coefficients: alpha = K c over the whole table."""
    rows = cut_lineage(densities(spark, sf).withColumn("c", (hash_uniform("id", "coef") - 0.3) * 0.02))
    bk = BlockKernel.build(Points.pack(rows.select("id", "v")), K15)
    alpha = bk.matvec(rows.select("id", F.col("c").alias("y"))).withColumnRenamed("y", "alpha")
    out = cut_lineage(rows.select("id", "f0", "f1", "c", "label").join(alpha, "id"))
    bk.release()
    return out


LOSS_CFG = SolverConfig(floor=1e-10)


@query(
    "stage1_loss",
    f"""WITH {MODEL}, {FIXED_C} SELECT round(f,5) AS fit, round(pn,5) AS penalty, round(bd,5) AS bound, n_floored, round(f+pn+bd,5) AS loss FROM (
SELECT sum(-ln(greatest(alpha*f0+(1e0-alpha)*f1,1e-10))) AS f, 10e0*sum(c*alpha) AS pn,
 500e0*sum(pow(greatest(0e0,alpha-1e0),2)+pow(greatest(0e0,-alpha),2)) AS bd, count(*) FILTER (WHERE alpha*f0+(1e0-alpha)*f1<=1e-10) AS n_floored FROM st)""",
)
def stage1_loss(spark, sf):
    out = solver.stage1_loss(fixed_state(spark, sf), LOSS_CFG)
    return out.select(*[rnd(c, 5).alias(c) for c in ("fit", "penalty", "bound", "loss")], "n_floored")


@query(
    "stage1_gradient",
    f"""WITH {MODEL}, {FIXED_C} SELECT id, round(alpha,8) AS alpha, round((f1-f0)/greatest(alpha*f0+(1e0-alpha)*f1,1e-10)+20e0*c
 +1000e0*(greatest(0e0,alpha-1e0)-greatest(0e0,-alpha)),5) AS gradient FROM st""",
)
def stage1_gradient(spark, sf):
    st = fixed_state(spark, sf)
    return st.select("id", rnd("alpha", 8).alias("alpha"), rnd(solver.gradient_column(LOSS_CFG), 5).alias("gradient"))


@query(
    "stage2_loss",
    f"""WITH {MODEL}, {FIXED_C}, s AS (SELECT *, 1e0/(1e0+exp(-least(500e0,greatest(-500e0,alpha)))) AS s,
 (CASE WHEN label=1 THEN 0.9e0 ELSE 0.2e0 END) AS t FROM st)
SELECT round(sum(-(t*ln(s)+(1e0-t)*ln(1e0-s)))+0.1e0*sum(c*alpha),6) AS loss, round(sqrt(sum(pow(s-t+0.2e0*c,2))),6) AS grad_norm FROM s""",
)
def stage2_loss(spark, sf):
    st = fixed_state(spark, sf).withColumnRenamed("alpha", "g")
    st = st.withColumn("target", F.when(F.col("label") == 1, 0.9).otherwise(0.2))
    out = solver.stage2_loss(st, 0.1)
    return out.select(rnd("loss").alias("loss"), rnd("grad_norm").alias("grad_norm"))


def ngd_sql(steps: int) -> str:
    parts = ["s0 AS (SELECT id, f0, f1, 0.005e0 AS c FROM dn)"]
    for t in range(1, steps + 1):
        p = f"s{t - 1}"
        parts.append(f"a{t} AS MATERIALIZED (SELECT i AS id, sum(k*c) AS alpha FROM km JOIN {p} ON {p}.id=j GROUP BY 1)")
        parts.append(
            f"g{t} AS MATERIALIZED (SELECT {p}.*, (f1-f0)/greatest(alpha*f0+(1e0-alpha)*f1,1e-12)+20e0*c"
            f"+1000e0*(greatest(0e0,alpha-1e0)-greatest(0e0,-alpha)) AS g FROM {p} JOIN a{t} USING (id))"
        )
        parts.append(
            f"s{t} AS MATERIALIZED (SELECT id, f0, f1, c-0.0005e0*g*least(1e0,5e0/(SELECT sqrt(sum(g*g)) FROM g{t})) AS c FROM g{t})"
        )
    return ", ".join(parts)


@query("fit_three_steps", f"WITH {MODEL}, {ngd_sql(3)} SELECT id, round(c,9) AS c FROM s3")
def fit_three_steps(spark, sf):
    """Three natural-gradient steps over the whole table with the distributed kernel."""
    cfg = make_config("default", c_init=0.005, max_iter=3)
    return solver.fit_blocks(densities(spark, sf), K15, cfg).select("id", rnd("c", 9).alias("c"))


def centred_sql(steps: int) -> str:
    """Plain-gradient steps of the fit over 100 centres: e<t> pulls of all rows, q<t> gradient, w<t> coefficients."""
    parts = [f"zc AS (SELECT id FROM pts ORDER BY {hash_sql('id', 'sub|42')}, id LIMIT 100)", "w0 AS (SELECT id, 0.005e0 AS c FROM zc)"]
    for t in range(1, steps + 1):
        p = f"w{t - 1}"
        parts.append(f"e{t} AS MATERIALIZED (SELECT i AS id, sum(k*c) AS a FROM km JOIN {p} ON {p}.id=j GROUP BY 1)")
        parts.append(
            f"p{t} AS MATERIALIZED (SELECT dn.id, a, (f1-f0)/greatest(a*f0+(1e0-a)*f1,1e-12)"
            f"+1000e0*(greatest(0e0,a-1e0)-greatest(0e0,-a)) AS s FROM dn JOIN e{t} USING (id))"
        )
        parts.append(f"q{t} AS MATERIALIZED (SELECT j AS id, sum(k*s)+20e0*any_value(z.a) AS g FROM km JOIN p{t} ON p{t}.id=i JOIN e{t} z ON z.id=j JOIN zc ON zc.id=j GROUP BY 1)")
        parts.append(f"w{t} AS MATERIALIZED (SELECT id, c-0.0005e0*g*least(1e0,5e0/(SELECT sqrt(sum(g*g)) FROM q{t})) AS c FROM {p} JOIN q{t} USING (id))")
    return ", ".join(parts)


@query("fit_centred_steps", f"WITH {MODEL}, {centred_sql(5)} SELECT id, round(c,9) AS c FROM w5")
def fit_centred_steps(spark, sf):
    """Five plain-gradient steps of the fit in which all rows pull on 100 centres."""
    rows = cut_lineage(densities(spark, sf).select("id", "v", "f0", "f1"))
    cfg = make_config("default", c_init=0.005, max_iter=5)
    fit = centred.fit_stage1(rows, sampling.subsample(rows.select("id", "v"), 100), K15, cfg, natural=False)
    return fit.frame(spark).select("id", rnd("c", 9).alias("c"))


CENTRES = f"ct AS (SELECT id, ({uniform_sql('id', 'coef')}-0.3e0)*0.1e0 AS c FROM pts ORDER BY {hash_sql('id', 'sub|42')}, id LIMIT 200)"
PRED = f"pd AS (SELECT i AS id, sum(k*c) AS g FROM km JOIN ct ON ct.id=j GROUP BY 1)"


@query(
    "predict_alpha",
    f"""WITH {MODEL}, {CENTRES}, {PRED} SELECT id, round(least(1e0,greatest(0e0,g)),7) AS alpha_linear, round(1e0/(1e0+exp(-g)),7) AS alpha_sigmoid FROM pd""",
)
def predict_alpha(spark, sf):
    """Null probability at every row from two hundred training centres with given coefficients."""
    pts = points(spark, sf)
    centres = sampling.subsample(pts, 200).withColumn("c", (hash_uniform("id", "coef") - 0.3) * 0.1)
    out = kernels.cross_apply(pts, centres, K15, ["c"])
    linear = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("k_c")))
    return out.select("id", rnd(linear, 7).alias("alpha_linear"), rnd(expit("k_c"), 7).alias("alpha_sigmoid"))


@query(
    "held_out_scores",
    f"""WITH {MODEL}, {CENTRES}, {PRED}, h AS (SELECT * FROM dn JOIN pd USING (id) WHERE id NOT IN (SELECT id FROM ct))
SELECT round(sum(ln(greatest(g*f0+(1e0-g)*f1,1e-10))),5) AS loglik, round(-sum(ln(greatest(least(1e0,greatest(0e0,g))*f0+(1e0-least(1e0,greatest(0e0,g)))*f1,1e-12))),5) AS nll,
 count(*) FILTER (WHERE g<0 OR g>1) AS violations FROM h""",
)
def held_out_scores(spark, sf):
    df = densities(spark, sf)
    centres = sampling.subsample(points(spark, sf), 200).withColumn("c", (hash_uniform("id", "coef") - 0.3) * 0.1)
    held = df.join(centres.select("id"), "id", "left_anti")
    out = kernels.cross_apply(held, centres, K15, ["c"])
    a = F.col("k_c")
    cut = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    mix = lambda x, lo: F.log(F.greatest(x * F.col("f0") + (1 - x) * F.col("f1"), F.lit(lo)))
    return out.agg(
        rnd(F.sum(mix(a, 1e-10)), 5).alias("loglik"),
        rnd(-F.sum(mix(cut, 1e-12)), 5).alias("nll"),
        F.count_if((a < 0) | (a > 1)).alias("violations"),
    )


@query(
    "best_setting",
    """WITH s AS (SELECT event_type AS dataset, user_id::int AS setting, round(avg(ln(greatest(value,1e-3))),9) AS ll, (count(*) FILTER (WHERE value>100e0))::double AS v FROM events GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN v<=5 THEN 0 ELSE 1 END, ll DESC, setting) AS r,
 row_number() OVER (PARTITION BY dataset ORDER BY -ll, setting) AS rn FROM s)
SELECT a.dataset, a.setting, round(a.ll,6) AS mean_loglik, b.setting AS nll_setting FROM r a JOIN r b ON a.dataset=b.dataset AND a.r=1 AND b.rn=1""",
)
def best_setting(spark, sf):
    """Selection rules over a table of scores: event types play datasets, users play settings."""
    e = table(spark, sf, "events").withColumnsRenamed({"event_type": "dataset"})
    s = e.groupBy("dataset", F.col("user_id").cast("int").alias("setting")).agg(
        rnd(F.avg(F.log(F.greatest("value", F.lit(1e-3)))), 9).alias("mean_loglik"),
        F.count_if(F.col("value") > 100).cast("double").alias("mean_violations"),
    )
    s = s.withColumn("mean_nll", -F.col("mean_loglik"))
    a = tuning.best_setting(s).select("dataset", "setting", rnd("mean_loglik").alias("mean_loglik"))
    b = tuning.best_by_nll(s).select("dataset", F.col("setting").alias("nll_setting"))
    return a.join(b, "dataset")


# --- fits: results of iterative solvers, checked by rows here and by numpy in the tests ---


@query("fit_predict_reject")
def fit_predict_reject(spark, sf):
    """Facade: fit all rows over 400 centres, both stages, decide for the whole table by the step-up rule."""
    est = SpatialNullEstimator(n_centres=400)
    df = hyp_points(spark, sf)
    out = est.fit(df, entire_domain=True).reject(df)
    return out.select("id", "label", "alpha_null", "lfdr", "rejected")


@query("empirical_null_fit_predict")
def empirical_null_fit_predict(spark, sf):
    est = SpatialNullEstimator(n_centres=400, density="empirical_null")
    df = cut_lineage(hyp_points(spark, sf))
    return est.fit(df).reject(df, rule="threshold").select("id", "label", "alpha_null", "lfdr", "rejected")


@query("optimizer_history")
def optimizer_history(spark, sf):
    df = sampling.subsample(densities(spark, sf), 500)
    methods = [make_config("default"), make_config("single_run"), make_config("facade")]
    out = None
    for cfg in methods:
        one = df.withColumn("dataset", F.lit(cfg.method))
        h = solver.fit_history(cut_lineage(one), K15, cfg)
        out = h if out is None else out.unionByName(h)
    return out


@query("cross_validation")
def cross_validation(spark, sf):
    """The whole grid of 144 settings times five folds on a training sample, 1000 steps a fit: one task per setting and fold."""
    df = sampling.k_folds(sampling.subsample(densities(spark, sf), 300).withColumn("dataset", F.lit("points")), 5)
    scores = tuning.cross_validate(cut_lineage(df), tuning.FULL_GRID, K15, make_config("fold", max_iter=1000))
    return tuning.best_setting(tuning.summarise_folds(cut_lineage(scores)))


@query("euclidean_cv_run")
def euclidean_cv_run(spark, sf):
    """Ward design, kernel-width cross-validation, refit, step-up decisions and metrics."""
    design = cut_lineage(experiments.euclidean_design(points(spark, sf), [50, 200, 200], 30))
    out = experiments.euclidean_cv(design, tuning.WIDTHS, make_config("euclidean_cv"))
    return metrics.compute_metrics(out, ["dataset", "sigma_factor"])


@query("replicated_evaluation")
def replicated_evaluation(spark, sf):
    """Conditions times replicates, baseline against spatial method, summarised."""
    sets = experiments.replicates(points(spark, sf), ["none", "weak", "medium", "strong"], "medium", reps=100, n_samples=500)
    runs = experiments.evaluate_sets(cut_lineage(sets), K15, make_config("default", lambda_reg=1.0))
    return metrics.summarize(cut_lineage(runs), ["power", "FDR"], ["method", "condition"])


@query("lambda_sensitivity")
def lambda_sensitivity(spark, sf):
    sets = experiments.replicates(points(spark, sf), ["medium"], "medium", reps=20, n_samples=500)
    return experiments.lambda_sensitivity(cut_lineage(sets), K15, make_config("default"), tuning.PENALTIES)


@query("allspace_prediction")
def allspace_prediction(spark, sf):
    """Densities and both stages from all rows of the training split, prediction of the null probability at every row."""
    split = cut_lineage(sampling.train_test_split(hyp_points(spark, sf), strata=["label"]))
    train = density.with_gaussian_shift(split.where("split = 'train'"), by=[])
    out = experiments.allspace(train, split.select("id", "v", "label"), K15, make_config("euclidean_cv"))
    return metrics.separation(out, "alpha_null")


@query("prediction_uncertainty")
def prediction_uncertainty(spark, sf):
    pts = cut_lineage(points(spark, sf))
    centres = cut_lineage(sampling.subsample(pts, 200).withColumn("c", (hash_uniform("id", "coef") - 0.3) * 0.1))
    g = kernels.cross_apply(pts, centres, K15, ["c"]).select("id", F.col("k_c").alias("g"))
    return solver.predictive_std(pts.join(g, "id"), centres, K15, GLOBAL_PRESETS["euclidean"].lambda_global)


@query("square_experiment")
def square_experiment(spark, sf):
    """Recovery of the known surface from the derived unit-square data of all events, predicted on the regular grid."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    out = experiments.square_experiment(e)
    return out.groupBy("alpha_true").agg(
        F.count(F.lit(1)).alias("n"), F.avg("alpha_null").alias("mean_alpha"), F.avg(F.abs(F.col("alpha_null") - F.col("alpha_true"))).alias("mae")
    )


# --- cluster structure and designs ---


@query("spectral_gap")
def spectral_gap(spark, sf):
    _, eig = clustering.spectral_embedding(points(spark, sf), Kernel("rbf", 0.7), k=6)
    return clustering.eigengap(eig.withColumn("dataset", F.lit("points")), ["dataset"])


@query("spectral_scan")
def spectral_scan(spark, sf):
    pts = points(spark, sf)
    emb, eig = clustering.spectral_embedding(pts, Kernel("rbf", 0.7), k=3)
    blocks = clustering.kmeans(emb, 3, "u").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit("points"))
    gaps = clustering.eigengap(eig.withColumn("dataset", F.lit("points")), ["dataset"], ignore_first=True)
    return clustering.structure_report(gaps, blocks)


@query("kmeans_signal_clusters")
def kmeans_signal_clusters(spark, sf):
    rows = cut_lineage(clustering.kmeans(points(spark, sf), 5))
    return sampling.evaluation_data(rows, "medium", "medium", group="cluster").groupBy("cluster", "is_signal").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("null_share")
    )


MEDOID = f"""{MODEL}, ow AS (SELECT a.group_id, a.id, sum(k) AS s FROM km JOIN pts a ON a.id=i JOIN pts b ON b.id=j WHERE a.group_id=b.group_id AND i<>j GROUP BY 1,2)"""


@query(
    "cluster_medoids",
    f"""WITH {MEDOID} SELECT group_id, arg_max(id, s) AS medoid FROM ow GROUP BY 1""",
)
def cluster_medoids(spark, sf):
    return clustering.medoids(points(spark, sf), K15, "group_id")


@query(
    "seed_and_grow",
    f"""WITH {MEDOID}, m AS (SELECT arg_max(id, s) AS id FROM ow WHERE group_id=0),
r AS (SELECT i AS id, row_number() OVER (ORDER BY k, {hash_sql('i', 'tie')}, i) AS r, count(*) OVER () AS n FROM km WHERE j=(SELECT id FROM m))
SELECT id, (CASE WHEN r>n-floor(n*0.2e0) THEN 0 ELSE 1 END)::int AS label FROM r""",
)
def seed_and_grow(spark, sf):
    pts = cut_lineage(points(spark, sf))
    med = clustering.medoids(pts.where("group_id = 0"), K15, "group_id").select(F.col("medoid").alias("id"))
    seeds = pts.join(med, "id", "left_semi")
    return clustering.seed_and_grow(pts, seeds, K15).select("id", "label")


@query(
    "mixed_cluster_sample",
    f"""WITH {POINTS}, sz AS (SELECT group_id AS cl, row_number() OVER (ORDER BY count(*) DESC, group_id) AS r FROM pts GROUP BY 1),
rl AS (SELECT id, least(r,3)-1 AS g FROM pts JOIN sz ON cl=group_id),
dr AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY {hash_sql('id', 'mix')}, id) AS r FROM rl),
pk AS (SELECT id, g, CASE WHEN g=0 THEN 0 ELSE 1 END AS lab FROM dr WHERE r<=(CASE WHEN g<2 THEN 30 ELSE 60 END)),
fl AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {hash_sql('id', 'flip|42')}, id)-1 AS fr, count(*) OVER (PARTITION BY g) AS n FROM pk)
SELECT id, g::int AS group_id, (CASE WHEN g<2 AND fr<floor(n*0.2e0) THEN 1-lab ELSE lab END)::int AS label FROM fl""",
)
def mixed_cluster_sample(spark, sf):
    rows = points(spark, sf).select("id", F.col("group_id").alias("cluster"))
    return clustering.mixed_cluster_sample(rows, n_total=120).select("id", "group_id", F.col("label").cast("int").alias("label"))


@query(
    "four_group_sample",
    f"""WITH {MEDOID}, m AS (SELECT arg_max(id, s) AS id FROM ow WHERE group_id=0),
rs AS (SELECT pts.id, group_id, k AS sim FROM pts JOIN km ON i=pts.id WHERE j=(SELECT id FROM m) AND group_id<>0),
q AS (SELECT quantile_cont(sim,0.5) AS far, quantile_cont(sim,0.8) AS close FROM rs),
pl AS (SELECT id, 0 AS g FROM pts WHERE group_id=0 UNION ALL SELECT id, 1 FROM rs WHERE group_id=1
 UNION ALL SELECT id, 2 FROM rs, q WHERE sim>=close UNION ALL SELECT id, 3 FROM rs, q WHERE sim<=far),
k0 AS (SELECT id, g FROM pl WHERE g=0 ORDER BY {hash_sql('id', 'g0')}, id LIMIT 20),
k1 AS (SELECT id, g FROM pl WHERE g=1 ORDER BY {hash_sql('id', 'g1')}, id LIMIT 60),
k2 AS (SELECT id, g FROM pl WHERE g=2 AND id NOT IN (SELECT id FROM k1) ORDER BY {hash_sql('id', 'g2')}, id LIMIT 12),
d3 AS (SELECT id, g, row_number() OVER (ORDER BY {hash_sql('id', 'g3')}, id) AS r FROM pl WHERE g=3 AND id NOT IN (SELECT id FROM k1) AND id NOT IN (SELECT id FROM k2)),
k3 AS (SELECT id, g FROM d3 WHERE r<=100+60-(SELECT count(*) FROM k1)+12-(SELECT count(*) FROM k2))
SELECT id, g::int AS group_id, (CASE WHEN g=0 THEN 0 ELSE 1 END)::int AS label FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)""",
)
def four_group_sample(spark, sf):
    rows = cut_lineage(points(spark, sf).select("id", "v", F.col("group_id").alias("cluster")))
    return clustering.four_group_sample(rows, K15, signal=0, quotas=(20, 60, 12, 100), compact=1)


@query("ward_selection")
def ward_selection(spark, sf):
    """Ward clusters of all rows on clustering features."""
    out = summaries.ward_selection(points(spark, sf).withColumn("dataset", F.lit("points")))
    return out.groupBy("selected", "n_cut").agg(F.count(F.lit(1)).alias("n"))


@query("similarity_selection")
def similarity_selection(spark, sf):
    """Sixty rows of three groups, candidates being all rows."""
    out = summaries.similarity_selection(points(spark, sf).withColumn("dataset", F.lit("points")), 60, 3)
    return out.groupBy("cluster", "objective").agg(F.count(F.lit(1)).alias("n"))


@query(
    "local_outlier_factor",
    """WITH pts AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings), pr AS (SELECT a.id AS i, b.id AS j, list_distance(a.v,b.v) AS d FROM pts a, pts b WHERE a.id<>b.id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pr) WHERE r<=20), kd AS (SELECT i, max(d) AS kd FROM nn GROUP BY 1),
lr AS (SELECT nn.i, 1e0/(avg(greatest(d,kd))+1e-10) AS l FROM nn JOIN kd ON kd.i=nn.j GROUP BY 1)
SELECT nn.i AS id, round(avg(b.l)/max(a.l),6) AS lof, CASE WHEN avg(b.l)/max(a.l)>1.5e0 THEN 1e0 ELSE -1e0 END AS score FROM nn JOIN lr b ON b.i=nn.j JOIN lr a ON a.i=nn.i GROUP BY 1""",
)
def local_outlier_factor(spark, sf):
    return clustering.local_outlier_scores(Points.pack(points(spark, sf))).select("id", rnd("lof").alias("lof"), "score")


@query("isolation_forest")
def isolation_forest(spark, sf):
    return clustering.isolation_scores(points(spark, sf))


@query("kernel_conditioning")
def kernel_conditioning(spark, sf):
    """Both ends of the spectrum over all rows."""
    return spectrum.conditioning(cut_lineage(points(spark, sf)), K15, jitter=1e-6)


@query(
    "status_log",
    """SELECT event_type AS dataset, count(*) AS n, CASE WHEN count(*)>=2000 THEN 'OK' ELSE 'FAILED' END AS status, NULL::double AS seconds FROM events GROUP BY 1""",
)
def status_log(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    return write_status(counts, 2000)
