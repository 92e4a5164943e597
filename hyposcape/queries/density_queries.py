"""Scalar transforms, null share and density estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expit, logit, nan_to_zero, neg_log10, norm_pdf, norm_sf, z_left, z_right
from ..operators import density, features
from ..sources.fixtures import hyp_events, points
from .registry import CLIP_P, EVENTS, POINTS, ppf_sql, query, rnd, sf_sql

P15 = "least(1e0-1e-15,greatest(1e-15,p))"


@query(
    "normal_transforms",
    f"""WITH {EVENTS}, z AS (SELECT id, p, {ppf_sql('c15')} AS zl, {ppf_sql('1e0-c10')} AS zr FROM
 (SELECT *, {P15} AS c15, {CLIP_P} AS c10 FROM hyp))
SELECT id, round(zl,8) AS z_left, round(zr,8) AS z_right, round(exp(-zl*zl/2e0)/sqrt(2e0*pi()),9) AS phi,
 round({sf_sql('zr')},8) AS p_back FROM z""",
)
def normal_transforms(spark, sf):
    df = hyp_events(spark, sf).withColumn("zl", z_left("p")).withColumn("zr", z_right("p"))
    return df.select(
        "id",
        rnd("zl", 8).alias("z_left"),
        rnd("zr", 8).alias("z_right"),
        rnd(norm_pdf("zl"), 9).alias("phi"),
        rnd(norm_sf("zr"), 8).alias("p_back"),
    )


@query(
    "link_functions",
    f"""WITH {EVENTS}, a AS (SELECT *, least(0.99e0,greatest(0.01e0,u)) AS a FROM hyp)
SELECT id, round(ln(a/(1e0-a)),9) AS logit, round(1e0/(1e0+exp(-ln(a/(1e0-a)))),9) AS expit_back,
 round(1e0/(1e0+exp(-least(500e0,greatest(-500e0,1000e0*(a-0.5e0))))),9) AS steep,
 round(-log10(greatest(p,1e-10)),9) AS neg_log10 FROM a""",
)
def link_functions(spark, sf):
    df = hyp_events(spark, sf).withColumn("a", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("u"))))
    return df.select(
        "id",
        rnd(logit("a"), 9).alias("logit"),
        rnd(expit(logit("a")), 9).alias("expit_back"),
        rnd(expit((F.col("a") - 0.5) * 1000.0), 9).alias("steep"),
        rnd(neg_log10("p"), 9).alias("neg_log10"),
    )


@query(
    "valid_p_and_nan",
    f"""WITH {EVENTS}, x AS (SELECT *, CASE WHEN u>0.9e0 THEN NULL WHEN u>0.8e0 THEN 0e0 ELSE u END AS q FROM hyp)
SELECT event_type, count(*) FILTER (WHERE q>0 AND q<1) AS n_valid, round(avg(coalesce(q,0e0)),9) AS mean_nan_zero FROM x GROUP BY 1""",
)
def valid_p_and_nan(spark, sf):
    from ..functions import valid_p

    u = F.col("u")
    q = F.when(u > 0.9, F.lit(float("nan"))).when(u > 0.8, 0.0).otherwise(u)
    df = hyp_events(spark, sf).withColumn("q", q)
    return df.groupBy("event_type").agg(
        F.count_if(valid_p("q")).alias("n_valid"), rnd(F.avg(nan_to_zero("q")), 9).alias("mean_nan_zero")
    )


@query(
    "storey_pi0",
    f"""WITH {EVENTS} SELECT event_type, count(*) AS n,
 round(least(1e0,greatest(0e0,avg(CASE WHEN p>0.5e0 THEN 1e0 ELSE 0e0 END)/0.5e0)),9) AS pi0,
 round(least(1e0,greatest(0.1e0,avg(CASE WHEN p>0.5e0 THEN 1e0 ELSE 0e0 END)/0.5e0)),9) AS pi0_floored FROM hyp GROUP BY 1""",
)
def storey_pi0(spark, sf):
    df = hyp_events(spark, sf)
    a = density.storey_pi0(df, by=["event_type"])
    b = density.storey_pi0(df, by=["event_type"], floor=0.1).select("event_type", F.col("pi0").alias("pi0_floored"))
    return a.join(b, "event_type").select("event_type", "n", rnd("pi0", 9).alias("pi0"), rnd("pi0_floored", 9).alias("pi0_floored"))


SHIFT = f"""{EVENTS}, zed AS (SELECT *, {ppf_sql('1e0-c')} AS z FROM (SELECT *, {CLIP_P} AS c FROM hyp)),
par AS (SELECT event_type, count(*) FILTER (WHERE p<0.2e0) AS n_low, avg(z) FILTER (WHERE p<0.2e0) AS mu,
 stddev_pop(z) FILTER (WHERE p<0.2e0) AS sigma, avg(least(10e0,z)) FILTER (WHERE p<0.1e0) AS mu_tight FROM zed GROUP BY 1)"""


@query(
    "gaussian_shift",
    f"""WITH {SHIFT} SELECT event_type, n_low, round(mu,8) AS mu, round(sigma,8) AS sigma, 1e0 AS unit_sigma, round(mu_tight,8) AS mu_tight FROM par""",
)
def gaussian_shift(spark, sf):
    df = hyp_events(spark, sf)
    a = density.gaussian_shift(df, by=["event_type"])
    b = density.gaussian_shift(df, by=["event_type"], unit_sigma=True).select("event_type", F.col("sigma").alias("unit_sigma"))
    c = density.gaussian_shift(df, by=["event_type"], threshold=0.1, default=(2.0, 1.0), z_cap=10.0)
    c = c.select("event_type", rnd("mu", 8).alias("mu_tight"))
    out = a.select("event_type", "n_low", rnd("mu", 8).alias("mu"), rnd("sigma", 8).alias("sigma"))
    return out.join(b, "event_type").join(c, "event_type")


@query(
    "density_ratio_grid",
    f"""WITH {SHIFT}, g AS (SELECT i AS g, 0.001e0+i*((0.999e0-0.001e0)/999) AS p FROM range(1000) t(i)),
z AS (SELECT g, {ppf_sql('1e0-p')} AS z FROM g),
r AS (SELECT g, exp((z*z-((z-mu)/sigma)*((z-mu)/sigma))/2e0)/sigma/(1e0+1e-10) AS ratio FROM z, par)
SELECT g::int AS g, round(avg(ratio),6) AS mean_ratio, round(stddev_pop(ratio),6) AS std_ratio,
 round(avg(CASE WHEN ratio>1 THEN 1e0 ELSE 0e0 END),9) AS share_above FROM r GROUP BY 1""",
)
def density_ratio_grid(spark, sf):
    fit = density.gaussian_shift(hyp_events(spark, sf), by=["event_type"])
    out = density.density_ratio_grid(spark, fit.withColumnRenamed("event_type", "dataset"))
    return out.select("g", rnd("mean_ratio").alias("mean_ratio"), rnd("std_ratio").alias("std_ratio"), rnd("share_above", 9).alias("share_above"))


@query(
    "density_ratio_flag",
    f"""WITH {SHIFT}, g AS (SELECT i AS g, 0.001e0+i*((0.999e0-0.001e0)/999) AS p FROM range(1000) t(i)),
z AS (SELECT g, {ppf_sql('1e0-p')} AS z FROM g),
r AS (SELECT g, avg(exp((z*z-((z-mu)/sigma)*((z-mu)/sigma))/2e0)/sigma/(1e0+1e-10)) AS m FROM z, par GROUP BY 1)
SELECT round(avg(CASE WHEN m>1 THEN 1e0 ELSE 0e0 END),9) AS fraction_above, avg(CASE WHEN m>1 THEN 1e0 ELSE 0e0 END)>0.6e0 AS flagged FROM r""",
)
def density_ratio_flag(spark, sf):
    fit = density.gaussian_shift(hyp_events(spark, sf), by=["event_type"])
    out = density.density_ratio_flag(density.density_ratio_grid(spark, fit.withColumnRenamed("event_type", "dataset")))
    return out.select(rnd("fraction_above", 9).alias("fraction_above"), "flagged")


NULLFIT = f"""{EVENTS}, zed AS (SELECT id, p, {ppf_sql('c')} AS z FROM (SELECT *, {P15} AS c FROM hyp WHERE p>0 AND p<1)),
st AS (SELECT count(*) AS n, quantile_cont(z,0.5) AS delta, quantile_cont(z,0.75) AS q75, stddev_samp(z) AS sd,
 least(1e0,greatest(0.1e0,avg(CASE WHEN p>0.5e0 THEN 1e0 ELSE 0e0 END)/0.5e0)) AS pi0 FROM zed),
par AS (SELECT n, delta, greatest(1e0,(q75-delta)/0.6745e0) AS sigma, 1.06e0*sd*pow(n::double,-0.2e0) AS h, pi0 FROM st)"""


@query(
    "empirical_null_fit",
    f"""WITH {NULLFIT} SELECT n, round(delta,8) AS delta, round(sigma,8) AS sigma, round(h,9) AS h, round(pi0,9) AS pi0 FROM par""",
)
def empirical_null_fit(spark, sf):
    out = density.empirical_null(hyp_events(spark, sf))
    return out.select("n", rnd("delta", 8).alias("delta"), rnd("sigma", 8).alias("sigma"), rnd("h", 9).alias("h"), rnd("pi0", 9).alias("pi0"))


@query(
    "empirical_null_density",
    f"""WITH {NULLFIT}, kde AS (SELECT a.id, a.z, a.p, avg(exp(-(a.z-b.z)*(a.z-b.z)/(2e0*h*h)))/(max(h)*sqrt(2e0*pi())) AS k,
 max(delta) AS delta, max(sigma) AS sigma FROM zed a, zed b, par GROUP BY 1,2,3),
nl AS (SELECT *, exp(-((z-delta)/sigma)*((z-delta)/sigma)/2e0)/(sigma*sqrt(2e0*pi())) AS nz, exp(-z*z/2e0)/sqrt(2e0*pi()) AS phi FROM kde),
t AS (SELECT least(1e0,greatest(0.5e0,min(k/(nz+1e-10)) FILTER (WHERE z>delta))) AS pt FROM nl)
SELECT id, round(nz/phi,6) AS f0, round(CASE WHEN z>delta THEN 0e0 ELSE greatest(0e0,k-pt*nz) END,8) AS excess, round(pt,8) AS pi0_temp FROM nl, t""",
)
def empirical_null_density(spark, sf):
    out = density.with_empirical_null(hyp_events(spark, sf))
    excess = F.col("f1") * norm_pdf(z_left("p")) * (F.lit(1.0) - F.col("pi0_temp") + 1e-6)
    return out.select("id", rnd("f0").alias("f0"), rnd(excess, 8).alias("excess"), rnd("pi0_temp", 8).alias("pi0_temp"))


@query(
    "kde_1d",
    """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS x FROM customer),
b AS (SELECT seg, count(*) AS n, 1.06e0*stddev_samp(x)*pow(count(*)::double,-0.2e0) AS h FROM c GROUP BY 1)
SELECT a.id, round(1e6*avg(exp(-(a.x-o.x)*(a.x-o.x)/(2e0*h*h)))/(max(h)*sqrt(2e0*pi())),6) AS density FROM c a JOIN c o USING (seg) JOIN b USING (seg) GROUP BY 1""",
)
def kde_1d(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    c = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("x"))
    h = F.lit(1.06) * F.stddev_samp("x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))
    b = c.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), h.alias("h"))
    out = density.kde_1d(c, "x", b, ["seg"])
    return out.select("id", rnd(F.col("density") * 1e6).alias("density"))


@query(
    "beta_alternative",
    # the same optimum by another search: a plain descent over shrinking steps from the middle of the box
    f"""WITH RECURSIVE {EVENTS}, d AS (SELECT count(*) AS n, avg(ln(p)) AS ml, avg(ln(1e0-p)) AS mm FROM hyp WHERE p>0 AND p<0.1e0),
st(a, b, h, i) AS (SELECT 1e0, 10e0, 0.5e0, 0 UNION ALL SELECT nx.p.a, nx.p.b, CASE WHEN nx.p.a=st_a AND nx.p.b=st_b THEN h/2e0 ELSE h END, i+1 FROM (
 SELECT arg_min({{'a': x, 'b': y}}, lgamma(x)+lgamma(y)-lgamma(x+y)-(x-1e0)*ml-(y-1e0)*mm) AS p, any_value(a) AS st_a, any_value(b) AS st_b, any_value(h) AS h, any_value(i) AS i
 FROM (SELECT st.*, ml, mm, least(2e0,greatest(0.1e0,a+da*h)) AS x, least(20e0,greatest(1e0,b+db*h*10e0)) AS y FROM st, d,
  (SELECT unnest([-1e0,0e0,1e0]) AS da), (SELECT unnest([-1e0,0e0,1e0]) AS db)) ) nx WHERE h>1e-9)
SELECT (SELECT n FROM d) AS n_low, round(a,4) AS a, round(b,4) AS b FROM st ORDER BY i DESC LIMIT 1""",
)
def beta_alternative(spark, sf):
    df = hyp_events(spark, sf)
    a, b = density.beta_mle(df)
    grid = df.agg(F.count_if((F.col("p") > 0) & (F.col("p") < 0.1)).alias("n_low"))
    return grid.select("n_low", rnd(F.lit(a), 4).alias("a"), rnd(F.lit(b), 4).alias("b"))


@query(
    "standardize_features",
    f"""WITH {POINTS}, e AS (SELECT id, unnest(range(1,65)) AS j, unnest(v) AS x FROM pts), s AS (SELECT j, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1)
SELECT id, round(sum((x-m)/sd*j),6) AS checksum FROM e JOIN s USING (j) GROUP BY 1""",
)
def standardize_features(spark, sf):
    out = features.standardize(points(spark, sf))
    weighted = F.aggregate(
        F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return out.select("id", rnd(weighted).alias("checksum"))


@query(
    "isolation_scaling",
    f"""WITH {EVENTS} SELECT id, round(1e0-(value-min(value) OVER w)/(max(value) OVER w-min(value) OVER w+1e-10),8) AS isolation FROM hyp
 WINDOW w AS (PARTITION BY event_type)""",
)
def isolation_scaling(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), "event_type", "value")
    return features.min_max_isolation(e, "value", ["event_type"]).select("id", rnd("isolation", 8).alias("isolation"))
