"""Step-up rules, metrics and report tables over the event hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clip, confusion_code, local_fdr, neg_log10
from ..operators import density, metrics, testing
from ..session import cut_lineage
from ..sources.fixtures import hyp_events, hyp_events_null
from .registry import EVENTS, LFDR, hash_sql, query, rnd

BH = f"""{EVENTS}, rk AS (SELECT p, row_number() OVER (ORDER BY p,id) AS k, count(*) OVER () AS n FROM hyp),
thr AS (SELECT coalesce(max(p) FILTER (WHERE p<=k::double/n*0.1e0),0e0) AS t FROM rk),
bh AS (SELECT hyp.*, (t>0 AND p<=t) AS rejected, t FROM hyp, thr)"""

BH_BY = f"""{EVENTS}, rk AS (SELECT event_type, p, row_number() OVER (PARTITION BY event_type ORDER BY p,id) AS k,
 count(*) OVER (PARTITION BY event_type) AS n FROM hyp),
thr AS (SELECT event_type, coalesce(max(p) FILTER (WHERE p<=k::double/n*0.1e0),0e0) AS t, count(*) AS n FROM rk GROUP BY 1)"""

METRIC_SQL = """count(*) FILTER (WHERE rejected AND label=0) AS "TP", count(*) FILTER (WHERE rejected AND label=1) AS "FP",
 count(*) FILTER (WHERE NOT rejected AND label=1) AS "TN", count(*) FILTER (WHERE NOT rejected AND label=0) AS "FN",
 count(*) FILTER (WHERE rejected) AS n_discoveries, count(*) FILTER (WHERE label=0) AS n_true_signals"""

RATE_SQL = """round(CASE WHEN "TP"+"FN">0 THEN "TP"::double/("TP"+"FN") ELSE 0e0 END,9) AS "TPR",
 round(CASE WHEN "TP"+"FN">0 THEN "TP"::double/("TP"+"FN") ELSE 0e0 END,9) AS power,
 round(CASE WHEN "TP"+"FP">0 THEN "FP"::double/("TP"+"FP") ELSE 0e0 END,9) AS "FDR",
 round(CASE WHEN "TN"+"FP">0 THEN "FP"::double/("TN"+"FP") ELSE 0e0 END,9) AS "FPR",
 round(CASE WHEN "TP"+"FP">0 THEN "TP"::double/("TP"+"FP") ELSE 0e0 END,9) AS "precision",
 round(CASE WHEN 2*"TP"+"FP"+"FN">0 THEN 2e0*"TP"/(2*"TP"+"FP"+"FN") ELSE 0e0 END,9) AS "F1" """


@query("bh_events", f"WITH {BH} SELECT id, label, rejected, round(t,12) AS threshold FROM bh")
def bh_events(spark, sf):
    out = testing.benjamini_hochberg(hyp_events(spark, sf))
    return out.select("id", "label", "rejected", rnd("threshold", 12).alias("threshold"))


@query("bh_threshold_by_type", f"WITH {BH_BY} SELECT event_type, round(t,12) AS threshold, n FROM thr")
def bh_threshold_by_type(spark, sf):
    out = testing.bh_threshold(hyp_events(spark, sf), by=["event_type"])
    return out.select("event_type", rnd("threshold", 12).alias("threshold"), "n")


@query("bh_metrics", f'WITH {BH}, c AS (SELECT {METRIC_SQL} FROM bh) SELECT c.*, {RATE_SQL} FROM c')
def bh_metrics(spark, sf):
    m = metrics.compute_metrics(testing.benjamini_hochberg(hyp_events(spark, sf)))
    return m.select(*metrics.COUNTS, *[rnd(c, 9).alias(c) for c in metrics.METRICS])


@query(
    "bh_null_control",
    """WITH h AS (SELECT event_id AS id, exp(-value/50e0) AS p FROM events),
rk AS (SELECT p, row_number() OVER (ORDER BY p,id) AS k, count(*) OVER () AS n FROM h),
thr AS (SELECT coalesce(max(p) FILTER (WHERE p<=k::double/n*0.1e0),0e0) AS t FROM rk)
SELECT count(*) AS n, count(*) FILTER (WHERE t>0 AND p<=t) AS n_discoveries FROM h, thr""",
)
def bh_null_control(spark, sf):
    out = testing.benjamini_hochberg(hyp_events_null(spark, sf))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("n_discoveries"))


@query(
    "bh_adjusted",
    f"""WITH {EVENTS}, rk AS (SELECT id, p, row_number() OVER (ORDER BY p,id) AS k, count(*) OVER () AS n FROM hyp)
SELECT id, round(q,9) AS q, q<=0.05e0 AS rejected FROM (SELECT id, least(1e0, min(p/(k::double/n)) OVER
 (ORDER BY p DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM rk)""",
)
def bh_adjusted(spark, sf):
    out = testing.bh_adjusted(hyp_events(spark, sf))
    return out.select("id", rnd("q", 9).alias("q"), "rejected")


@query(
    "bh_first_k",
    f"""WITH {EVENTS}, rk AS (SELECT id, p, row_number() OVER (PARTITION BY event_type ORDER BY p,id) AS k,
 count(*) OVER (PARTITION BY event_type) AS n, event_type FROM hyp),
c AS (SELECT event_type, coalesce(max(k) FILTER (WHERE p<=k::double/n*0.1e0),0) AS kk FROM rk GROUP BY 1)
SELECT id, k<=kk AS rejected FROM rk JOIN c USING (event_type)""",
)
def bh_first_k(spark, sf):
    return testing.bh_first_k(hyp_events(spark, sf), by=["event_type"]).select("id", "rejected")


@query(
    "bh_strict_truth",
    f"""WITH {EVENTS}, rk AS (SELECT p, row_number() OVER (ORDER BY p,id) AS k, count(*) OVER () AS n FROM hyp),
thr AS (SELECT coalesce(max(p) FILTER (WHERE p<=k::double/n*0.05e0),0e0) AS t FROM rk)
SELECT event_type, (CASE WHEN p<t THEN 0 ELSE 1 END)::int AS label, count(*) AS n FROM hyp, thr GROUP BY 1,2""",
)
def bh_strict_truth(spark, sf):
    out = testing.strict_signal_truth(hyp_events(spark, sf).drop("label"))
    return out.groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bh_cut_line",
    f"""WITH {BH} SELECT round(max(t),12) AS threshold, round(-log10(greatest(max(t),1e-10)),9) AS cut,
 count(*) FILTER (WHERE rejected) AS n_discoveries FROM bh""",
)
def bh_cut_line(spark, sf):
    out = testing.benjamini_hochberg(hyp_events(spark, sf))
    return out.agg(
        rnd(F.max("threshold"), 12).alias("threshold"),
        rnd(neg_log10(F.max("threshold")), 9).alias("cut"),
        F.count_if("rejected").alias("n_discoveries"),
    )


def events_lfdr(spark, sf):
    """Events with the marginal two-group local FDR: one null share, Gaussian-shift alternative."""
    df = density.with_gaussian_shift(hyp_events(spark, sf), by=[])
    pi0 = density.storey_pi0(df).select("pi0")
    df = df.withColumn("alpha", pi0.scalar())
    df = df.withColumn("lfdr", local_fdr("alpha", "f0", "f1"))
    # the densities are read many times below; a checkpoint fixes them once and cuts the plan
    return cut_lineage(df)


@query("local_fdr", f"WITH {LFDR} SELECT id, round(f1,6) AS f1, round(lfdr,9) AS lfdr FROM lf")
def local_fdr_rows(spark, sf):
    return events_lfdr(spark, sf).select("id", rnd("f1", 6).alias("f1"), rnd("lfdr", 9).alias("lfdr"))


@query(
    "local_fdr_rule",
    f"""WITH {LFDR} SELECT event_type, count(*) FILTER (WHERE lfdr<=0.1e0) AS n_discoveries FROM lf GROUP BY 1""",
)
def local_fdr_rule(spark, sf):
    return testing.discovery_count(testing.local_fdr_rule(events_lfdr(spark, sf)), ["event_type"])


STEP = f"""{LFDR}, o AS (SELECT *, row_number() OVER w AS k, avg(lfdr) OVER (w ROWS UNBOUNDED PRECEDING) AS q FROM (
 SELECT * EXCLUDE (lfdr), round(lfdr,12) AS lfdr, {hash_sql('id', 'tie')} AS h FROM lf) WINDOW w AS (ORDER BY lfdr,h,id)),
st AS (SELECT *, k<=coalesce((SELECT max(k) FROM o WHERE q<=0.1e0),0) AS rejected FROM o)"""


@query("lfdr_step_up", f"WITH {STEP} SELECT id, rejected FROM st")
def lfdr_step_up(spark, sf):
    df = events_lfdr(spark, sf).withColumn("lfdr", rnd("lfdr", 12))
    return testing.lfdr_step_up(df).select("id", "rejected")


@query(
    "lfdr_step_up_ties",
    f"""WITH {EVENTS}, lf AS (SELECT *, floor(u*5e0)/10e0 AS lfdr, {hash_sql('id', 'tie')} AS h FROM hyp),
o AS (SELECT id, event_type, row_number() OVER w AS k, sum(lfdr) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM lf
 WINDOW w AS (PARTITION BY event_type ORDER BY lfdr,h,id)),
c AS (SELECT event_type, coalesce(max(k) FILTER (WHERE s<=0.07e0*k),0) AS kk FROM o GROUP BY 1)
SELECT id, k<=kk AS rejected FROM o JOIN c USING (event_type)""",
)
def lfdr_step_up_ties(spark, sf):
    df = hyp_events(spark, sf).withColumn("lfdr", F.floor(F.col("u") * 5) / 10.0)
    return testing.lfdr_step_up(df, by=["event_type"], level=0.07).select("id", "rejected")


@query("running_mean_q", f"WITH {STEP} SELECT id, round(q,8) AS q FROM st")
def running_mean_q(spark, sf):
    df = events_lfdr(spark, sf).withColumn("lfdr", rnd("lfdr", 12))
    return testing.running_mean_q(df).select("id", rnd("q", 8).alias("q"))


@query(
    "rank_p_values",
    """WITH s AS (SELECT event_id AS id, event_type, floor(value) AS score FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score)-1)/2e0 AS r,
 count(*) OVER (PARTITION BY event_type) AS n FROM s)
SELECT id, round(greatest(1e-10,least(1e0-1e-10,1e0-r/n)),9) AS p FROM r""",
)
def rank_p_values(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("id"), "event_type", F.floor("value").cast("double").alias("score")
    )
    return testing.rank_p_values(df, "score", by=["event_type"]).select("id", rnd("p", 9).alias("p"))


AUC = f"""{EVENTS}, s AS (SELECT label, round(-log10(p+1e-100),9) AS x FROM hyp),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x)-1)/2e0 AS r FROM s),
a AS (SELECT sum(r) FILTER (WHERE label=0) AS sr, count(*) FILTER (WHERE label=0) AS np, count(*) AS n FROM r)"""


@query(
    "roc_auc",
    f"""WITH {AUC} SELECT round((sr-np*(np+1)/2e0)/np/(n-np),9) AS auc, np AS n_pos, n, 'ok' AS reason FROM a""",
)
def roc_auc(spark, sf):
    df = hyp_events(spark, sf).withColumn("x", rnd(-F.log10(F.col("p") + 1e-100), 9)).withColumn("pos", F.col("label") == 0)
    return testing.auc(df, "x", "pos").select(rnd("auc", 9).alias("auc"), "n_pos", "n", "reason")


@query(
    "rolling_by_rank",
    f"""WITH {LFDR}, o AS (SELECT id, event_type, lfdr, row_number() OVER (PARTITION BY event_type ORDER BY u, {hash_sql('id', 'tie')}, id) AS k,
 count(*) OVER (PARTITION BY event_type) AS n FROM lf),
w AS (SELECT *, greatest(5, n//5) AS w, (greatest(5, n//5)-1)//2 AS b FROM o),
s AS (SELECT *, sum(lfdr) OVER z AS c1, sum(lfdr*lfdr) OVER z AS c2 FROM w
 WINDOW z AS (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING)),
j AS (SELECT a.id, a.w, h.c1-coalesce(l.c1,0) AS s1, h.c2-coalesce(l.c2,0) AS s2, a.k+a.b-a.w>=0 AND h.k IS NOT NULL AS ok FROM s a
 LEFT JOIN s h ON h.event_type=a.event_type AND h.k=a.k+a.b LEFT JOIN s l ON l.event_type=a.event_type AND l.k=a.k+a.b-a.w)
SELECT id, CASE WHEN ok THEN round(s1/w,6) END AS roll_mean,
 CASE WHEN ok THEN round(sqrt(greatest(0e0,(s2-s1*s1/w)/(w-1))),6) END AS roll_std FROM j""",
)
def rolling_by_rank(spark, sf):
    out = testing.rolling_by_rank(events_lfdr(spark, sf), "u", "lfdr", by=["event_type"])
    return out.select("id", rnd("roll_mean").alias("roll_mean"), rnd("roll_std").alias("roll_std"))


@query(
    "confusion_codes",
    f"""WITH {BH} SELECT (CASE WHEN NOT rejected AND label=1 THEN 0 WHEN rejected AND label=1 THEN 1 WHEN NOT rejected THEN 2 ELSE 3 END)::int
 AS code, count(*) AS n FROM bh GROUP BY 1""",
)
def confusion_codes(spark, sf):
    out = testing.benjamini_hochberg(hyp_events(spark, sf))
    return out.groupBy(confusion_code("rejected", "label").alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- report tables over a log of runs: every user is a replicate, two methods, condition = coarse user activity ---

RUNS = f"""{LFDR}, ev AS (SELECT lf.*, user_id FROM lf JOIN (SELECT event_id AS id, user_id FROM events) USING (id)),
m AS (SELECT 'plain' AS method, user_id AS seed, label, p<=0.05e0 AS rejected FROM ev
 UNION ALL SELECT 'lfdr', user_id, label, lfdr<=0.2e0 FROM ev),
cm AS (SELECT method, seed, {METRIC_SQL} FROM m GROUP BY 1,2),
runs AS (SELECT method, CASE WHEN n_true_signals=0 THEN 'none' WHEN n_true_signals<3 THEN 'weak' WHEN n_true_signals<6 THEN 'medium' ELSE 'strong' END
 AS condition, seed, {RATE_SQL}, "TP", "FP", "TN", "FN", n_discoveries, n_true_signals FROM cm)"""


def run_log(spark, sf):
    """Metrics log with one row per (method, seed): users play the part of replicates."""
    users = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("seed"))
    ev = events_lfdr(spark, sf).select("id", "label", "p", "lfdr").join(users, "id")
    rules = F.array(
        F.struct(F.lit("plain").alias("method"), (F.col("p") <= 0.05).alias("rejected")),
        F.struct(F.lit("lfdr").alias("method"), (F.col("lfdr") <= 0.2).alias("rejected")),
    )
    long = ev.select("seed", "label", F.inline(rules))
    m = metrics.compute_metrics(long, ["method", "seed"])
    n = F.col("n_true_signals")
    condition = F.when(n == 0, "none").when(n < 3, "weak").when(n < 6, "medium").otherwise("strong")
    for c in metrics.METRICS:
        m = m.withColumn(c, rnd(c, 9))
    return m.withColumn("condition", condition)


@query("metrics_log", f"WITH {RUNS} SELECT * FROM runs")
def metrics_log(spark, sf):
    return run_log(spark, sf)


@query(
    "metrics_summary",
    f"""WITH {RUNS}, l AS (SELECT method, 'power' AS metric, power AS x FROM runs UNION ALL SELECT method, 'FDR', "FDR" FROM runs
 UNION ALL SELECT method, 'n_discoveries', n_discoveries::double FROM runs)
SELECT method, metric, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS std, round(min(x),6) AS min, round(max(x),6) AS max,
 round(quantile_cont(x,0.5),6) AS median FROM l GROUP BY 1,2""",
)
def metrics_summary(spark, sf):
    s = metrics.summarize(cut_lineage(run_log(spark, sf)), ["power", "FDR", "n_discoveries"], ["method"])
    return s.select("method", "metric", *[rnd(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("method_comparison", f'WITH {RUNS} SELECT method, round(avg("F1"),6) AS mean_f1 FROM runs GROUP BY 1')
def method_comparison(spark, sf):
    return metrics.compare_methods(run_log(spark, sf), "F1").select("method", rnd("mean_F1").alias("mean_f1"))


@query(
    "method_means",
    f'WITH {RUNS} SELECT method, condition, round(avg(power),6) AS power, round(avg("FDR"),6) AS fdr FROM runs GROUP BY 1,2',
)
def method_means(spark, sf):
    out = metrics.method_means(run_log(spark, sf), ["method", "condition"])
    return out.select("method", "condition", rnd("power").alias("power"), rnd("FDR").alias("fdr"))


@query(
    "fdr_calibration",
    f"""WITH {RUNS} SELECT condition, method, round(avg("FDR"),6) AS mean_fdr, round(stddev_pop("FDR"),6) AS std_fdr, 0.1e0 AS nominal
FROM runs GROUP BY 1,2""",
)
def fdr_calibration(spark, sf):
    out = metrics.calibration(run_log(spark, sf))
    return out.select("condition", "method", rnd("mean_fdr").alias("mean_fdr"), rnd("std_fdr").alias("std_fdr"), "nominal")


@query(
    "power_at_fdr",
    f"""WITH {RUNS} SELECT method, round(avg(CASE WHEN "FDR"<=0.1e0 THEN "TPR" ELSE 0e0 END),6) AS power_at_fdr FROM runs GROUP BY 1""",
)
def power_at_fdr(spark, sf):
    out = metrics.power_at_fdr(run_log(spark, sf)).groupBy("method")
    return out.agg(rnd(F.avg("power_at_fdr")).alias("power_at_fdr"))


PAIR = f"""{RUNS}, pr AS (SELECT a.seed, a.power AS power, a."FDR" AS fdr, b.power AS base_power, b."FDR" AS base_fdr
FROM runs a JOIN runs b USING (seed) WHERE a.method='lfdr' AND b.method='plain')"""


def paired_runs(spark, sf):
    log = run_log(spark, sf).select("method", "seed", "power", "FDR")
    wide = log.groupBy("seed").agg(
        *[
            F.max(F.when(F.col("method") == m, F.col(c))).alias(a)
            for m, c, a in (
                ("lfdr", "power", "power"),
                ("lfdr", "FDR", "FDR"),
                ("plain", "power", "base_power"),
                ("plain", "FDR", "base_fdr"),
            )
        ]
    )
    return wide


@query(
    "relative_gain",
    f"""WITH {PAIR} SELECT count(*) AS n, count(*) FILTER (WHERE base_power=0 AND power>0) AS n_infinite,
 round(avg(CASE WHEN base_power=0 THEN 0e0 ELSE (power-base_power)/base_power END),6) AS mean_gain_bars FROM pr""",
)
def relative_gain(spark, sf):
    pr = paired_runs(spark, sf)
    gain = metrics.relative_gain("power", "base_power")
    return pr.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gain == float("inf")).alias("n_infinite"),
        rnd(F.avg(metrics.relative_gain("power", "base_power", zero_base=0.0))).alias("mean_gain_bars"),
    )


@query(
    "run_verdicts",
    f"""WITH {PAIR} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN fdr<=0.1e0*1.1e0 AND power>base_power THEN 'spatial'
 WHEN base_fdr<=0.1e0*1.1e0 AND base_power>power THEN 'baseline'
 WHEN fdr>0.1e0*1.5e0 AND base_fdr>0.1e0*1.5e0 THEN 'both fail' ELSE 'mixed' END AS verdict FROM pr) GROUP BY 1""",
)
def run_verdicts(spark, sf):
    return metrics.verdict(paired_runs(spark, sf)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p_histogram",
    f"""WITH {EVENTS} SELECT label, b::int AS bin, count(*) AS n, round(count(*)/(sum(count(*)) OVER (PARTITION BY label))/0.05e0,9) AS density
FROM (SELECT label, least(floor(p/0.05e0),19) AS b FROM hyp WHERE p BETWEEN 0 AND 1) GROUP BY 1,2""",
)
def p_histogram(spark, sf):
    out = metrics.histogram(hyp_events(spark, sf), "p", 20, 0.0, 1.0, ["label"])
    return out.select("label", "bin", "n", rnd("density", 9).alias("density"))


@query(
    "alpha_separation",
    f"""WITH {LFDR} SELECT round(avg(lfdr) FILTER (WHERE label=0),6) AS mean_h1, round(avg(lfdr) FILTER (WHERE label=1),6) AS mean_h0,
 round(avg(lfdr) FILTER (WHERE label=0)-avg(lfdr) FILTER (WHERE label=1),6) AS difference FROM lf""",
)
def alpha_separation(spark, sf):
    out = metrics.separation(events_lfdr(spark, sf), "lfdr")
    return out.select(*[rnd(c).alias(c) for c in ("mean_h1", "mean_h0", "difference")])


@query(
    "clip_and_violations",
    f"""WITH {EVENTS} SELECT event_type, count(*) FILTER (WHERE a<0 OR a>1) AS n_violations,
 round(avg(least(1e0,greatest(0e0,a))),9) AS mean_clipped FROM (SELECT event_type, 1.2e0-1.4e0*u AS a FROM hyp) GROUP BY 1""",
)
def clip_and_violations(spark, sf):
    df = hyp_events(spark, sf).withColumn("alpha", F.lit(1.2) - F.col("u") * 1.4)
    v = metrics.violations(df, by=["event_type"])
    m = df.groupBy("event_type").agg(rnd(F.avg(clip("alpha", 0.0, 1.0)), 9).alias("mean_clipped"))
    return v.join(m, "event_type")
