"""Sampling, splits and generators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hash_uniform, in_top_right
from ..operators import features, ordered, sampling
from ..sources.fixtures import hyp_events, hyp_points, points
from ..sources.tables import list_datasets, load_points, table
from .registry import EVENTS, POINTS, hash_sql, query, rnd, sf_sql, uniform_sql


@query("load_points_head", "SELECT vec_id AS id, label AS y, round(embedding[1]::double,9) AS x0 FROM embeddings ORDER BY vec_id LIMIT 50")
def load_points_head(spark, sf):
    df = load_points(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", head=50)
    return df.select("id", "y", rnd(F.col("v")[0], 9).alias("x0"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("list_datasets", " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n FROM {t}" for t in TABLES))
def datasets(spark, sf):
    """The stored datasets and their rows; discovery names them, each is read."""
    names = [r["dataset"] for r in list_datasets(spark, sf).select("dataset").distinct().orderBy("dataset").collect()]
    counts = [table(spark, sf, n).agg(F.lit(n).alias("dataset"), F.count(F.lit(1)).alias("n")) for n in names]
    return reduce(DataFrame.unionByName, counts)


@query("subsample", f"WITH {POINTS} SELECT id, group_id FROM pts ORDER BY {hash_sql('id', 'sub|42')}, id LIMIT 200")
def subsample(spark, sf):
    return sampling.subsample(points(spark, sf), 200).select("id", "group_id")


@query(
    "candidate_pool",
    f"""SELECT o_orderkey AS id, o_orderstatus FROM orders ORDER BY {hash_sql('o_orderkey', 'pool|42')}, o_orderkey LIMIT 10000""",
)
def candidate_pool(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return sampling.candidate_pool(o)


@query(
    "stratified_subsample",
    f"""WITH {EVENTS}, ed AS (SELECT list_sort(list_distinct(quantile_cont(p,[{','.join(f'{i}/100.0' for i in range(101))}]))) AS e FROM hyp),
b AS (SELECT id, p, len(list_filter(e[2:len(e)-1], lambda x: x<p)) AS bin FROM hyp, ed),
r AS (SELECT id, row_number() OVER (PARTITION BY bin ORDER BY {hash_sql('id', 'strat|42')}, id) AS r FROM b)
SELECT id FROM r WHERE r<=50""",
)
def stratified_subsample(spark, sf):
    return sampling.stratified_subsample(hyp_events(spark, sf)).select("id")


@query(
    "train_test_split",
    f"""WITH {EVENTS}, r AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('id', 'split|42')}, id)-1 AS r,
 count(*) OVER (PARTITION BY label) AS n FROM hyp) SELECT id, CASE WHEN r<floor(n*0.2e0) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def train_test_split(spark, sf):
    return sampling.train_test_split(hyp_events(spark, sf), strata=["label"]).select("id", "split")


@query(
    "k_folds",
    f"""WITH {EVENTS} SELECT id, ((row_number() OVER (ORDER BY {hash_sql('id', 'fold|42')}, id)-1)%5)::int AS fold FROM hyp""",
)
def k_folds(spark, sf):
    return sampling.k_folds(hyp_events(spark, sf)).select("id", "fold")


@query(
    "exact_quantiles",
    """SELECT l_returnflag AS g, round(quantile_cont(l_extendedprice,0.5),6) AS median, round(quantile_cont(l_extendedprice,0.8),6) AS p80,
 round(quantile_cont(l_quantity,0.25),6) AS q_quantity FROM lineitem GROUP BY 1""",
)
def exact_quantiles(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "g")
    a = ordered.quantile_row(li, "l_extendedprice", {"median": 0.5, "p80": 0.8}, ["g"])
    b = ordered.quantile_row(li, "l_quantity", {"q_quantity": 0.25}, ["g"])
    return a.join(b, "g").select("g", rnd("median").alias("median"), rnd("p80").alias("p80"), rnd("q_quantity").alias("q_quantity"))


SIG = f"""sig AS (SELECT group_id FROM (SELECT DISTINCT group_id FROM pts) ORDER BY {hash_sql('group_id', 'sig|42')}, group_id
 LIMIT (SELECT greatest(1,floor(count(DISTINCT group_id)*0.4e0)::int) FROM pts))"""


@query(
    "clustered_labels",
    f"""WITH {POINTS}, {SIG}, l AS (SELECT id, group_id, (CASE WHEN u2<(CASE WHEN group_id IN (SELECT group_id FROM sig) THEN 0.4e0 ELSE 0.9e0 END)
 THEN 1 ELSE 0 END)::int AS label FROM (SELECT *, {uniform_sql('id', 'lab|42')} AS u2 FROM pts))
SELECT id, l.label, round(CASE WHEN label=1 THEN u3 ELSE pow(u3,1e0/0.05e0) END,9) AS p FROM (SELECT *, {uniform_sql('id', 'p|43')} AS u3 FROM l) l""",
)
def clustered_labels(spark, sf):
    out = sampling.evaluation_data(points(spark, sf), "medium", "medium")
    return out.select("id", "label", rnd("p", 9).alias("p"))


@query(
    "beta_p_values",
    f"""WITH {EVENTS} SELECT id, round({uniform_sql('id', 'p|43')},6) AS cdf_b3, round({uniform_sql('id', 'p|43')},6) AS cdf_b5 FROM hyp WHERE label=0""",
)
def beta_p_values(spark, sf):
    """The generated value is pushed back through the Beta distribution, which must return the uniform draw."""
    h = hyp_events(spark, sf).where("label = 0")

    def cdf(x, a, b):
        const = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        terms = [F.pow(x, F.lit(float(j))) * F.lit(const * (-1) ** j * math.comb(b - 1, j) / (a + j)) for j in range(b)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return F.pow(x, F.lit(a)) * total

    u = hash_uniform("id", "p|43")
    out = h.select("id", sampling.beta_quantile(u, 0.5, 3).alias("p3"), sampling.beta_quantile(u, 0.5, 5).alias("p5"))
    return out.select("id", rnd(cdf(F.col("p3"), 0.5, 3)).alias("cdf_b3"), rnd(cdf(F.col("p5"), 0.5, 5)).alias("cdf_b5"))


def gauss_sql(key: str, salt: str) -> str:
    return f"(sqrt(-2e0*ln({uniform_sql(key, salt + '|a')}))*cos(2e0*pi()*{uniform_sql(key, salt + '|b')}))"


SQUARE = f"""sq AS (SELECT event_id AS id, {uniform_sql('event_id', 'x|42')} AS x, {uniform_sql('event_id', 'y|42')} AS y FROM events),
rk AS (SELECT *, x>0.5e0 AND y>0.5e0 AS q, row_number() OVER (PARTITION BY x>0.5e0 AND y>0.5e0 ORDER BY {hash_sql('id', 'sq|42')}, id)-1 AS r,
 count(*) OVER (PARTITION BY x>0.5e0 AND y>0.5e0) AS n FROM sq),
lb AS (SELECT *, (CASE WHEN r<floor(n*(CASE WHEN q THEN 0.9e0 ELSE 0.1e0 END)) THEN 0 ELSE 1 END)::int AS label FROM rk),
zz AS (SELECT *, {gauss_sql('id', 'z|42')}+(CASE WHEN label=0 THEN 2e0 ELSE 0e0 END) AS z FROM lb)"""


@query(
    "square_data",
    f"""WITH {SQUARE} SELECT id, label, q AS quadrant, round({sf_sql('z')},8) AS p,
 round(least(0.99e0,greatest(0.01e0,(CASE WHEN q THEN 0.1e0 ELSE 0.9e0 END)+{gauss_sql('id', 'alpha')}*0.05e0)),8) AS alpha FROM zz""",
)
def square_data(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    out = sampling.noisy_alpha(sampling.square_data(e))
    return out.select("id", "label", in_top_right("x", "y").alias("quadrant"), rnd("p", 8).alias("p"), rnd("alpha", 8).alias("alpha"))


@query(
    "blob_data",
    f"""WITH r AS (SELECT event_id AS id, row_number() OVER (ORDER BY {hash_sql('event_id', 'blob|42')}, event_id)-1 AS r, count(*) OVER () AS n FROM events),
l AS (SELECT id, (CASE WHEN r<floor(n*0.2e0) THEN 0 ELSE 1 END)::int AS label FROM r),
z AS (SELECT id, label, {gauss_sql('id', 'z|42')}+(CASE WHEN label=0 THEN 2e0 ELSE 0e0 END) AS z FROM l)
SELECT id, label, 2::int AS d, round({sf_sql('z')},8) AS p FROM z""",
)
def blob_data(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    out = sampling.blob_data(e)
    return out.select("id", "label", F.size("v").alias("d"), rnd("p", 8).alias("p"))


@query(
    "group_quota_sample",
    f"""WITH {POINTS}, r AS (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {hash_sql('id', 'quota')}, id) AS r FROM pts)
SELECT id, group_id FROM r WHERE r<=(CASE group_id WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 30 ELSE 0 END)""",
)
def group_quota_sample(spark, sf):
    return sampling.group_quota(points(spark, sf), {0: 20, 1: 15, 2: 30}).select("id", "group_id")


@query(
    "corrupt_labels",
    f"""WITH {POINTS}, r AS (SELECT id, group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY {hash_sql('id', 'flip|42')}, id)-1 AS r,
 count(*) OVER (PARTITION BY group_id) AS n FROM pts) SELECT id, (CASE WHEN r<floor(n*0.2e0) THEN 1-label ELSE label END)::int AS label FROM r""",
)
def corrupt_labels(spark, sf):
    return sampling.corrupt_labels(hyp_points(spark, sf), "group_id", 0.2).select("id", "label")


@query(
    "keep_first",
    """SELECT l_partkey AS gene, ord, l_quantity AS q FROM (SELECT *, l_orderkey*10+l_linenumber AS ord,
 row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey*10+l_linenumber) AS r FROM lineitem) WHERE r=1""",
)
def keep_first(spark, sf):
    """Lines with equal keys go by their place in the stored table."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gene"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").alias("q"), *place
    )
    return features.keep_first(li, ["gene"], "ord", ["file", "at"])


@query(
    "set_difference",
    f"""WITH {POINTS} SELECT group_id, count(*) AS n FROM pts WHERE id NOT IN (SELECT id FROM pts ORDER BY {hash_sql('id', 'sub|42')}, id LIMIT 200) GROUP BY 1""",
)
def set_difference(spark, sf):
    pts = points(spark, sf)
    chosen = sampling.subsample(pts, 200).select("id")
    return pts.join(chosen, "id", "left_anti").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ratio_subsample",
    f"""WITH {POINTS}, r AS (SELECT id, (CASE WHEN group_id=3 THEN 0 ELSE 1 END)::int AS label,
 row_number() OVER (PARTITION BY group_id=3 ORDER BY {hash_sql('id', 'ratio')}, id) AS r FROM pts)
SELECT id, label FROM r WHERE r<=(CASE WHEN label=0 THEN 20 ELSE 180 END)""",
)
def ratio_subsample(spark, sf):
    rows = points(spark, sf).select("id", F.col("group_id").alias("cluster"))
    return sampling.ratio_subsample(rows, signal=3, n_total=200).select("id", "label")
