"""Query registry and the SQL fragments shared by the oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal as nrm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def poly_sql(x: str, coefficients: list[float]) -> str:
    text = f"{coefficients[-1]:.20e}"
    for c in reversed(coefficients[:-1]):
        text = f"({text}*{x}+({c:.20e}))"
    return text


def ppf_sql(p: str) -> str:
    """Normal quantile as SQL text."""
    q = f"(({p})-0.5e0)"
    rc = f"(0.180625e0-{q}*{q})"
    r = f"sqrt(-ln(least(({p}),1e0-({p}))))"
    m, t = f"({r}-1.6e0)", f"({r}-5e0)"
    centre = f"{q}*{poly_sql(rc, nrm.PPF_CENTRE_NUM)}/{poly_sql(rc, nrm.PPF_CENTRE_DEN)}"
    mid = f"{poly_sql(m, nrm.PPF_MID_NUM)}/{poly_sql(m, nrm.PPF_MID_DEN)}"
    tail = f"{poly_sql(t, nrm.PPF_TAIL_NUM)}/{poly_sql(t, nrm.PPF_TAIL_DEN)}"
    outer = f"(CASE WHEN {r}<=5e0 THEN {mid} ELSE {tail} END)"
    return f"(CASE WHEN abs({q})<=0.425e0 THEN {centre} WHEN {q}<0 THEN -{outer} ELSE {outer} END)"


def sf_sql(x: str) -> str:
    """Upper normal tail as SQL text."""
    a = f"abs({x})"
    e = f"exp(-{a}*{a}/2e0)"
    near = f"{e}*{poly_sql(a, nrm.CDF_NUM)}/{poly_sql(a, nrm.CDF_DEN)}"
    f = f"({a}+0.65e0)"
    for k in (4, 3, 2, 1):
        f = f"({a}+{k}e0/{f})"
    tail = f"(CASE WHEN {a}<7.07106781186547e0 THEN {near} ELSE {e}/{f}/sqrt(2e0*pi()) END)"
    return f"(CASE WHEN ({x})>0 THEN {tail} ELSE 1e0-{tail} END)"


def hash_sql(key: str, salt: str) -> str:
    return f"('0x'||substr(md5(({key})::varchar||'|{salt}'),1,8))::bigint"


def uniform_sql(key: str, salt: str) -> str:
    return f"(({hash_sql(key, salt)}+0.5e0)/4294967296e0)"


EVENTS = """hyp AS (SELECT event_id AS id, event_type, value, exp(-value/50e0) AS u,
 (CASE WHEN event_type='purchase' THEN 0 ELSE 1 END)::int AS label,
 CASE WHEN event_type='purchase' THEN pow(exp(-value/50e0),10e0) ELSE exp(-value/50e0) END AS p FROM events)"""

CLIP_P = "least(1e0-1e-10,greatest(1e-10,p))"

# local FDR of the events under the Gaussian-shift alternative and Storey's null share
LFDR = f"""{EVENTS}, zed AS (SELECT *, {ppf_sql('1e0-c')} AS z FROM (SELECT *, {CLIP_P} AS c FROM hyp)),
par AS (SELECT avg(z) FILTER (WHERE p<0.2e0) AS mu, stddev_pop(z) FILTER (WHERE p<0.2e0) AS sigma,
 least(1e0, avg(CASE WHEN p>0.5e0 THEN 1e0 ELSE 0e0 END)/0.5e0) AS pi0 FROM zed),
dens AS (SELECT zed.*, pi0, least(5000e0, greatest(0e0,
 (exp(-((z-mu)/sigma)*((z-mu)/sigma)/2e0)/sigma)/exp(-z*z/2e0))) AS f1 FROM zed, par),
lf AS (SELECT *, pi0/greatest(pi0+(1e0-pi0)*f1,1e-10) AS lfdr FROM dens)"""

POINTS = f"""pts AS (SELECT *, (CASE WHEN group_id IN (0,1) THEN 0 ELSE 1 END)::int AS label,
 CASE WHEN group_id IN (0,1) THEN pow(u,10e0) ELSE u END AS p FROM (
 SELECT vec_id AS id, embedding::double[] AS v, label AS group_id, {uniform_sql('vec_id', 'p|42')} AS u FROM embeddings))"""
