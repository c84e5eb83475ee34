"""Queries over the driver's tables, one for each operator, with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats, transforms
from .functions.rng import uniform, uniform_sql
from .operators import inference, learn, leaves, splits, tensors, trees
from .operators.estimators import CircuitClassifier
from .operators.partition import Partition
from .plans.nodes import Bernoulli, Categorical, ChowLiu, Gaussian, Isotonic, Product, Sum, Uniform, bfs, layers, number, statistics
from .plans.rewrite import marginalize, prune, to_circuit
from .plans.store import edge_table, from_dict, node_table, to_dict
from .sources import energy, recipes
from .sources.matrices import B6, B6_SQL, E4, E4_SQL, b6, drop_correlated, e4, every_assignment, load
from .sources.tables import stream_folder
from .streaming.scoring import score_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LOG2PI = math.log(2 * math.pi)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema])


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def _union(selects) -> str:
    return " UNION ALL ".join(selects)


# --- fixed circuits, shared by Spark and SQL -----------------------------------------------------------------------

MIX_W = [0.5, 0.3, 0.2]
MIX = [((30.0, 12.0), (0.06, 0.03), (0.5, 0.3, 0.2)), ((10.0, 6.0), (0.03, 0.02), (0.2, 0.5, 0.3)), ((45.0, 5.0), (0.08, 0.015), (0.25, 0.25, 0.5))]


def mixture() -> Sum:
    """Three components over l_quantity, l_discount and the coded l_returnflag."""
    return number(Sum(MIX_W, [Product([Gaussian(0, *q), Gaussian(1, *d), Categorical(2, c)]) for q, d, c in MIX]))


def _gauss_sql(x: str, m: float, s: float) -> str:
    return f"(-0.5 * (({x} - {m}) / {s}) * (({x} - {m}) / {s}) - ({math.log(s) + 0.5 * LOG2PI!r}))"


def _lse_sql(terms: list[str]) -> str:
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def _mix_terms() -> list[str]:
    out = []
    for w, (q, d, c) in zip(MIX_W, MIX, strict=True):
        flag = f"CASE l_returnflag WHEN 'A' THEN {math.log(c[0])!r} WHEN 'N' THEN {math.log(c[1])!r} WHEN 'R' THEN {math.log(c[2])!r} END"
        out.append(f"({math.log(w)!r} + {_gauss_sql('l_quantity', *q)} + {_gauss_sql('l_discount', *d)} + {flag})")
    return out


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2)
    return load(spark, d, "lineitem").select("l_linestatus", "l_quantity", "l_discount", flag.alias("flag"))


@query(f"SELECT l_linestatus, count(*) AS n, {_r('avg(ll)')} AS mean_ll FROM (SELECT l_linestatus, {_lse_sql(_mix_terms())} AS ll FROM lineitem) GROUP BY 1")
def score_gaussian_mixture(spark, d):
    scored = inference.log_likelihood(_flagged(spark, d), mixture(), {0: "l_quantity", 1: "l_discount", 2: "flag"}, lowering="columns")
    return _round(scored.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("ll").alias("mean_ll")))


@query(ORACLES["score_gaussian_mixture"])
def score_gaussian_mixture_kernel(spark, d):
    scored = inference.log_likelihood(_flagged(spark, d), mixture(), {0: "l_quantity", 1: "l_discount", 2: "flag"}, lowering="kernel")
    return _round(scored.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("ll").alias("mean_ll")))


#: P(x_i = 1) of the product components of the fixed binary circuit, and weights.
BIN_W = [0.4, 0.35, 0.25]
BIN_P = [[0.7, 0.2, 0.5, 0.9], [0.1, 0.6, 0.3, 0.4], [0.5, 0.8, 0.75, 0.15]]
NAMES4 = {i: c for i, c in enumerate(E4)}


def binary_circuit() -> Sum:
    return number(Sum(BIN_W, [Product([Bernoulli(v, p) for v, p in enumerate(row)]) for row in BIN_P]))


def _masked(spark, d, p=0.3) -> DataFrame:
    return inference.mask_cells(e4(spark, d), E4, "event_id", p, 42)


MASKED_SQL = "SELECT event_id, " + ", ".join(f"CASE WHEN {uniform_sql(42, 'event_id', str(j))} <= 0.3 THEN NULL ELSE x{j} END AS x{j}" for j in range(4)) + f" FROM ({E4_SQL})"


def _bern_sql(x: str, p: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0.0 WHEN {x} = 1 THEN {math.log(p)!r} ELSE {math.log(1 - p)!r} END"


def _bin_terms() -> list[str]:
    return ["(" + " + ".join([repr(math.log(w)), *[_bern_sql(f"x{v}", p) for v, p in enumerate(row)]]) + ")" for w, row in zip(BIN_W, BIN_P, strict=True)]


@query(f"SELECT event_id, {_r(_lse_sql(_bin_terms()))} AS ll FROM ({E4_SQL})")
def evi_spn(spark, d):
    return _round(inference.log_likelihood(e4(spark, d), binary_circuit(), NAMES4).select("event_id", "ll"))


@query(f"SELECT event_id, {_r(_lse_sql(_bin_terms()))} AS ll FROM ({MASKED_SQL})")
def mar_spn(spark, d):
    return _round(inference.log_likelihood(_masked(spark, d), binary_circuit(), NAMES4).select("event_id", "ll"))


@query(ORACLES["mar_spn"])
def mar_spn_kernel(spark, d):
    return _round(inference.log_likelihood(_masked(spark, d), binary_circuit(), NAMES4, lowering="kernel").select("event_id", "ll"))


@query(f"SELECT event_id, {_r(f'exp({_lse_sql(_bin_terms())})', 11)} AS likelihood FROM ({E4_SQL})")
def likelihood_spn(spark, d):
    return _round(inference.likelihood(e4(spark, d), binary_circuit(), NAMES4).select("event_id", "likelihood"), 11)


def _class_circuit(spark, d) -> Sum:
    """A sum over the values of x3 in the events, with the other variables independent below: one aggregate."""
    rows = e4(spark, d).groupBy("x3").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{v}").alias(f"s{v}") for v in range(3)]).orderBy("x3").collect()
    total = sum(r["n"] for r in rows)
    return number(Sum([r["n"] / total for r in rows], [Product([*[Bernoulli(v, (r[f"s{v}"] + 0.1) / (r["n"] + 0.2)) for v in range(3)], Bernoulli(3, float(r["x3"]))]) for r in rows]))


def _normalisation_sql() -> str:
    est = ", ".join(f"(sum(x{v}) + 0.1) / (count(*) + 0.2) AS p{v}" for v in range(3))
    bits = ", ".join(f"(a.range >> {v}) & 1 AS y{v}" for v in range(4))
    one = " * ".join(f"CASE WHEN y{v} = 1 THEN p{v} ELSE 1 - p{v} END" for v in range(3))
    return f"WITH f AS (SELECT x3, count(*) AS n, {est} FROM ({E4_SQL}) GROUP BY x3), w AS (SELECT *, n / sum(n) OVER () AS w FROM f), a AS (SELECT {bits} FROM range(16) a) SELECT round(sum(CASE WHEN y3 = x3 THEN w * {one} ELSE 0 END), 6) AS total, count(DISTINCT (y0, y1, y2, y3)) AS states, round(sum(CASE WHEN y3 = x3 AND y0 = 1 THEN w * {one} ELSE 0 END), 6) AS first FROM a, w"


@query(_normalisation_sql())
def normalisation_check(spark, d):
    """A circuit of the events' counts over all assignments: its total, and the share where the first variable is 1."""
    scored = inference.likelihood(every_assignment(spark, 4, E4), _class_circuit(spark, d), NAMES4)
    return _round(scored.agg(F.sum("likelihood").alias("total"), F.count(F.lit(1)).alias("states"), F.sum(F.when(F.col("x0") == 1, F.col("likelihood")).otherwise(0.0)).alias("first")))


def _argmax_sql(terms: list[str]) -> str:
    top = f"greatest({', '.join(terms)})"
    return "CASE " + " ".join(f"WHEN {t} = {top} THEN {i}" for i, t in enumerate(terms)) + " END"


@query(
    f"WITH m AS ({MASKED_SQL}), s AS (SELECT *, " + ", ".join(f"{t} AS t{i}" for i, t in enumerate(_bin_terms())) + " FROM m), b AS (SELECT *, " + _argmax_sql(["t0", "t1", "t2"]) + " AS b FROM s) SELECT event_id, " + ", ".join(f"CAST(coalesce(x{v}, CASE b " + " ".join(f"WHEN {i} THEN {int(BIN_P[i][v] >= 0.5)}" for i in range(3)) + f" END) AS DOUBLE) AS x{v}" for v in range(4)) + " FROM b"
)
def mpe_spn(spark, d):
    return inference.mpe(_masked(spark, d), binary_circuit(), NAMES4).select("event_id", *E4)


@query(ORACLES["mpe_spn"])
def mpe_spn_kernel(spark, d):
    return inference.mpe(_masked(spark, d), binary_circuit(), NAMES4, lowering="kernel").select("event_id", *E4)


def _peak_leaf(b, n):
    """A leaf of a max-product run: its greatest log density where the cell is missing."""
    return b.where(b.missing(b.x(n.var)), b.const(math.log(max(n.p, 1 - n.p))), n.log(b, b.x))


def _peak_terms() -> list[str]:
    one = lambda x, p: f"CASE WHEN {x} IS NULL THEN {math.log(max(p, 1 - p))!r} WHEN {x} = 1 THEN {math.log(p)!r} ELSE {math.log(1 - p)!r} END"
    return ["(" + " + ".join([repr(math.log(w)), *[one(f"x{v}", p) for v, p in enumerate(row)]]) + ")" for w, row in zip(BIN_W, BIN_P, strict=True)]


@query(f"SELECT event_id, {_r('greatest(' + ', '.join(_peak_terms()) + ')')} AS value FROM ({MASKED_SQL})")
def max_product_spn(spark, d):
    """The probability of the most probable completion, by leaf and node functions of one's own."""
    got = inference.evaluate(_masked(spark, d), binary_circuit(), NAMES4, _peak_leaf, inference.inner_max)
    return _round(got.select("event_id", "value"))


@query(
    f"WITH s AS (SELECT *, " + ", ".join(f"{t} AS t{i}" for i, t in enumerate(_peak_terms())) + f" FROM ({MASKED_SQL})), b AS (SELECT *, " + _argmax_sql(["t0", "t1", "t2"]) + " AS b FROM s) SELECT event_id, " + ", ".join(f"CAST(coalesce(x{v}, CASE b " + " ".join(f"WHEN {i} THEN {int(BIN_P[i][v] >= 0.5)}" for i in range(3)) + f" END) AS DOUBLE) AS x{v}" for v in range(4)) + " FROM b"
)
def max_product_completion(spark, d):
    """The most probable completion itself, in both directions of the kernel."""
    return inference.descend(_masked(spark, d), binary_circuit(), NAMES4, _peak_leaf, inference.inner_max, lowering="kernel").select("event_id", *E4)


def _leaf_ids() -> list[list[int]]:
    return [[leaf.id for leaf in c.children] for c in binary_circuit().children]


@query(
    f"WITH m AS ({MASKED_SQL}), s AS (SELECT *, " + ", ".join(f"{t} AS t{i}" for i, t in enumerate(_bin_terms())) + f" FROM m), z AS (SELECT *, {_lse_sql(['t0', 't1', 't2'])} AS z, {uniform_sql(42, 'event_id', '0')} AS u FROM s), b AS (SELECT *, CASE WHEN u < exp(t0 - z) THEN 0 WHEN u < exp(t0 - z) + exp(t1 - z) THEN 1 ELSE 2 END AS b FROM z) SELECT event_id, "
    + ", ".join(f"CAST(coalesce(x{v}, CASE b " + " ".join(f"WHEN {i} THEN CAST({uniform_sql(42, 'event_id', str(_leaf_ids()[i][v]), '0')} < {BIN_P[i][v]} AS INT)" for i in range(3)) + f" END) AS DOUBLE) AS x{v}" for v in range(4))
    + " FROM b"
)
def sample_spn_md5(spark, d):
    return inference.sample(_masked(spark, d), binary_circuit(), NAMES4, "event_id", 42).select("event_id", *E4)


@query(
    f"WITH s AS (SELECT *, " + ", ".join(f"{t} AS t{i}" for i, t in enumerate(_bin_terms())) + f" FROM ({MASKED_SQL})) SELECT event_id, {_r(_lse_sql(['t0', 't1', 't2']))} AS ll_0, " + ", ".join(f"{_r(repr(math.log(w)))} AS grad_{i + 1}" for i, w in enumerate(BIN_W)) + f", {_r(f't0 - ({_bern_sql("x0", BIN_P[0][0])})')} AS grad_4 FROM s"
)
def gradients_spn(spark, d):
    got = inference.node_values(_masked(spark, d), binary_circuit(), NAMES4, gradients=True)
    return _round(got.select("event_id", "ll_0", "grad_1", "grad_2", "grad_3", "grad_4"))


def fitted_circuit(spark, d) -> Sum:
    """A sum over the return flags of lineitem in their order; below, Gaussian quantity and discount and the share of status
    F, all estimated by one aggregate."""
    value = {0: "l_quantity", 1: "l_discount"}
    sums = [f(c).alias(f"{n}{v}") for v, c in value.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    rows = load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), *sums, F.avg((F.col("l_linestatus") == "F").cast("double")).alias("p")).orderBy("l_returnflag").collect()
    total = sum(r["n"] for r in rows)
    return number(Sum([r["n"] / total for r in rows], [Product([*[Gaussian(v, r[f"m{v}"], r[f"s{v}"]) for v in value], Bernoulli(2, r["p"])]) for r in rows]))


FITTED = (
    "f AS (SELECT l_returnflag AS flag, count(*) AS n, avg(l_quantity) AS m0, stddev_pop(l_quantity) AS s0, avg(l_discount) AS m1, stddev_pop(l_discount) AS s1, "
    "avg(CAST(l_linestatus = 'F' AS DOUBLE)) AS p FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY flag) - 1 AS k, n / sum(n) OVER () AS w, count(*) OVER () AS classes FROM f)"
)


def _moments_sql() -> str:
    raw = {v: [f"m{v}", f"m{v} ** 2 + s{v} ** 2", f"m{v} ** 3 + 3 * m{v} * s{v} ** 2", f"m{v} ** 4 + 6 * m{v} ** 2 * s{v} ** 2 + 3 * s{v} ** 4"] for v in (0, 1)} | {2: ["p"] * 4}
    rows = _union(f"SELECT {v} AS var, " + ", ".join(f"sum(w * ({e})) AS {c}" for c, e in zip("abcd", raw[v], strict=True)) + " FROM k" for v in raw)
    return f"WITH {FITTED}, r AS ({rows}) SELECT var, round(a, 6) AS mean, round(b - a*a, 6) AS variance, round((c - 3*a*b + 2*a**3) / (b - a*a)**1.5, 4) + 0.0 AS skewness, round((d - 4*a*c + 6*a*a*b - 3*a**4) / (b - a*a)**2 - 3, 4) + 0.0 AS kurtosis FROM r"


@query(_moments_sql())
def moments_spn(spark, d):
    found = inference.summary_moments(fitted_circuit(spark, d))
    rows = [(v, round(m["mean"], 6), round(m["variance"], 6), round(m["skewness"], 4), round(m["kurtosis"], 4)) for v, m in found.items()]
    return spark.createDataFrame(rows, "var int, mean double, variance double, skewness double, kurtosis double").withColumns({c: F.col(c) + 0.0 for c in ("skewness", "kurtosis")})


@query("WITH m AS (SELECT avg(l_quantity) AS mu, stddev_pop(l_quantity) AS s FROM lineitem) SELECT round(avg(((l_quantity - mu) / s) ** 3), 4) + 0.0 AS skewness, round(avg(((l_quantity - mu) / s) ** 4) - 3, 4) + 0.0 AS kurtosis FROM lineitem, m")
def skew_kurt_data(spark, d):
    return _round(load(spark, d, "lineitem").agg(F.skewness("l_quantity").alias("skewness"), F.kurtosis("l_quantity").alias("kurtosis")), 4)


# --- statistics ----------------------------------------------------------------------------------------------------


PAIRS = [(i, j) for i in range(6) for j in range(6) if i != j]
COUNTS = "WITH b AS (" + B6_SQL + "), c AS (SELECT count(*) AS n, " + ", ".join(f"sum(x{i} * x{j}) AS c{i}_{j}" for i in range(6) for j in range(i, 6)) + " FROM b)"
_c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
_cell = lambda i, j, k, l: {(1, 1): _c(i, j), (1, 0): f"({_c(i, i)} - {_c(i, j)})", (0, 1): f"({_c(j, j)} - {_c(i, j)})", (0, 0): f"(n - {_c(i, i)} - {_c(j, j)} + {_c(i, j)})"}[k, l]
_prior = lambda i, v: f"(({_c(i, i)} + 0.2) / (n + 0.4))" if v else f"(1 - ({_c(i, i)} + 0.2) / (n + 0.4))"
_joint = lambda i, j, k, l: f"(({_cell(i, j, k, l)} + 0.1) / (n + 0.4))"


@query(f"{COUNTS} " + _union(f"SELECT {i} AS feature, CAST(n - {_c(i, i)} AS BIGINT) AS n0, CAST({_c(i, i)} AS BIGINT) AS n1 FROM c" for i in range(6)))
def prior_counts(spark, d):
    return stats.prior_counts(b6(spark, d), B6)


@query("WITH b AS (" + B6_SQL + ") " + _union(f"SELECT {i} AS i, {j} AS j, {k} AS k, {l} AS l, count(*) FILTER (x{i} = {k} AND x{j} = {l}) AS n FROM b" for i, j in PAIRS for k in (0, 1) for l in (0, 1)))
def joint_counts(spark, d):
    return stats.joint_counts(b6(spark, d), B6)


@query(f"{COUNTS} " + _union(f"SELECT {i} AS i, {j} AS j, {k} AS k, {l} AS l, {_r(_joint(i, j, k, l), 8)} AS p FROM c" for i, j in PAIRS for k in (0, 1) for l in (0, 1)))
def joints_smoothed(spark, d):
    return _round(stats.joints(b6(spark, d), B6), 8)


@query(f"{COUNTS} " + _union(f"SELECT {i} AS feature, {v} AS value, {_r(_prior(i, v), 8)} AS p FROM c" for i in range(6) for v in (0, 1)))
def priors_smoothed(spark, d):
    return _round(stats.priors(b6(spark, d), B6), 8)


@query(f"{COUNTS} " + _union(f"SELECT {i} AS i, {j} AS j, {_r(' + '.join(f'{_joint(i, j, k, l)} * ln({_joint(i, j, k, l)} / ({_prior(i, k)} * {_prior(j, l)}))' for k in (0, 1) for l in (0, 1)), 8)} AS mi FROM c" for i, j in PAIRS))
def mutual_information(spark, d):
    return _round(stats.mutual_information(b6(spark, d), B6), 8)


@query("WITH c AS (SELECT count(*) AS n FROM events GROUP BY event_type) SELECT round(1 - sum(n * n) / (sum(n) * sum(n)), 8) AS gini FROM c")
def gini_index(spark, d):
    codes = F.abs(F.xxhash64("event_type") % 1000003)
    return _round(stats.gini(load(spark, d, "events").select(codes.alias("x")), "x"), 8)


@query("WITH c AS (SELECT count(*)::DOUBLE AS n FROM part GROUP BY p_size) SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 8) AS entropy FROM c")
def entropy_discrete(spark, d):
    return _round(stats.entropy(load(spark, d, "part"), "p_size"), 8)


def _hist_sql(table: str, col: str, rule: str) -> str:
    width = "2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) * count(*)::DOUBLE ** (-1.0 / 3)" if rule == "fd" else f"({24 * math.pi ** 0.5!r} / count(*)) ** (1.0 / 3) * stddev_pop(x)"
    return f"d AS (SELECT {col}::DOUBLE AS x FROM {table}), e AS (SELECT min(x) AS lo, max(x) AS hi, greatest(1, ceil((max(x) - min(x)) / ({width})))::BIGINT AS bins FROM d), k AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS INT) AS bin, count(*) AS n FROM d, e GROUP BY 1), h AS (SELECT CAST(r.range AS INT) AS bin, lo + r.range * (hi - lo) / bins AS lo, lo + (r.range + 1) * (hi - lo) / bins AS hi, coalesce(k.n, 0) AS n, bins FROM e, range(0, (SELECT bins FROM e)) r LEFT JOIN k ON k.bin = r.range)"


@query(f"WITH {_hist_sql('orders', 'o_totalprice', 'fd')} SELECT bin, round(lo, 4) AS lo, round(hi, 4) AS hi, n FROM h")
def fd_histogram(spark, d):
    return _round(stats.histogram(load(spark, d, "orders"), "o_totalprice", "fd"), 4)


@query(f"WITH {_hist_sql('customer', 'c_acctbal', 'scott')} SELECT bin, round(lo, 4) AS lo, round(hi, 4) AS hi, n FROM h")
def scott_histogram(spark, d):
    return _round(stats.histogram(load(spark, d, "customer"), "c_acctbal", "scott"), 4)


@query(f"WITH {_hist_sql('customer', 'c_acctbal', 'scott')} SELECT round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(max(bins)), 6) AS entropy FROM h WHERE n > 0")
def entropy_continuous(spark, d):
    return _round(stats.histogram_entropy(load(spark, d, "customer"), "c_acctbal"))


@query("SELECT DISTINCT l_quantity::DOUBLE AS value, round(cume_dist() OVER (ORDER BY l_quantity), 8) AS p FROM lineitem")
def ecdf(spark, d):
    return _round(stats.ecdf(load(spark, d, "lineitem"), "l_quantity"), 8)


@query("SELECT CAST(chunk AS INT) AS chunk, round(avg(x), 6) AS mean FROM (SELECT l_quantity AS x, ntile(7) OVER (ORDER BY l_quantity) - 1 AS chunk FROM lineitem) GROUP BY 1")
def mean_quantiles(spark, d):
    return _round(stats.mean_quantiles(load(spark, d, "lineitem"), "l_quantity", 7).select(F.col("chunk").cast("int").alias("chunk"), "mean"))


def _gtest_sql() -> str:
    eps, out = stats.EPS32, []
    for i in range(6):
        for j in range(i + 1, 6):
            h = {(k, l): f"({_cell(i, j, k, l)} + {eps!r})" for k in (0, 1) for l in (0, 1)}
            tot = "(" + " + ".join(h.values()) + ")"
            term = lambda k, l, h=h, tot=tot: f"{h[k, l]} * ln({h[k, l]} * {tot} / (({h[k, 0]} + {h[k, 1]}) * ({h[0, l]} + {h[1, l]})))"
            g = "2 * (" + " + ".join(term(k, l) for k in (0, 1) for l in (0, 1)) + ")"
            out.append(f"SELECT {i} AS i, {j} AS j, {_r(g, 4)} AS g, 1 AS dof, ({g}) < 10 AS independent FROM c")
    return f"{COUNTS} " + _union(out)


@query(_gtest_sql())
def gtest_pairs(spark, d):
    return _round(stats.gtest_pairs(b6(spark, d), B6, [2] * 6), 4)


@query("SELECT 'l_quantity' AS name, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, NULL::BIGINT AS size FROM lineitem UNION ALL SELECT 'p_size', NULL, NULL, count(DISTINCT p_size) FROM part")
def domains(spark, d):
    (a,) = stats.domains(load(spark, d, "lineitem"), ["l_quantity"], [False])
    (b,) = stats.domains(load(spark, d, "part"), ["p_size"], [True])
    return spark.createDataFrame([("l_quantity", float(a[0]), float(a[1]), None), ("p_size", None, None, len(b))], "name string, lo double, hi double, size long")


@query(f"SELECT count(*) AS n, {_r('avg(ll)')} AS mean_ll, {_r('2 * stddev_pop(ll) / sqrt(count(*))')} AS two_se FROM (SELECT {_lse_sql(_bin_terms())} AS ll FROM ({E4_SQL}))")
def score_summary(spark, d):
    return _round(stats.score_summary(inference.log_likelihood(e4(spark, d), binary_circuit(), NAMES4), "ll"))


@query(f"SELECT {_r(f'avg(-ll / {math.log(2) * 4!r})')} AS bpp FROM (SELECT {_lse_sql(_bin_terms())} AS ll FROM ({E4_SQL}))")
def bpp(spark, d):
    scored = inference.log_likelihood(e4(spark, d), binary_circuit(), NAMES4)
    return _round(scored.agg(F.avg(stats.bits_per_dimension(F.col("ll"), 4)).alias("bpp")))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, 'l_quantity,l_discount,l_tax,l_extendedprice' AS kept FROM lineitem")
def correlated_columns(spark, d):
    df = load(spark, d, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + 1)
    kept = drop_correlated(df, ["twice", "l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return _round(df.agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.lit(",".join(kept)).alias("kept")))


# --- leaf fits -----------------------------------------------------------------------------------------------------


@query(f"SELECT round((sum(x0) + 0.1) / (count(*) + 0.2), 8) AS p FROM ({B6_SQL})")
def fit_bernoulli(spark, d):
    (leaf,) = leaves.fit_leaves(b6(spark, d), B6, [Bernoulli] * 6, [[0, 1]] * 6, [0])
    return _round(spark.createDataFrame([(leaf.p,)], "p double"), 8)


@query("SELECT CAST(l_returnflag_code AS INT) AS value, round((count(*) + 0.1) / ((SELECT count(*) FROM lineitem) + 0.3), 8) AS p FROM (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_returnflag_code FROM lineitem) GROUP BY 1")
def fit_categorical(spark, d):
    (leaf,) = leaves.fit_leaves(_flagged(spark, d), ["flag"], [Categorical], [[0, 1, 2]], [0])
    return _round(spark.createDataFrame([(i, float(p)) for i, p in enumerate(leaf.probabilities)], "value int, p double"), 8)


@query(f"WITH {_hist_sql('orders', 'o_totalprice', 'fd')} SELECT bin, round((n + 0.1) / ((SELECT count(*) FROM orders) + 0.1 * bins), 8) AS p, round(lo, 4) AS lo FROM h")
def fit_isotonic(spark, d):
    leaf = leaves.fit_isotonic(load(spark, d, "orders"), "o_totalprice", 0)
    return _round(_round(spark.createDataFrame([(i, float(p), float(b)) for i, (p, b) in enumerate(zip(leaf.densities, leaf.breaks))], "bin int, p double, lo double"), 8).withColumn("lo", F.round("lo", 4)), 8)


@query("SELECT min(s_acctbal)::DOUBLE AS start, round(max(s_acctbal) - min(s_acctbal), 6)::DOUBLE AS width FROM supplier")
def fit_uniform(spark, d):
    (leaf,) = leaves.fit_leaves(load(spark, d, "supplier"), ["s_acctbal"], [Uniform], [None], [0])
    return _round(spark.createDataFrame([(leaf.start, leaf.width)], "start double, width double"))


@query("SELECT round(avg(c_acctbal), 4) AS mean, round(greatest(stddev_pop(c_acctbal), 1e-5), 4) AS stddev FROM customer")
def fit_gaussian(spark, d):
    (leaf,) = leaves.fit_leaves(load(spark, d, "customer"), ["c_acctbal"], [Gaussian], [None], [0])
    return _round(spark.createDataFrame([(leaf.mean, leaf.stddev)], "mean double, stddev double"), 4)


# --- leaf densities ------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, {_r(_bern_sql('x0', 0.3))} AS ll FROM ({MASKED_SQL})")
def ll_bernoulli(spark, d):
    return _round(inference.log_likelihood(_masked(spark, d), number(Bernoulli(0, 0.3)), {0: "x0"}).select("event_id", "ll"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_P = [0.1, 0.3, 0.25, 0.15, 0.2]


@query("SELECT o_orderkey, round(CASE substr(o_orderpriority, 1, 1) " + " ".join(f"WHEN '{i + 1}' THEN {math.log(p)!r}" for i, p in enumerate(PRIORITY_P)) + " END, 6) AS ll FROM orders")
def ll_categorical(spark, d):
    code = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    df = load(spark, d, "orders").select("o_orderkey", code.alias("p"))
    return _round(inference.log_likelihood(df, number(Categorical(0, PRIORITY_P)), {0: "p"}).select("o_orderkey", "ll"))


ISO_P, ISO_B = [0.2, 0.5, 0.3], [0.0, 100000.0, 200000.0, 300000.0]


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice <= 0 OR o_totalprice >= 300000 THEN " + repr(math.log(np.finfo(np.float64).eps)) + " WHEN o_totalprice < 100000 THEN " + repr(math.log(0.2 / 1e5)) + " WHEN o_totalprice < 200000 THEN " + repr(math.log(0.5 / 1e5)) + " ELSE " + repr(math.log(0.3 / 1e5)) + " END, 6) AS ll FROM orders")
def ll_isotonic(spark, d):
    return _round(inference.log_likelihood(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), number(Isotonic(0, ISO_P, ISO_B)), {0: "o_totalprice"}).select("o_orderkey", "ll"))


@query(f"SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 AND o_totalprice <= 201000 THEN round({-math.log(200000)!r}, 6) ELSE -1e31 END AS ll FROM orders")
def ll_uniform(spark, d):
    return _round(inference.log_likelihood(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), number(Uniform(0, 1000, 200000)), {0: "o_totalprice"}).select("o_orderkey", "ll"))


@query(f"SELECT o_orderkey, {_r(_gauss_sql('o_totalprice', 150000.0, 80000.0))} AS ll FROM orders")
def ll_gaussian(spark, d):
    return _round(inference.log_likelihood(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), number(Gaussian(0, 150000, 80000)), {0: "o_totalprice"}).select("o_orderkey", "ll"))


# --- transforms ----------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, round((c_acctbal - lo) / (hi - lo) * 2 - 1, 6) + 0.0 AS c_acctbal FROM customer, r")
def normalize_minmax(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return _round(transforms.Normalizer(["c_acctbal"], (-1.0, 1.0)).fit(df).forward(df))


@query("WITH r AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer) SELECT c_custkey, round((c_acctbal - m) / (s + 1e-7), 6) + 0.0 AS c_acctbal FROM customer, r")
def standardize(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return _round(transforms.Standardizer(["c_acctbal"]).fit(df).forward(df))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INT) AS s_{k}" for k, v in enumerate("FOP")) + " FROM orders")
def one_hot(spark, d):
    return load(spark, d, "orders").select("o_orderkey", *transforms.one_hot("o_orderstatus", list("FOP"), "s"))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INT) AS o_orderstatus_{k}" for k, v in enumerate("FOP")) + ", o_totalprice FROM orders")
def mixed_one_hot(spark, d):
    return load(spark, d, "orders").select("o_orderkey", *transforms.mixed_one_hot(["o_orderstatus", "o_totalprice"], [list("FOP"), (0.0, 1.0)]))


@query("SELECT o_orderkey, round(greatest(least(floor(o_totalprice / 500000 * 32), 31), 0) / 31.0, 8) AS q FROM orders")
def quantize(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000).alias("q"))
    return _round(transforms.Quantizer(["q"], 5).forward(df), 8)


@query("WITH x AS (SELECT c_custkey, (c_acctbal + 1000) / 12000 AS x FROM customer) SELECT c_custkey, round(ln((0.05 + 0.9 * x) / (1 - 0.05 - 0.9 * x)), 6) + 0.0 AS x, round(-ln(0.05 + 0.9 * x) - ln(1 - 0.05 - 0.9 * x) + ln(0.9), 6) + 0.0 AS log_det FROM x")
def logit_transform(spark, d):
    df = load(spark, d, "customer").select("c_custkey", ((F.col("c_acctbal") + 1000) / 12000).alias("x"))
    t = transforms.Logit(["x"])
    return _round(t.forward(df.withColumn("log_det", t.log_det())).select("c_custkey", "x", "log_det"))


@query("WITH r AS (SELECT avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem) SELECT l_orderkey, round(avg((l_quantity - m) / sqrt(v + 1e-5)), 5) + 0.0 AS y FROM lineitem, r GROUP BY 1")
def batchnorm_affine(spark, d):
    df = load(spark, d, "lineitem")
    r = df.agg(F.avg("l_quantity").alias("m"), F.var_samp("l_quantity").alias("v")).first()
    layer = tensors.BatchNorm(1)
    layer.set_moments([r["m"]], [r["v"]])
    made = tensors.encode(df.select("l_orderkey", F.col("l_quantity").cast("double").alias("y")), tensors.Flow(1, [layer]), ["y"])
    return _round(made.groupBy("l_orderkey").agg(F.avg("y").alias("y")), 5)


@query("SELECT vec_id, round(embedding[64]::DOUBLE, 6) AS last, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)), 4) + 0.0 AS s FROM embeddings")
def reshape_flatten(spark, d):
    rows = transforms.reshape("embedding", 4, 16)
    df = load(spark, d, "embeddings").select("vec_id", rows.alias("m"))
    s = F.aggregate(F.transform(F.col("m")[0], lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.round(F.element_at(F.flatten("m"), 64).cast("double"), 6).alias("last"), (F.round(s, 4) + 0.0).alias("s"))


@query("SELECT vec_id, round((CASE WHEN " + uniform_sql(42, "vec_id") + " < 0.5 THEN embedding[64] ELSE embedding[1] END)::DOUBLE, 6) + 0.0 AS first FROM embeddings")
def random_flip(spark, d):
    df = load(spark, d, "embeddings")
    return df.select("vec_id", (F.round(F.element_at(transforms.random_flip("embedding", "vec_id"), 1).cast("double"), 6) + 0.0).alias("first"))


@query("SELECT vec_id, round(embedding[9]::DOUBLE, 6) + 0.0 AS a, round(embedding[10]::DOUBLE, 6) + 0.0 AS b FROM embeddings")
def squeeze_depth(spark, d):
    # channel 2 holds the lower left corners: its first cell is row 1, column 0; channel 3 begins with row 1, column 1
    df = load(spark, d, "embeddings").select("vec_id", transforms.squeeze("embedding", 1, 8, 8).alias("s"))
    return df.select("vec_id", (F.round(F.element_at("s", 33).cast("double"), 6) + 0.0).alias("a"), (F.round(F.element_at("s", 49).cast("double"), 6) + 0.0).alias("b"))


# --- partitions and slices -----------------------------------------------------------------------------------------


@query(f"SELECT x4, x5, count(*) AS n FROM ({B6_SQL}) GROUP BY ALL HAVING count(*) >= 10")
def conj_counts(spark, d):
    return Partition(tuple(range(6))).assignments(b6(spark, d), B6, (4, 5), 10)


@query(f"SELECT x4 + 2 * x5 AS __cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 8) AS weight FROM ({B6_SQL}) GROUP BY 1")
def slice_weights(spark, d):
    return _round(splits.slice_weights(b6(spark, d).withColumn(splits.OUT, F.col("x4") + 2 * F.col("x5"))), 8)


@query(f"WITH g AS (SELECT x0, x1, x2, x3, count(*) AS n FROM ({E4_SQL}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, x0, x1, x2, x3) - 1 AS c FROM g WHERE n >= 5) SELECT event_id, CAST(coalesce(c, -1) AS INT) AS cluster FROM ({E4_SQL}) LEFT JOIN r USING (x0, x1, x2, x3)")
def dbscan_discrete(spark, d):
    df = splits.dbscan(e4(spark, d), E4, [Bernoulli] * 4, [[0, 1]] * 4, [0, 1, 2, 3], "event_id")
    return df.select("event_id", F.col(splits.OUT).alias("cluster"))


_BETA = float(np.random.default_rng(42).beta(2, 2))


@query(f"SELECT event_id, CAST({uniform_sql(42, 'event_id')} < {_BETA!r} AS INT) AS part FROM events")
def random_rows_md5(spark, d):
    df = splits.random_rows(e4(spark, d), E4, None, None, [0, 1, 2, 3], "event_id", 42)
    return df.select("event_id", F.col(splits.OUT).alias("part"))


@query(f"SELECT x0, x1, x2, count(*) AS n, round((count(*) + 0.01) / ((SELECT count(*) FROM lineitem) + 0.08), 8) AS w FROM ({B6_SQL}) GROUP BY ALL")
def unique_rows_disjunction(spark, d):
    df = b6(spark, d)
    counts = Partition(tuple(range(6))).assignments(df, B6, (0, 1, 2))
    root = learn.disjunction({tuple(r[c] for c in B6[:3]): r["n"] for r in counts.collect()}, (0, 1, 2), 0.01)
    scored = inference.log_likelihood(counts, number(root), dict(enumerate(B6[:3])))
    return _round(scored.select(*B6[:3], "n", F.exp("ll").alias("w")), 8)


@query(f"SELECT x0, x1, x2, x3, count(*) AS n FROM ({B6_SQL}) WHERE x4 = 1 AND x5 = 0 GROUP BY ALL")
def partition_slice(spark, d):
    part = Partition(tuple(range(6))).split_rows((4, 5), [(1, 0)])[1].split_cols((0, 1, 2, 3))[0]
    return part.slice(b6(spark, d), B6).groupBy("x0", "x1", "x2", "x3").agg(F.count(F.lit(1)).alias("n"))


# --- trees ---------------------------------------------------------------------------------------------------------

TREE = [-1, 0, 1, 1]
TREE_P = np.log(np.array([[[0.6, 0.4]] * 2, [[0.7, 0.3], [0.2, 0.8]], [[0.9, 0.1], [0.35, 0.65]], [[0.5, 0.5], [0.15, 0.85]]]))


def fixed_tree() -> ChowLiu:
    return number(ChowLiu([0, 1, 2, 3], TREE, TREE_P.copy()))


def _lp(j: int, l: int, k: int) -> str:
    return repr(float(TREE_P[j, l, k]))


def _tree_sum_sql() -> str:
    root = f"CASE WHEN x0 = 1 THEN {_lp(0, 0, 1)} ELSE {_lp(0, 0, 0)} END"
    rest = [f"CASE WHEN x{p} = 1 THEN (CASE WHEN x{j} = 1 THEN {_lp(j, 1, 1)} ELSE {_lp(j, 1, 0)} END) ELSE (CASE WHEN x{j} = 1 THEN {_lp(j, 0, 1)} ELSE {_lp(j, 0, 0)} END) END" for j, p in enumerate(TREE) if p >= 0]
    return " + ".join([root, *rest])


def _complete_sql(agg: str) -> str:
    """Log of the sum over all completions of the masked cells."""
    return f"SELECT event_id, {agg} FROM ({MASKED_SQL}) m JOIN (SELECT a.range AS x0, b.range AS x1, c.range AS x2, d.range AS x3 FROM range(2) a, range(2) b, range(2) c, range(2) d) f ON (m.x0 IS NULL OR m.x0 = f.x0) AND (m.x1 IS NULL OR m.x1 = f.x1) AND (m.x2 IS NULL OR m.x2 = f.x2) AND (m.x3 IS NULL OR m.x3 = f.x3)"


_FULL = _tree_sum_sql().replace("x0", "f.x0").replace("x1", "f.x1").replace("x2", "f.x2").replace("x3", "f.x3")


@query(f"SELECT event_id, {_r(_tree_sum_sql())} AS ll FROM ({E4_SQL})")
def clt_evi(spark, d):
    return _round(inference.log_likelihood(e4(spark, d), fixed_tree(), NAMES4).select("event_id", "ll"))


@query(_complete_sql(f"{_r(f'ln(sum(exp({_FULL})))')} AS ll") + " GROUP BY 1")
def clt_mar(spark, d):
    return _round(inference.log_likelihood(_masked(spark, d), fixed_tree(), NAMES4).select("event_id", "ll"))


@query(_complete_sql(f"{_r(f'max({_FULL})')} AS ll") + " GROUP BY 1")
def clt_mpe(spark, d):
    filled = inference.mpe(_masked(spark, d), fixed_tree(), NAMES4)
    return _round(inference.log_likelihood(filled, fixed_tree(), NAMES4).select("event_id", "ll"))


@query(ORACLES["clt_evi"])
def clt_join_scoring(spark, d):
    return _round(trees.tree_table(e4(spark, d), fixed_tree(), NAMES4, "event_id"))


@query(ORACLES["clt_mar"])
def clt_to_pc_equivalence(spark, d):
    return _round(inference.log_likelihood(_masked(spark, d), to_circuit(fixed_tree()), NAMES4).select("event_id", "ll"))


@query(f"{COUNTS} " + _union(f"SELECT {j} AS var, {l} AS l, {k} AS k, {_r(f'({_joint(j, p, k, l)} / {_prior(p, l)}) / (({_joint(j, p, 0, l)} + {_joint(j, p, 1, l)}) / {_prior(p, l)})' if p >= 0 else _prior(j, k), 8)} AS p FROM c" for j, p in enumerate([-1, 0, 0, 1, 3, 4]) for l in (0, 1) for k in (0, 1)))
def clt_cpt(spark, d):
    n, m = stats.pair_counts(b6(spark, d), B6)
    t = trees.tree_from_counts(n, m, list(range(6)), 0.1, parent=[-1, 0, 0, 1, 3, 4])
    return _round(spark.createDataFrame([(j, l, k, float(np.exp(t.logp[j, l, k]))) for j in range(6) for l in (0, 1) for k in (0, 1)], "var int, l int, k int, p double"), 8)


@query(f"SELECT event_id, {_r('CASE WHEN x0 = 1 THEN ln(0.4) + ' + _bern_sql('x1', 0.3) + ' + ' + _bern_sql('x2', 0.8) + ' + ' + _bern_sql('x3', 0.5) + ' ELSE ln(0.6) + ' + _bern_sql('x1', 0.6) + ' + ' + _bern_sql('x2', 0.1) + ' + ' + _bern_sql('x3', 0.9) + ' END')} AS ll FROM ({E4_SQL})")
def cnet_evi(spark, d):
    part = lambda v, ps: Product([Bernoulli(0, float(v)), Product([Bernoulli(i + 1, p) for i, p in enumerate(ps)])])
    net = number(Sum([0.6, 0.4], [part(0, [0.6, 0.1, 0.9]), part(1, [0.3, 0.8, 0.5])]))
    return _round(inference.log_likelihood(e4(spark, d), net, NAMES4).select("event_id", "ll"))


def _gain_sql(a1: str, a2: str) -> list[str]:
    h = lambda p: f"(-({p}) * ln({p}) - (1 - ({p})) * ln(1 - ({p})))"
    mean = "(" + " + ".join(h(f"({_c(i, i)} + {a1}) / (n + {a2})") for i in range(6)) + ") / 6"
    out = []
    for i in range(6):
        rest = [j for j in range(6) if j != i]
        on = "(" + " + ".join(h(f"({_c(i, j)} + {a1}) / ({_c(i, i)} + {a2})") for j in rest) + ") / 5"
        off = "(" + " + ".join(h(f"({_c(j, j)} - {_c(i, j)} + {a1}) / (n - {_c(i, i)} + {a2})") for j in rest) + ") / 5"
        out.append(f"SELECT {i} AS var, {mean} - ({_c(i, i)} / n * {on} + (1 - {_c(i, i)} / n) * {off}) AS gain FROM c")
    return out


@query(f"{COUNTS} SELECT var, round(gain, 8) AS gain FROM (" + _union(_gain_sql("0.02", "0.04")) + ")")
def cnet_entropy_gain(spark, d):
    n, m = stats.pair_counts(b6(spark, d), B6)
    _, gains = stats.entropy_gains(n, m, 0.02, 0.04)
    return _round(spark.createDataFrame([(i, float(g)) for i, g in enumerate(gains)], "var int, gain double"), 8)


@query(f"{COUNTS} SELECT var FROM (" + _union(_gain_sql("0.05", "0.1")) + ") ORDER BY gain DESC, var LIMIT 3")
def cand_cuts_topk(spark, d):
    n, m = stats.pair_counts(b6(spark, d), B6)
    return spark.createDataFrame([(i,) for i in trees.candidate_cuts(n, m, 0.1, 3)], "var int")


@query(f"{COUNTS} " + _union(f"SELECT {i} AS var, round(lgamma(0.1) - lgamma(n + 0.1) + lgamma(n - {_c(i, i)} + 0.05) + lgamma({_c(i, i)} + 0.05) - 2 * lgamma(0.05), 4) AS score FROM c" for i in range(6)))
def bdeu_or_scores(spark, d):
    n, m = stats.pair_counts(b6(spark, d), B6)
    return _round(spark.createDataFrame([(i, float(s)) for i, s in enumerate(stats.bdeu_roots(n, m, 0.1))], "var int, score double"), 4)


def _bdeu_pair(i: int, j: int) -> str:
    out = []
    for l in (0, 1):
        total = _c(j, j) if l else f"(n - {_c(j, j)})"
        out.append(f"lgamma(0.05) - lgamma({total} + 0.05) + lgamma({_cell(i, j, 0, l)} + 0.025) + lgamma({_cell(i, j, 1, l)} + 0.025) - 2 * lgamma(0.025)")
    return " + ".join(out)


@query(f"{COUNTS} " + _union(f"SELECT {i} AS i, {j} AS j, round({_bdeu_pair(i, j)}, 4) AS score FROM c" for i, j in PAIRS))
def bdeu_pair_scores(spark, d):
    n, m = stats.pair_counts(b6(spark, d), B6)
    s = stats.bdeu_pairs(n, m, 0.1)
    return _round(spark.createDataFrame([(i, j, float(s[i, j])) for i, j in PAIRS], "i int, j int, score double"), 4)


# --- learning, rewriting, classification ---------------------------------------------------------------------------


def _em_sql() -> str:
    t = ", ".join(f"{x} AS t{i}" for i, x in enumerate(_bin_terms()))
    w = ", ".join(f"sum(exp(t{i} - z)) AS s{i}, " + ", ".join(f"sum(exp(t{i} - z) * x{v}) AS s{i}_{v}" for v in range(4)) for i in range(3))
    head = f"WITH s AS (SELECT *, {t} FROM ({E4_SQL})), z AS (SELECT *, {_lse_sql(['t0', 't1', 't2'])} AS z FROM s), e AS (SELECT {w} FROM z)"
    a = float(np.finfo(np.float16).eps)
    rows = [f"SELECT 'w{i}' AS name, 0.5 * {BIN_W[i]} + 0.5 * s{i} / (s0 + s1 + s2) AS value FROM e" for i in range(3)]
    rows += [f"SELECT 'p{i}_{v}', 0.5 * {BIN_P[i][v]} + 0.5 * (s{i}_{v} + {a!r}) / (s{i} + 2 * {a!r}) FROM e" for i in range(3) for v in range(4)]
    return f"{head} SELECT name, round(value, 6) AS value FROM (" + _union(rows) + ")"


@query(_em_sql())
def em_one_step(spark, d):
    c = binary_circuit()
    learn.expectation_maximisation(e4(spark, d), c, NAMES4, iterations=1, step=0.5)
    rows = [(f"w{i}", float(w)) for i, w in enumerate(c.weights)] + [(f"p{i}_{leaf.var}", leaf.p) for i, p in enumerate(c.children) for leaf in p.children]
    return _round(spark.createDataFrame(rows, "name string, value double"))


def _em_mixture_sql() -> str:
    t = ", ".join(f"{x} AS t{i}" for i, x in enumerate(_mix_terms()))
    cells = ["l_quantity", "l_discount"]
    post = lambda i: f"exp(t{i} - z)"
    sums = []
    for i in range(3):
        sums.append(f"sum({post(i)}) AS s{i}")
        sums += [f"sum({post(i)} * {c}) AS s{i}_{v}, sum({post(i)} * {c} * {c}) AS q{i}_{v}" for v, c in enumerate(cells)]
        sums += [f"sum(CASE WHEN l_returnflag = '{f}' THEN {post(i)} ELSE 0 END) AS c{i}_{k}" for k, f in enumerate("ANR")]
    head = f"WITH s AS (SELECT *, {t} FROM lineitem), z AS (SELECT *, {_lse_sql(['t0', 't1', 't2'])} AS z FROM s), e AS (SELECT {', '.join(sums)} FROM z)"
    a = float(np.finfo(np.float16).eps)
    rows = [f"SELECT 'w{i}' AS name, 0.5 * {MIX_W[i]} + 0.5 * s{i} / (s0 + s1 + s2) AS value FROM e" for i in range(3)]
    for i, (q, d, c) in enumerate(MIX):
        for v, (m, sd) in enumerate((q, d)):
            rows += [f"SELECT 'm{i}_{v}', 0.5 * {m} + 0.5 * s{i}_{v} / s{i} FROM e", f"SELECT 'd{i}_{v}', 0.5 * {sd} + 0.5 * sqrt(q{i}_{v} / s{i} - (s{i}_{v} / s{i}) ** 2) FROM e"]
        rows += [f"SELECT 'c{i}_{k}', 0.5 * {c[k]} + 0.5 * (c{i}_{k} + {a!r}) / (s{i} + 3 * {a!r}) FROM e" for k in range(3)]
    return f"{head} SELECT name, round(value, 6) AS value FROM (" + _union(rows) + ")"


@query(_em_mixture_sql())
def em_mixture_step(spark, d):
    """One step over Gaussian and categorical leaves."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2)
    df, root = load(spark, d, "lineitem").select("l_quantity", "l_discount", flag.alias("flag")), mixture()
    learn.expectation_maximisation(df, root, {0: "l_quantity", 1: "l_discount", 2: "flag"}, iterations=1, step=0.5)
    rows = [(f"w{i}", float(w)) for i, w in enumerate(root.weights)]
    for i, part in enumerate(root.children):
        *normal, flags = part.children
        rows += [(f"{name}{i}_{v}", float(x)) for v, g in enumerate(normal) for name, x in (("m", g.mean), ("d", g.stddev))]
        rows += [(f"c{i}_{k}", float(p)) for k, p in enumerate(flags.probabilities)]
    return _round(spark.createDataFrame(rows, "name string, value double"))


#: Two trees over four binary variables, as P(1 | parent = 0) and P(1 | parent = 1).
TREES = [([-1, 0, 0, 1], [(0.6, 0.6), (0.2, 0.7), (0.4, 0.55), (0.3, 0.9)]), ([2, 2, -1, 0], [(0.35, 0.5), (0.8, 0.1), (0.45, 0.45), (0.65, 0.25)])]
TREE_W = [0.7, 0.3]


def _em_tree_sql() -> str:
    def ll(parent, table):
        one = lambda p: f"CASE WHEN x{{i}} = 1 THEN {math.log(p)!r} ELSE {math.log(1 - p)!r} END"
        cell = lambda i, p: one(table[i][0]).format(i=i) if p < 0 else f"CASE WHEN x{p} = 1 THEN {one(table[i][1]).format(i=i)} ELSE {one(table[i][0]).format(i=i)} END"
        return " + ".join(f"({cell(i, p)})" for i, p in enumerate(parent))

    t = ", ".join(f"{math.log(w)!r} + {ll(*tree)} AS t{k}" for k, (w, tree) in enumerate(zip(TREE_W, TREES, strict=True)))
    sums = []
    for k, (parent, _) in enumerate(TREES):
        post = f"exp(t{k} - z)"
        sums += [f"sum({post}) AS s{k}"] + [f"sum({post} * x{i}) AS s{k}_{i}" for i in range(4)] + [f"sum({post} * x{i} * x{p}) AS j{k}_{i}" for i, p in enumerate(parent) if p >= 0]
    a = float(np.finfo(np.float16).eps)
    rows = [f"SELECT {k} AS tree, -1 AS var, 0 AS given, 0.5 * {w} + 0.5 * s{k} / (s0 + s1) AS p FROM e" for k, w in enumerate(TREE_W)]
    for k, (parent, table) in enumerate(TREES):
        prior = lambda i, k=k: f"((s{k}_{i} + 2 * {a!r}) / (s{k} + 4 * {a!r}))"
        for i, p in enumerate(parent):
            for given in (0, 1):
                if p < 0:
                    new = prior(i)
                else:
                    got, share = (f"j{k}_{i}", prior(p)) if given else (f"(s{k}_{i} - j{k}_{i})", f"(1 - {prior(p)})")
                    new = f"({got} + {a!r}) / (s{k} * {share} + 4 * {a!r})"
                rows.append(f"SELECT {k}, {i}, {given}, 0.5 * {table[i][given]} + 0.5 * {new} FROM e")
    return f"WITH s AS (SELECT *, {t} FROM ({E4_SQL})), z AS (SELECT *, {_lse_sql(['t0', 't1'])} AS z FROM s), e AS (SELECT {', '.join(sums)} FROM z) SELECT tree, var, given, round(p, 6) AS p FROM (" + _union(rows) + ")"


@query(_em_tree_sql())
def em_tree_step(spark, d):
    """One step over a mixture of two trees: var -1 has the weights."""
    leaf = lambda parent, table: ChowLiu([0, 1, 2, 3], parent, np.log([[[1 - p, p] for p in row] for row in table]))
    root = number(Sum(TREE_W, [leaf(*t) for t in TREES]))
    learn.expectation_maximisation(e4(spark, d), root, NAMES4, iterations=1, step=0.5)
    rows = [(k, -1, 0, float(w)) for k, w in enumerate(root.weights)]
    rows += [(k, i, g, float(np.exp(tree.logp[i, g, 1]))) for k, tree in enumerate(root.children) for i in range(4) for g in (0, 1)]
    return _round(spark.createDataFrame(rows, "tree int, var int, given int, p double"))


def _nested():
    a, b, c = (Product([Bernoulli(v, p) for v, p in enumerate(row)]) for row in BIN_P)
    inner = Sum([BIN_W[1] / (BIN_W[1] + BIN_W[2]), BIN_W[2] / (BIN_W[1] + BIN_W[2])], [b, c])
    left, right = Product(a.children[:2]), Product(a.children[2:])
    return number(Sum([BIN_W[0], BIN_W[1] + BIN_W[2]], [Product([left, right]), Sum([1.0], [inner])]))


@query(ORACLES["mar_spn"])
def prune_equivalence(spark, d):
    return _round(inference.log_likelihood(_masked(spark, d), prune(_nested()), NAMES4).select("event_id", "ll"))


@query(f"SELECT event_id, {_r(_lse_sql(['(' + repr(math.log(w)) + ' + ' + _bern_sql('x1', row[1]) + ' + ' + _bern_sql('x3', row[3]) + ')' for w, row in zip(BIN_W, BIN_P, strict=True)]))} AS ll FROM ({E4_SQL})")
def marginalize_equivalence(spark, d):
    return _round(inference.log_likelihood(e4(spark, d), marginalize(binary_circuit(), [1, 3]), NAMES4).select("event_id", "ll"))


@query(ORACLES["mar_spn"])
def json_round_trip(spark, d):
    return _round(inference.log_likelihood(_masked(spark, d), from_dict(to_dict(binary_circuit())), NAMES4).select("event_id", "ll"))


@query(f"WITH {FITTED}, c AS (SELECT max(classes) AS c FROM k) " + _union(f"SELECT '{name}' AS name, CAST({e} AS INTEGER) AS value FROM c" for name, e in (("depth", "2"), ("n_edges", "4 * c"), ("n_leaves", "3 * c"), ("n_nodes", "1 + 4 * c"), ("n_params", "6 * c"), ("n_prod", "c"), ("n_sum", "1"))))
def circuit_statistics(spark, d):
    return spark.createDataFrame(sorted(statistics(fitted_circuit(spark, d)).items()), "name string, value int")


@query(f"WITH {FITTED} SELECT 0::BIGINT AS parent, k + 1 AS child, k AS idx, round(w, 8) AS weight FROM k UNION ALL SELECT k + 1, 1 + classes + 3 * k + i, i, NULL FROM k, range(3) b(i)")
def circuit_edges(spark, d):
    made = edge_table(spark, fitted_circuit(spark, d))
    return made.select(*[F.col(c).cast("long").alias(c) for c in ("parent", "child", "idx")], F.round("weight", 8).alias("weight"))


@query(f"WITH {FITTED} SELECT 0::BIGINT AS id, 0::BIGINT AS layer UNION ALL SELECT k + 1, 1 FROM k UNION ALL SELECT 1 + classes + 3 * k + i, 2 FROM k, range(3) b(i)")
def topological_layers(spark, d):
    return spark.createDataFrame([(n.id, k) for k, layer in enumerate(layers(fitted_circuit(spark, d))) for n in layer], "id long, layer long")


@query(f"WITH {FITTED}, c AS (SELECT max(classes) AS c FROM k) " + _union(f"SELECT '{name}' AS class, CAST({e} AS INTEGER) AS n FROM c" for name, e in (("Bernoulli", "c"), ("Gaussian", "2 * c"), ("Product", "c"), ("Sum", "1"))))
def nodes_by_type(spark, d):
    return node_table(spark, fitted_circuit(spark, d)).groupBy("class").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _bayes_sql() -> str:
    head = f"WITH b AS (SELECT *, (event_id % 5 = 0) AS held FROM ({E4_SQL})), f AS (SELECT x3 AS y, count(*) AS n, " + ", ".join(f"(sum(x{v}) + 0.1) / (count(*) + 0.2) AS p{v}" for v in range(3)) + " FROM b GROUP BY x3), w AS (SELECT *, n / sum(n) OVER () AS w FROM f)"
    ll = " + ".join(["ln(w)", *[f"CASE WHEN x{v} = 1 THEN ln(p{v}) ELSE ln(1 - p{v}) END" for v in range(3)]])
    return f"{head}, s AS (SELECT event_id, y, {ll} AS ll FROM b, w) SELECT event_id, round(max(exp(ll)) FILTER (y = 1) / sum(exp(ll)), 6) AS p1 FROM s GROUP BY 1"


def _naive_bayes(spark, d):
    """Rows with probability, prediction and the class itself, by a classifier whose slices are too small to split."""
    df = e4(spark, d)
    model = CircuitClassifier(E4, [Bernoulli] * 4, [[0, 1]] * 4, "event_id", min_rows=2**62).fit(df)
    return model.transform(df.withColumn("actual", F.col("x3")))


@query(_bayes_sql())
def naive_bayes_classifier(spark, d):
    scored = _naive_bayes(spark, d)
    return _round(scored.select("event_id", F.element_at("probability", 2).alias("p1")))


def _report_sql() -> str:
    ratio = lambda x, y: f"CASE WHEN {y} > 0 THEN {x} / {y} ELSE 0 END"
    return f"""WITH p AS ({_bayes_sql()}), b AS (SELECT x3 AS a, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS p FROM ({E4_SQL}) JOIN p USING (event_id)),
        l AS (SELECT DISTINCT a AS c FROM b UNION SELECT DISTINCT p FROM b),
        k AS (SELECT c, count(*) FILTER (a = c) AS support, count(*) FILTER (p = c) AS given, count(*) FILTER (a = c AND p = c) AS hit FROM b, l GROUP BY c),
        r AS (SELECT *, {ratio("hit", "given")} AS pr, {ratio("hit", "support")} AS re FROM k), f AS (SELECT *, {ratio("2 * pr * re", "(pr + re)")} AS f1 FROM r),
        o AS (SELECT CAST(c AS VARCHAR) AS label, pr, re, f1, support FROM f
        UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f
        UNION ALL SELECT 'macro', avg(pr), avg(re), avg(f1), sum(support) FROM f
        UNION ALL SELECT 'weighted', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
        SELECT label, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM o"""


@query(_report_sql())
def classification_report(spark, d):
    return _round(stats.classification_report(_naive_bayes(spark, d), "actual", "prediction"))


# --- learned circuits: no fixed SQL, checked by properties in the tests -------------------------------------------


def _events_mixed(spark, d):
    code = {"click": 0, "view": 1, "purchase": 2}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in code.items()], F.lit(3))
    return load(spark, d, "events").select("event_id", F.col("value").cast("double").alias("v"), kind.alias("k"), (F.col("user_id") % 2).cast("int").alias("u"))


def _learned(spark, d, **args):
    df = _events_mixed(spark, d)
    root = learn.learn_spn(df, ["v", "k", "u"], [Gaussian, Categorical, Bernoulli], [None, [0, 1, 2, 3], [0, 1]], "event_id", **({"min_rows": 2000} | args))
    return _round(inference.log_likelihood(df, prune(root), {0: "v", 1: "k", 2: "u"}).select("event_id", "ll"))


@query()
def learn_spn_kmeans_rdc(spark, d):
    return _learned(spark, d, split_rows="kmeans", split_cols="rdc")


@query()
def learn_spn_gmm_random(spark, d):
    return _learned(spark, d, split_rows="gmm", split_cols="random")


@query()
def learn_spn_gvs(spark, d):
    df = e4(spark, d)
    root = learn.learn_spn(df, E4, [Bernoulli] * 4, [[0, 1]] * 4, "event_id", learn_leaf="binary-clt", split_rows="random", split_cols="gvs", min_rows=1500)
    return _round(inference.log_likelihood(df, prune(root), NAMES4).select("event_id", "ll"))


@query()
def learned_classifier(spark, d):
    df = e4(spark, d)
    root = learn.learn_classifier(df, E4, [Bernoulli] * 4, 3, [[0, 1]] * 4, "event_id", split_rows="random", split_cols="gvs", min_rows=4000)
    return inference.mpe(df.withColumn("x3", F.lit(None).cast("double")), root, NAMES4).select("event_id", F.col("x3").alias("predicted"))


@query()
def kmeans_rows(spark, d):
    df = splits.kmeans(_events_mixed(spark, d), ["v", "k", "u"], [Gaussian, Categorical, Bernoulli], [(0, 1), [0, 1, 2, 3], [0, 1]], [0, 1, 2], "event_id")
    return splits.slice_weights(df)


#: Slopes and offsets of two features for each of three columns.
RDC_W = [((0.9, -0.4), (0.2, 0.1)), ((1.3, 0.5), (-0.3, 0.6)), ((-0.7, 2.0), (0.0, 0.4))]
RDC_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _rdc_sql() -> str:
    ranks = ", ".join(f"cume_dist() OVER (ORDER BY {c}) AS r{i}" for i, c in enumerate(RDC_COLS))
    cells = [f"sin({w[j]!r} * r{i} + ({b[j]!r}))" for i, (w, b) in enumerate(RDC_W) for j in (0, 1)]
    rows = [f"SELECT {i} AS i, {j} AS j, {_r(f'avg(f{i} * f{j}) - avg(f{i}) * avg(f{j})', 8)} AS cov FROM f" for i in range(6) for j in range(i, 6)]
    return f"WITH r AS (SELECT {ranks} FROM lineitem), f AS (SELECT {', '.join(f'{c} AS f{i}' for i, c in enumerate(cells))} FROM r) " + _union(rows)


@query(_rdc_sql())
def rdc_covariances(spark, d):
    """Covariances of the rank features that the dependence coefficient is worked out from, for fixed weights."""
    made, names = splits.rdc_features(load(spark, d, "lineitem").select(*RDC_COLS), RDC_COLS, RDC_W)
    n, g = stats.gram(made.withColumn("__one", F.lit(1.0)), [*names, "__one"])
    mean = g[-1, :-1] / n
    cov = g[:-1, :-1] / n - np.outer(mean, mean)
    return _round(spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(6) for j in range(i, 6)], "i int, j int, cov double"), 8)


@query()
def rdc_pairs(spark, d):
    s = splits.rdc_scores(load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])
    return _round(spark.createDataFrame([(i, j, float(s[i, j])) for i in range(3) for j in range(i + 1, 3)], "i int, j int, rdc double"))


@query()
def xpc_score(spark, d):
    df = e4(spark, d)
    return _round(inference.log_likelihood(df, prune(learn.learn_xpc(df, E4, det=True, conj=2, arity=3)), NAMES4).select("event_id", "ll"))


@query()
def ensemble_xpc_score(spark, d):
    df = e4(spark, d)
    return _round(inference.log_likelihood(df, learn.learn_ensemble(df, E4, 3, 2, conj=2), NAMES4).select("event_id", "ll"))


@query()
def cnet_score(spark, d):
    df = e4(spark, d)
    return _round(inference.log_likelihood(df, trees.learn_cnet(df, E4), NAMES4).select("event_id", "ll"))


@query()
def cnet_bd_score(spark, d):
    df = e4(spark, d)
    return _round(inference.log_likelihood(df, trees.learn_cnet_bd(df, E4), NAMES4).select("event_id", "ll"))


@query()
def cnet_bic_score(spark, d):
    df = e4(spark, d)
    return _round(inference.log_likelihood(df, trees.learn_cnet_bic(df, E4), NAMES4).select("event_id", "ll"))


def _em_fit_sql(iterations: int = 5, step: float = 0.9) -> str:
    """Every step's parameters are the columns of one row."""
    a = float(np.finfo(np.float16).eps)
    one = lambda i, v: f"ln(CASE WHEN x{v} = 1 THEN p{i}_{v} ELSE 1 - p{i}_{v} END)"
    t = ", ".join(f"ln(w{i}) + " + " + ".join(one(i, v) for v in range(4)) + f" AS t{i}" for i in range(3))
    sums = ", ".join(f"sum(exp(t{i} - z)) AS s{i}, " + ", ".join(f"sum(exp(t{i} - z) * x{v}) AS s{i}_{v}" for v in range(4)) for i in range(3))
    new = ", ".join(f"{1 - step!r} * w{i} + {step} * s{i} / (s0 + s1 + s2) AS w{i}, " + ", ".join(f"{1 - step!r} * p{i}_{v} + {step} * (s{i}_{v} + {a!r}) / (s{i} + 2 * {a!r}) AS p{i}_{v}" for v in range(4)) for i in range(3))
    start = ", ".join(f"{BIN_W[i]}::DOUBLE AS w{i}, " + ", ".join(f"{BIN_P[i][v]}::DOUBLE AS p{i}_{v}" for v in range(4)) for i in range(3))
    steps = [f"b AS MATERIALIZED ({E4_SQL})", f"q0 AS (SELECT {start})"]
    for k in range(iterations):
        steps.append(f"z{k} AS (SELECT *, {_lse_sql(['t0', 't1', 't2'])} AS z FROM (SELECT *, {t} FROM b, q{k}))")
        steps.append(f"e{k} AS MATERIALIZED (SELECT avg(z) AS mean_ll, {sums} FROM z{k})")
        steps.append(f"q{k + 1} AS MATERIALIZED (SELECT {new} FROM q{k}, e{k})")
    return "WITH " + ", ".join(steps) + " " + _union(f"SELECT {k} AS iteration, {_r('mean_ll')} AS mean_ll FROM e{k}" for k in range(iterations))


@query(_em_fit_sql())
def em_fit(spark, d):
    c = binary_circuit()
    history = learn.expectation_maximisation(e4(spark, d), c, NAMES4, iterations=5, step=0.9)
    return _round(spark.createDataFrame(list(enumerate(history)), "iteration int, mean_ll double"))


def _clt_learned_sql() -> str:
    """The tree grows by its best edge, one step after the other; then conditional probabilities from the counts."""
    mi = _union(f"SELECT {i} AS i, {j} AS j, {' + '.join(f'{_joint(i, j, k, l)} * ln({_joint(i, j, k, l)} / ({_prior(i, k)} * {_prior(j, l)}))' for k in (0, 1) for l in (0, 1))} AS mi FROM c" for i, j in PAIRS)
    p = _union([f"SELECT {i} AS i, {j} AS j, {k} AS k, {l} AS l, {_joint(i, j, k, l)} / {_prior(j, l)} AS p FROM c" for i, j in PAIRS for k in (0, 1) for l in (0, 1)])
    roots = _union(f"SELECT {k} AS k, {_prior(0, k)} AS p FROM c" for k in (0, 1))
    steps = [f"mi AS MATERIALIZED ({mi})", f"cpt AS MATERIALIZED ({p})", f"root AS ({roots})", "t0 AS (SELECT [0] AS inside, []::STRUCT(v INTEGER, up INTEGER)[] AS edges)"]
    for k in range(5):
        best = f"SELECT t.*, mi.j AS v, mi.i AS up FROM mi, t{k} t WHERE list_contains(inside, mi.i) AND NOT list_contains(inside, mi.j) ORDER BY mi DESC, mi.j LIMIT 1"
        steps.append(f"t{k + 1} AS MATERIALIZED (SELECT list_append(inside, v) AS inside, list_append(edges, struct_pack(v := v, up := up)) AS edges FROM ({best}))")
    steps += ["edges AS (SELECT unnest(edges) AS e FROM t5)", "edge AS (SELECT e.v AS v, e.up AS up FROM edges)"]
    cells = "[" + ", ".join(f"x{i}" for i in range(6)) + "]"
    steps.append(f"g AS (SELECT {', '.join(B6)}, {cells} AS x, count(*) AS n FROM b GROUP BY ALL)")
    part = "SELECT g.x, sum(ln(cpt.p / s.p)) AS ll FROM g, edge JOIN cpt ON cpt.i = edge.v AND cpt.j = edge.up AND cpt.k = g.x[edge.v + 1] AND cpt.l = g.x[edge.up + 1] JOIN (SELECT i, j, l, sum(p) AS p FROM cpt GROUP BY ALL) s ON s.i = edge.v AND s.j = edge.up AND s.l = cpt.l GROUP BY g.x"
    return f"{COUNTS}, {', '.join(steps)} SELECT {', '.join(f'g.{c}' for c in B6)}, {_r('l.ll + ln(root.p)')} AS ll, g.n FROM g JOIN ({part}) l ON g.x = l.x JOIN root ON root.k = g.x0"


@query(_clt_learned_sql())
def clt_learned(spark, d):
    df = b6(spark, d)
    tree = number(trees.learn_tree(df, B6, root=0))
    scored = inference.log_likelihood(df, tree, {i: c for i, c in enumerate(B6)})
    return _round(scored.groupBy(*B6).agg(F.first("ll").alias("ll"), F.count(F.lit(1)).alias("n")))


# --- preparation recipes ---------------------------------------------------------------------------------------------

LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE8 = ["l_quantity", "l_partkey", "l_discount", "l_suppkey", "l_extendedprice", "l_tax", "l_linenumber", "l_orderkey"]


def _power_sql() -> str:
    left = [c for i, c in enumerate(LINE8) if i not in (1, 3)]
    noise = [f"{c} + {w} * {uniform_sql(f'42-noise{j}', *LINE_KEYS)}" if w else f"{c}::DOUBLE" for j, (c, w) in enumerate(zip(left, recipes.POWER_NOISE, strict=True))]
    cells = ", ".join(f"{e} AS y{j}" for j, e in enumerate(noise))
    u = uniform_sql(42, *LINE_KEYS)
    stats_ = ", ".join(f"avg(y{j}) FILTER (part = 'train') AS m{j}, stddev_pop(y{j}) FILTER (part = 'train') + 1e-7 AS d{j}" for j in range(6))
    out = ", ".join(f"{_r(f'avg((y{j} - m{j}) / d{j})', 5)} AS z{j}" for j in range(6))
    return f"WITH y AS (SELECT {cells}, CASE WHEN {u} < 0.81 THEN 'train' WHEN {u} < 0.9 THEN 'valid' ELSE 'test' END AS part FROM lineitem), s AS (SELECT {stats_} FROM y) SELECT part, count(*) AS n, {out} FROM y, s GROUP BY part"


@query(_power_sql())
def recipe_power(spark, d):
    """Noise, parts and standardisation by the training rows: means of each part."""
    df = load(spark, d, "lineitem").select(*LINE8).withColumns({c: F.col(c).cast("double") for c in LINE8 if c not in LINE_KEYS})
    keyed = df.withColumns({f"k{i}": F.col(c) for i, c in enumerate(LINE_KEYS)})
    made = recipes.power(keyed, LINE8, ["k0", "k1"])
    left = [c for i, c in enumerate(LINE8) if i not in (1, 3)]
    split = recipes.standardised(recipes.parts(made, ["k0", "k1"]), left)
    out = None
    for name, part in split.items():
        one = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"z{j}") for j, c in enumerate(left)])
        out = one if out is None else out.unionByName(one)
    return _round(out, 5)


GAS = {"q": "l_quantity", "p": "l_extendedprice", "q2": "l_quantity + l_tax", "t": "l_tax", "p2": "l_extendedprice * (1 - l_tax / 10)", "n": "-l_quantity", "Time": "l_orderkey"}


def _gas_sql() -> str:
    names = [c for c in GAS if c != "Time"]
    later = [" OR ".join(f"corr({a}, {b}) > 0.98" for b in names[i + 1 :]) or "false" for i, a in enumerate(names)]
    cells = ", ".join(f"{e} AS {c}" for c, e in GAS.items())
    return f"WITH x AS (SELECT {cells} FROM lineitem) " + _union(f"SELECT '{a}' AS col, {i} AS pos FROM x HAVING NOT ({w})" for i, (a, w) in enumerate(zip(names, later, strict=True)))


@query(_gas_sql())
def recipe_gas(spark, d):
    """Columns that are left, with their places."""
    df = load(spark, d, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in GAS.items()])
    left = recipes.gas(df, list(GAS), []).columns
    return spark.createDataFrame([(c, [x for x in GAS if x != "Time"].index(c)) for c in left], "col string, pos int")


HEP = {"a": "l_extendedprice", "b": "l_quantity", "c": "l_orderkey + l_linenumber / 10", "e": "l_discount", "f": "l_extendedprice * (1 + l_tax)"}


def _hep_sql() -> str:
    cells = ", ".join(f"({e})::DOUBLE AS {c}" for c, e in HEP.items())
    low = ", ".join(f"min({c}) AS m_{c}" for c in HEP)
    return f"WITH x AS (SELECT {cells} FROM lineitem WHERE l_returnflag = 'R'), m AS (SELECT {low} FROM x) " + _union(f"SELECT '{c}' AS col, sum(x.{c}) AS s FROM x, m HAVING count(*) FILTER (x.{c} = m.m_{c}) <= 5" for c in HEP)


@query(f"SELECT col, {_r('s', 2)} AS s FROM ({_hep_sql()})")
def recipe_hepmass(spark, d):
    """Columns that are left for the rows of class 1, with their sums over training and validation rows."""
    df = load(spark, d, "lineitem").selectExpr(*LINE_KEYS, "CAST(l_returnflag = 'R' AS INT) AS y", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in HEP.items()])
    found = recipes.hepmass(df, df, "y", list(HEP), LINE_KEYS)
    both = found["train"].unionByName(found["valid"])
    left = [c for c in both.columns if c not in LINE_KEYS]
    return _round(both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in left])).alias("k")).groupBy("k.col").agg(F.sum("k.v").alias("s")), 2)


# --- tensor models, flows, densities --------------------------------------------------------------------------------


def _vectors(spark, d, n: int) -> DataFrame:
    """Leading cells of the embeddings as numbered columns."""
    return load(spark, d, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(n)], "label")


@query(f"SELECT vec_id, {_r('-0.5 * (x * x + (y - (0.7 * x + 0.1)) * (y - (0.7 * x + 0.1))) - ' + repr(LOG2PI))} AS ll FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)")
def nice_coupling_fixed(spark, d):
    layer = tensors.Coupling(2, False, affine=False, hidden=())
    layer.params = {"w0": np.array([[0.0, 0.7], [0.0, 0.0]]), "b0": np.array([0.0, 0.1])}
    return _round(tensors.score(_vectors(spark, d, 2).drop("label"), tensors.Flow(2, [layer]), ["e0", "e1"]).select("vec_id", "ll"))


@query(
    f"WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT *, 0.8 * tanh(0.5 * x - 0.2) AS s FROM x) "
    f"SELECT vec_id, {_r('-0.5 * (x * x + ((y - (0.7 * x + 0.1)) * exp(-s)) ** 2) - s - ' + repr(LOG2PI))} AS ll FROM s"
)
def affine_coupling_fixed(spark, d):
    layer = tensors.Coupling(2, False, affine=True, hidden=())
    # the rows of the second variable, which is moved, are masked: their weights must not count
    layer.params = {"w0": np.array([[0.3, 0.7, 0.4, 0.5], [0.9, 0.9, 0.9, 0.9]]), "b0": np.array([0.6, 0.1, 0.6, -0.2]), "gain": np.array([0.5, 0.8])}
    return _round(tensors.score(_vectors(spark, d, 2).drop("label"), tensors.Flow(2, [layer]), ["e0", "e1"]).select("vec_id", "ll"))


MAF_W = [[0.9, 0.3, -0.2, 0.9, 0.4, 0.1], [0.9, 0.9, 0.5, 0.9, 0.9, -0.3], [0.9] * 6]
MAF_B = [0.1, 0.0, -0.1, 0.2, -0.1, 0.3]
MAF_GAIN = [0.5, 0.7, 0.9]


def _maf_sql() -> str:
    """Variable k sees only those before it: the other weights are masked."""
    line = lambda k: " + ".join([repr(MAF_B[k]), *[f"({MAF_W[j][k]!r}) * x{j}" for j in range(k % 3)]])
    steps = ", ".join(f"{MAF_GAIN[k]} * tanh({line(k + 3)}) AS s{k}, {line(k)} AS t{k}" for k in range(3))
    cells = ", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k}" for k in range(3))
    ll = " ".join(f"- 0.5 * ((x{k} - t{k}) * exp(-s{k})) ** 2 - s{k}" for k in range(3))
    return f"WITH x AS (SELECT vec_id, {cells} FROM embeddings), s AS (SELECT *, {steps} FROM x) SELECT vec_id, {_r(f'{-1.5 * LOG2PI!r} {ll}')} AS ll FROM s"


@query(_maf_sql())
def maf_fixed(spark, d):
    layer = tensors.Autoregressive(3, hidden=())
    layer.params = {"w0": np.array(MAF_W), "b0": np.array(MAF_B), "gain": np.array(MAF_GAIN)}
    return _round(tensors.score(_vectors(spark, d, 3).drop("label"), tensors.Flow(3, [layer]), ["e0", "e1", "e2"]).select("vec_id", "ll"))


RAT_LOC = [[0.0, 0.2], [-0.1, 0.3]]


def _rat_sql() -> str:
    terms = [f"({math.log(0.25)!r} + {_gauss_sql(f'v{a}', RAT_LOC[0][i], 1.0)} + {_gauss_sql(f'v{b}', RAT_LOC[1][j], 1.0)})" for i in (0, 1) for j in (0, 1) for a, b in [_rat_order()]]
    return f"SELECT vec_id, {_r(_lse_sql(terms))} AS ll FROM (SELECT vec_id, embedding[1]::DOUBLE AS v0, embedding[2]::DOUBLE AS v1 FROM embeddings)"


def _rat_order() -> tuple[int, int]:
    a, b = tensors.region_graph(2, 1, 1)[0]
    return a[0], b[0]


@query(_rat_sql())
def ratspn_tiny_fixed(spark, d):
    model = tensors.RatSpn(2, depth=1, repetitions=1, batch=2)
    model.params = {"loc": np.array(RAT_LOC).reshape(2, 2, 1), "scale": np.ones((2, 2, 1)), "root": np.zeros((1, 4))}
    return _round(tensors.score(_vectors(spark, d, 2).drop("label"), model, ["e0", "e1"]).select("vec_id", "ll"))


_GRID = "g AS (SELECT r.range AS cell, -4.0 + (r.range % 64) * (8.0 / 63) AS x, -4.0 + (r.range // 64) * (8.0 / 63) AS y FROM range(4096) r)"
_W1 = "sin(x * pi() / 2)"
_ENERGIES = {
    "moons": "exp(-(0.5 * ((sqrt(x * x + y * y) - 2) / 0.4) ** 2 - ln(exp(-0.5 * ((x - 2) / 0.6) ** 2) + exp(-0.5 * ((x + 2) / 0.6) ** 2))))",
    "waves": f"exp(-0.5 * ((y - {_W1}) / 0.4) ** 2)",
    "split": f"exp(-0.5 * ((y - {_W1}) / 0.35) ** 2) + exp(-0.5 * ((y - {_W1} + 3 * exp(-0.5 * ((x - 1) / 0.6) ** 2)) / 0.35) ** 2)",
    "nails": f"exp(-0.5 * ((y - {_W1}) / 0.4) ** 2) + exp(-0.5 * ((y - {_W1} + 3 / (1 + exp(-(x - 1) / 0.3))) / 0.35) ** 2)",
}


@query(
    f"WITH {_GRID}, z AS (SELECT {', '.join(f'sum({e}) AS z_{n}' for n, e in _ENERGIES.items())} FROM g), c AS (SELECT vec_id, unnest(range(32)) AS k, embedding FROM embeddings), "
    f"p AS (SELECT vec_id, 8 * embedding[2 * k + 1]::DOUBLE AS x, 8 * embedding[2 * k + 2]::DOUBLE AS y FROM c) SELECT vec_id, "
    + ", ".join(f"{_r(f'1000 * avg(({e}) / z_{n})')} AS {n}" for n, e in _ENERGIES.items())
    + " FROM p, z GROUP BY vec_id"
)
def energy_waves(spark, d):
    """Mean of the four energy densities over the points that neighbouring cells of each vector make."""
    cell = lambda k: 8 * F.element_at("embedding", k).cast("double")
    points = load(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k")).select("vec_id", cell(2 * F.col("k") + 1).alias("x"), cell(2 * F.col("k") + 2).alias("y"))
    return _round(points.groupBy("vec_id").agg(*[(1000 * F.avg(energy.density_at(spark, n, F.col("x"), F.col("y")))).alias(n) for n in energy.DENSITIES]))


@query(
    f"WITH {_GRID}, p AS (SELECT *, {_ENERGIES['moons']} AS e FROM g), q AS (SELECT *, e / (SELECT sum(e) FROM p) AS p FROM p), h AS (SELECT *, sum(p) OVER (ORDER BY cell) AS high FROM q), "
    f"u AS (SELECT event_id, {uniform_sql(42, 'event_id', chr(39) + 'cell' + chr(39))} AS u, sqrt(-2 * ln(1 - {uniform_sql(42, 'event_id', chr(39) + 'r' + chr(39))})) * 0.05 AS r, 2 * pi() * {uniform_sql(42, 'event_id', chr(39) + 'a' + chr(39))} AS a FROM events) "
    f"SELECT event_id, {_r('x + r * cos(a)')} AS x, {_r('y + r * sin(a)')} AS y FROM u JOIN h ON u.u >= h.high - h.p AND u.u < h.high"
)
def energy_samples(spark, d):
    """One sample of the first density for every event."""
    return _round(energy.samples_for(load(spark, d, "events"), "event_id", "moons"))


CELLS = [f"e{i}" for i in range(64)]


def _trained(df, model, cols, epochs=4, rate=1e-2):
    tensors.train(df, model, cols, epochs=epochs, rate=rate)
    return model


@query()
def ratspn_train_score(spark, d):
    df = _vectors(spark, d, 64)
    model = tensors.RatSpn(64, classes=10, depth=2, repetitions=2, batch=4, sums=4)
    tensors.train(df, model, CELLS, "label", epochs=5, rate=0.1)
    return tensors.test(df, model, CELLS, "label")


@query()
def ratspn_mpe(spark, d):
    df = _vectors(spark, d, 64).drop("label")
    model = _trained(df, tensors.RatSpn(64, depth=2, repetitions=2, batch=4, sums=4), CELLS)
    return _round(tensors.complete(df.withColumn("e1", F.lit(None).cast("double")), model, CELLS))


@query()
def ratspn_sample(spark, d):
    df = _vectors(spark, d, 64).drop("label")
    model = _trained(df, tensors.RatSpn(64, depth=2, repetitions=2, batch=4, sums=4), CELLS)
    return _round(tensors.complete(df.withColumn("e0", F.lit(None).cast("double")), model, CELLS, "vec_id", True))


@query()
def dgcspn_score(spark, d):
    df = load(spark, d, "embeddings").select("vec_id", "embedding")
    model = _trained(df, tensors.DgcSpn(1, 8, 8), ["embedding"], 3)
    return _round(tensors.score(df, model, ["embedding"]).select("vec_id", "ll"))


@query()
def realnvp1d_score(spark, d):
    df = _vectors(spark, d, 64).drop("label")
    return _round(tensors.score(df, _trained(df, tensors.realnvp(64, 2, (16,)), CELLS), CELLS).select("vec_id", "ll"))


@query()
def maf_score(spark, d):
    df = _vectors(spark, d, 64).drop("label")
    return _round(tensors.score(df, _trained(df, tensors.maf(64, 2, (16,)), CELLS), CELLS).select("vec_id", "ll"))


@query()
def realnvp2d_score(spark, d):
    df = load(spark, d, "embeddings").select("vec_id", "embedding")
    model = _trained(df, tensors.realnvp_images(1, 8, 8, 4), ["embedding"], 3)
    return _round(tensors.score(df, model, ["embedding"]).select("vec_id", "ll"))


@query("WITH a AS (SELECT label < 5 AS lo, embedding[1]::DOUBLE AS x FROM embeddings), m AS (SELECT avg(x) FILTER (lo) AS m1, avg(x) FILTER (NOT lo) AS m2, stddev_samp(x) FILTER (lo) AS s1, stddev_samp(x) FILTER (NOT lo) AS s2 FROM a) SELECT round((m1 - m2) ** 2 + (s1 - s2) ** 2, 8) + 0.0 AS fid FROM m")
def fid_one_dimension(spark, d):
    one = load(spark, d, "embeddings").select("label", F.slice("embedding", 1, 1).alias("x"))
    a, b = stats.moments_of(one.where("label < 5"), "x"), stats.moments_of(one.where("label >= 5"), "x")
    return _round(spark.createDataFrame([(stats.frechet(a[0], a[1], b[0], b[1]),)], "fid double"), 8)


@query()
def fid_embeddings(spark, d):
    df = load(spark, d, "embeddings")
    a, b = stats.moments_of(df.where("label < 5"), "embedding"), stats.moments_of(df.where("label >= 5"), "embedding")
    return _round(spark.createDataFrame([(stats.frechet(a[0], a[1], b[0], b[1]),)], "fid double"), 4)


@query()
def classifier_probabilities(spark, d):
    df = e4(spark, d)
    model = CircuitClassifier(E4, [Bernoulli] * 4, [[0, 1]] * 4, "event_id", split_rows="random", split_cols="gvs", min_rows=4000).fit(df)
    return _round(model.transform(df).select("event_id", F.element_at("probability", 2).alias("p1"), "prediction"))


@query(ORACLES["score_gaussian_mixture"])
def stream_scoring(spark, d):
    """The flagship query over a stream of the table's files."""
    import uuid

    table = f"scored_{uuid.uuid4().hex}"
    static = load(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2)
    stream = spark.readStream.schema(static.schema).parquet(f"{d}/lineitem.parquet*").select("l_linestatus", "l_quantity", "l_discount", flag.alias("flag"))
    scored = score_stream(stream, mixture(), {0: "l_quantity", 1: "l_discount", 2: "flag"})
    sums = scored.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("ll").alias("mean_ll"))
    run = sums.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", stream_folder(spark, table)).trigger(availableNow=True).start()
    run.awaitTermination()
    return _round(spark.table(table))


from . import tensor_queries  # noqa: E402, F401  registers its queries with the decorator above

__all__ = ["ORACLES", "QUERIES", "bfs", "uniform"]
