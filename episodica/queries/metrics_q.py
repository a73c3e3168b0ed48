"""Queries over evaluation metrics and monitoring aggregates."""

from pyspark.sql import functions as F

from episodica.functions.layout import block_ranges, dims_catalog
from episodica.operators import metrics as M
from episodica.queries.common import EVENTS, VECTORS, bigint, events, vectors
from episodica.registry import query, rnd, sql_rnd

DIMS = 64


def sql_block(d="dim"):
    return "CASE " + " ".join(f"WHEN {d} >= {lo} AND {d} < {hi} THEN '{n}'" for n, lo, hi in block_ranges()) + " END"


# prediction = the vector, truth = the vector reversed, valid where the prediction is positive
PAIRS = """c AS (SELECT vec_id, domain, vec_id // 100 AS batch_id, i - 1 AS dim, v[i] AS p, v[65 - i] AS g, v[i] > -0.05::DOUBLE AS ok FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors))"""


def pairs(spark, sf):
    return vectors(spark, sf).select(
        "vec_id", "domain", F.floor(F.col("vec_id") / 100).alias("batch_id"), F.col("v").alias("pred"), F.reverse("v").alias("truth"),
        F.transform("v", lambda x: F.when(x > -0.05, 1.0).otherwise(0.0)).alias("mask"))


def _errors(spark, sf, trim=0.0):
    d = M.cells(pairs(spark, sf), ["domain", "batch_id"], "pred", "truth", "mask", DIMS)
    e = M.error_metrics(d, trim)
    return e.select("domain", "batch_id", "block", "name", rnd(F.col("value")).alias("value"))


BLOCKS = f"""x AS (SELECT domain, batch_id, b AS block, p - g AS err, g FROM (SELECT *, unnest([{sql_block()}, 'total']) AS b FROM c WHERE ok))"""


@query("i1_error_metrics", f"""WITH {VECTORS}, {PAIRS}, {BLOCKS},
m AS (SELECT domain, batch_id, block, sqrt(avg(err * err)) AS rmse, sum(abs(err)) FILTER (WHERE abs(g) >= 0.001::DOUBLE) / sum(abs(g)) FILTER (WHERE abs(g) >= 0.001::DOUBLE) AS ape FROM x GROUP BY 1, 2, 3)
SELECT domain, batch_id, block, 'rmse' AS name, {sql_rnd('rmse')} AS value FROM m UNION ALL SELECT domain, batch_id, block, 'ape', {sql_rnd('ape')} FROM m""")
def i1(spark, sf):
    return _errors(spark, sf)


@query("i1_error_metrics_trimmed", f"""WITH {VECTORS}, {PAIRS}, {BLOCKS},
q AS (SELECT domain, batch_id, block, quantile_cont(err * err, 0.1) AS a, quantile_cont(err * err, 0.9) AS b, quantile_cont(abs(err), 0.1) FILTER (WHERE abs(g) >= 0.001::DOUBLE) AS c, quantile_cont(abs(err), 0.9) FILTER (WHERE abs(g) >= 0.001::DOUBLE) AS d FROM x GROUP BY 1, 2, 3),
m AS (SELECT domain, batch_id, block, sqrt(avg(err * err) FILTER (WHERE err * err BETWEEN a AND b)) AS rmse,
  sum(abs(err)) FILTER (WHERE abs(g) >= 0.001::DOUBLE AND abs(err) BETWEEN c AND d) / sum(abs(g)) FILTER (WHERE abs(g) >= 0.001::DOUBLE AND abs(err) BETWEEN c AND d) AS ape FROM x JOIN q USING (domain, batch_id, block) GROUP BY 1, 2, 3)
SELECT domain, batch_id, block, 'rmse' AS name, {sql_rnd('rmse')} AS value FROM m UNION ALL SELECT domain, batch_id, block, 'ape', {sql_rnd('ape')} FROM m""")
def i1_trim(spark, sf):
    return _errors(spark, sf, 0.1)


@query("i2_jitter", f"""WITH {VECTORS}, {PAIRS}, s AS (SELECT a.domain, a.batch_id, c3.p - 2 * b.p + a.p AS d FROM c a JOIN c b ON b.vec_id = a.vec_id AND b.dim = a.dim + 8 JOIN c c3 ON c3.vec_id = a.vec_id AND c3.dim = a.dim + 16 WHERE a.ok AND b.ok AND c3.ok)
SELECT domain, batch_id, {sql_rnd('sqrt(avg(d * d))')} AS jitter FROM s GROUP BY 1, 2""")
def i2(spark, sf):
    j = M.jitter(pairs(spark, sf), "pred", "mask", 8)
    return j.where("jitter IS NOT NULL").select("domain", "batch_id", rnd(F.col("jitter")).alias("jitter"))


def _gs(a):
    return f"""{a}1 AS (SELECT *, sqrt({a}[1]**2 + {a}[2]**2 + {a}[3]**2) AS {a}_n FROM {{src}}),
{a}2 AS (SELECT *, [{a}[1]/{a}_n, {a}[2]/{a}_n, {a}[3]/{a}_n] AS {a}_x FROM {a}1),
{a}3 AS (SELECT *, {a}_x[1]*{a}[4] + {a}_x[2]*{a}[5] + {a}_x[3]*{a}[6] AS {a}_d FROM {a}2),
{a}4 AS (SELECT *, [{a}[4]-{a}_d*{a}_x[1], {a}[5]-{a}_d*{a}_x[2], {a}[6]-{a}_d*{a}_x[3]] AS {a}_y0 FROM {a}3),
{a}5 AS (SELECT *, sqrt({a}_y0[1]**2 + {a}_y0[2]**2 + {a}_y0[3]**2) AS {a}_m FROM {a}4),
{a}6 AS (SELECT *, [{a}_y0[1]/{a}_m, {a}_y0[2]/{a}_m, {a}_y0[3]/{a}_m] AS {a}_y FROM {a}5),
{a}7 AS (SELECT *, array_cross_product({a}_x::DOUBLE[3], {a}_y::DOUBLE[3]) AS {a}_z FROM {a}6)"""


POSE = f"""st AS (SELECT domain, vec_id // 100 AS batch_id, v[4:9] AS a, v[13:18] AS b, sqrt((v[1]-v[10])**2 + (v[2]-v[11])**2 + (v[3]-v[12])**2) AS pos,
  v[19] > 0 AND v[20] > 0 AND v[21] > 0 AS okp, v[22] > -0.3 AND v[23] > -0.3 AND v[24] > -0.3 AND v[25] > -0.3 AND v[26] > -0.3 AND v[27] > -0.3 AS okr FROM vectors),
{_gs('a').format(src='st')}, {_gs('b').format(src='a7')},
e AS (SELECT domain, batch_id, CASE WHEN okp THEN pos END AS pos, CASE WHEN okr THEN degrees(acos(greatest(-1.0, least(1.0, (list_dot_product(a_x, b_x) + list_dot_product(a_y, b_y) + array_inner_product(a_z, b_z) - 1) / 2)))) END AS rot FROM b7)"""


def _steps(spark, sf):
    m = F.concat(F.transform(F.slice("v", 19, 3), lambda x: (x > 0).cast("double")), F.transform(F.slice("v", 22, 6), lambda x: (x > -0.3).cast("double")))
    return vectors(spark, sf).select("domain", F.floor(F.col("vec_id") / 100).alias("batch_id"), F.slice("v", 1, 9).alias("p"), F.slice("v", 10, 9).alias("g"), m.alias("m"))


@query("i3_pose_errors", f"""WITH {VECTORS}, {POSE} SELECT domain, batch_id, {sql_rnd('avg(pos)')} AS position_error, {sql_rnd('avg(rot)', 5)} AS rotation_error_deg FROM e GROUP BY 1, 2""")
def i3(spark, sf):
    d = M.pose_errors(_steps(spark, sf), "p", "g", "m")
    return d.select("domain", "batch_id", rnd(F.col("position_error")).alias("position_error"), rnd(F.col("rotation_error_deg"), 5).alias("rotation_error_deg"))


@query("i3_pose_errors_trimmed", f"""WITH {VECTORS}, {POSE},
q AS (SELECT domain, batch_id, quantile_cont(pos, 0.1) AS p0, quantile_cont(pos, 0.9) AS p1, quantile_cont(rot, 0.1) AS r0, quantile_cont(rot, 0.9) AS r1 FROM e GROUP BY 1, 2)
SELECT domain, batch_id, {sql_rnd('avg(pos) FILTER (WHERE pos BETWEEN p0 AND p1)')} AS position_error, {sql_rnd('avg(rot) FILTER (WHERE rot >= r0 - 1e-9 AND rot <= r1 + 1e-9)', 5)} AS rotation_error_deg FROM e JOIN q USING (domain, batch_id) GROUP BY 1, 2""")
def i3_trim(spark, sf):
    d = M.pose_errors(_steps(spark, sf), "p", "g", "m", trim=0.1)
    return d.select("domain", "batch_id", rnd(F.col("position_error")).alias("position_error"), rnd(F.col("rotation_error_deg"), 5).alias("rotation_error_deg"))


@query("i4_metric_rollup", f"""WITH {VECTORS}, {PAIRS}, {BLOCKS},
m AS (SELECT domain, batch_id, 'rmse/' || block AS name, CASE WHEN (batch_id + domain) % 4 = 0 THEN -1.0::DOUBLE ELSE sqrt(avg(err * err)) END AS v FROM x GROUP BY domain, batch_id, block)
SELECT domain, name, {sql_rnd('coalesce(avg(v) FILTER (WHERE v >= 0), -1.0::DOUBLE)')} AS value, count(*) FILTER (WHERE v >= 0) AS n_batches, grouping(domain) = 1 AS is_total FROM m GROUP BY GROUPING SETS ((name), (domain, name))""")
def i4(spark, sf):
    d = M.cells(pairs(spark, sf), ["domain", "batch_id"], "pred", "truth", "mask", DIMS)
    e = M.error_metrics(d).where("name = 'rmse'")
    bad = (F.col("batch_id") + F.col("domain")) % 4 == 0
    e = e.select("domain", F.concat_ws("/", "name", "block").alias("name"), F.when(bad, F.lit(-1.0)).otherwise(F.col("value")).alias("value"))
    return M.metric_rollup(e).withColumn("value", rnd(M.at_edge(F.col("value"))))


@query("i5_loss_window", f"""WITH {EVENTS}, d AS (SELECT event_id // 500 AS "window", CASE WHEN stream IN ('view', 'click', 'signup') THEN stream ELSE 'unknown' END AS domain, value FROM events0)
SELECT "window", domain, {sql_rnd('avg(value)')} AS mean_loss, max(value) AS max_loss, count(*) AS n, {sql_rnd('any_value(wm)')} AS window_mean FROM d JOIN (SELECT "window", avg(value) AS wm FROM d GROUP BY 1) USING ("window") GROUP BY 1, 2""")
def i5(spark, sf):
    d = events(spark, sf).select(F.col("event_id").alias("step"), F.col("stream").alias("domain"), F.col("value").alias("loss"))
    d = M.loss_window(d, 500, ["view", "click", "signup"])
    return d.select("window", "domain", rnd(F.col("mean_loss")).alias("mean_loss"), "max_loss", "n", rnd(F.col("window_mean")).alias("window_mean"))


# cells count only above a threshold that leaves some blocks empty
PRES = f"""pr AS (SELECT vec_id, domain, {sql_block()} AS block, bool_or(p > 0.2::DOUBLE) AS has FROM c GROUP BY 1, 2, 3)"""


def _presence(spark, sf):
    return vectors(spark, sf).withColumn("mask", F.transform("v", lambda x: F.when(x > 0.2, 1.0).otherwise(0.0)))


@query("i6_group_presence", f"""WITH {VECTORS}, {PAIRS}, {PRES} SELECT block, count(*) FILTER (WHERE has) AS n FROM pr GROUP BY 1""")
def i6(spark, sf):
    return M.group_presence(_presence(spark, sf), "mask", DIMS).select("block", *bigint("n"))


FREQ = """fr AS (SELECT domain, block, CAST(arg_min(has, vec_id) AS INTEGER) AS present, count(*) AS n_samples FROM pr GROUP BY 1, 2),
freq AS (SELECT domain, block, max(present) AS present, sum(n_samples) AS n_samples, sum(present * n_samples) AS count, sum(present * n_samples) / sum(n_samples) AS frequency FROM fr GROUP BY GROUPING SETS ((domain, block), (block)))"""


@query("i7_group_frequency", f"""WITH {VECTORS}, {PAIRS}, {PRES}, {FREQ}
SELECT domain, block, CAST(present AS BIGINT) AS present, CAST(n_samples AS BIGINT) AS n_samples, CAST(count AS BIGINT) AS count, {sql_rnd('frequency')} AS frequency FROM freq""")
def i7(spark, sf):
    d = M.group_frequency(_presence(spark, sf), "mask", DIMS, "vec_id")
    return d.select("domain", "block", *bigint("present", "n_samples", "count"), rnd(F.col("frequency")).alias("frequency"))


WEIGHTS = f"""gf AS (SELECT block, frequency AS f FROM freq WHERE domain IS NULL),
w0 AS (SELECT block, f, CASE WHEN f > 0 THEN greatest(0.5::DOUBLE, least(2.0::DOUBLE, pow((SELECT exp(avg(ln(f))) FROM gf WHERE f > 0) / (f + 1e-6::DOUBLE), 0.5::DOUBLE))) ELSE 1.0::DOUBLE END AS w FROM gf),
wt AS (SELECT block, f, CASE WHEN f > 0 THEN w / (SELECT avg(w) FROM w0 WHERE f > 0) ELSE 1.0::DOUBLE END AS weight FROM w0)"""


def _weights(spark, sf):
    f = M.group_frequency(_presence(spark, sf), "mask", DIMS, "vec_id").where("domain IS NULL").select("block", "frequency")
    return M.group_weights(f, 0.5, 1e-6, 0.5, 2.0)


@query("i8_group_weights", f"""WITH {VECTORS}, {PAIRS}, {PRES}, {FREQ}, {WEIGHTS} SELECT block, {sql_rnd('f')} AS frequency, {sql_rnd('weight')} AS weight FROM wt""")
def i8(spark, sf):
    return _weights(spark, sf).select("block", rnd(F.col("frequency")).alias("frequency"), rnd(F.col("weight")).alias("weight"))


@query("i9_balanced_loss", f"""WITH {VECTORS}, {PAIRS}, {PRES}, {FREQ}, {WEIGHTS},
lb AS (SELECT vec_id, {sql_block()} AS block, sum(CASE WHEN ok THEN (p - g) ** 2 ELSE 0 END) / greatest(count(*) FILTER (WHERE ok), 1) AS l, count(*) FILTER (WHERE ok) AS m FROM c GROUP BY 1, 2),
s AS (SELECT vec_id, sum(weight * l) / greatest(sum(weight), 1.0::DOUBLE) AS ls FROM lb JOIN wt USING (block) WHERE m > 0 GROUP BY 1)
SELECT {sql_rnd('avg(ls)')} AS loss, count(*) AS n_samples FROM s""")
def i9(spark, sf):
    from episodica.functions.layout import block_of

    z = F.posexplode(F.arrays_zip("pred", "truth", "mask"))
    c = pairs(spark, sf).select("vec_id", z.alias("dim", "z")).select(
        F.col("vec_id").alias("sample_id"), block_of(F.col("dim")).alias("block"), F.pow(F.col("z.pred") - F.col("z.truth"), F.lit(2.0)).alias("loss"), F.col("z.mask").alias("mask"))
    return M.balanced_loss(c, _weights(spark, sf)).select(rnd(F.col("loss")).alias("loss"), "n_samples")


@query("i10_dims_catalog", f"""WITH {VECTORS}, {PAIRS}
SELECT dim, {sql_block()} AS block, {sql_block()} || '-' || CAST(dim - CASE {' '.join(f"WHEN dim >= {lo} AND dim < {hi} THEN {lo}" for _, lo, hi in block_ranges())} END AS VARCHAR) AS label, count(*) FILTER (WHERE ok) AS n_valid FROM c GROUP BY dim""")
def i10(spark, sf):
    d = pairs(spark, sf).select(F.posexplode("mask").alias("dim", "m")).groupBy("dim").agg(F.sum("m").cast("bigint").alias("n_valid"))
    return d.join(dims_catalog(spark), "dim").select(*bigint("dim"), "block", "label", "n_valid")


@query("i11_curve_rows", f"""WITH {VECTORS}, {PAIRS}, r AS (SELECT vec_id, dense_rank() OVER (PARTITION BY batch_id ORDER BY vec_id) AS r FROM (SELECT DISTINCT vec_id, batch_id FROM c)),
u AS (SELECT c.*, c.dim // 8 AS t, c.dim % 8 AS d, bool_or(ok) OVER (PARTITION BY c.vec_id, c.dim % 8) AS used FROM c)
SELECT batch_id, vec_id AS sample_id, d AS dim, {sql_block('d')} || '-' || CAST(CASE WHEN d < 3 THEN d ELSE d - 3 END AS VARCHAR) AS label, t, {sql_rnd('g')} AS truth, {sql_rnd('p')} AS prediction FROM u JOIN r USING (vec_id) WHERE r <= 10 AND used""")
def i11(spark, sf):
    d = M.curve_rows(pairs(spark, sf).withColumnRenamed("vec_id", "sample_id"), "pred", "truth", "mask", 8, 10)
    return d.select("batch_id", "sample_id", "dim", "label", "t", rnd(F.col("truth")).alias("truth"), rnd(F.col("prediction")).alias("prediction"))
