"""Queries over normalisation statistics."""

from pyspark.sql import functions as F

from episodica.operators import normalize as N
from episodica.queries.common import EVENTS, SAMPLES, VECTORS, events, longer, samples, table, vectors
from episodica.registry import query, rnd, sql_rnd

WIDTH = 64
CELLS = """cells AS (SELECT vec_id, domain, v, i - 1 AS dim, v[i] AS x FROM (SELECT vec_id, domain, v, unnest(range(1, 65)) AS i FROM vectors))"""


def sql_guard(norm_type, value="x", valid="true"):
    """Aggregates lo/hi with the flat-dim guards."""
    f = f"FILTER (WHERE {valid})"
    if norm_type == "quantile":
        lo, hi = f"quantile_cont({value}, 0.01) {f}", f"quantile_cont({value}, 0.99) {f}"
        flat = f"abs({lo} - {hi}) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs({hi})"
        return (f"CASE WHEN {lo} IS NULL THEN -0.5 WHEN {flat} THEN {lo} - 0.5 ELSE {lo} END AS lo",
                f"CASE WHEN {lo} IS NULL THEN 0.5 WHEN {flat} THEN {lo} + 0.5 ELSE {hi} END AS hi")
    lo, hi = f"avg({value}) {f}", f"stddev_pop({value}) {f}"
    return f"coalesce({lo}, 0.0::DOUBLE) AS lo", f"CASE WHEN {hi} IS NULL OR {hi} <= 1e-8::DOUBLE THEN 1.0::DOUBLE ELSE {hi} END AS hi"


def _masked(spark, sf):
    """The first dim is constant and one domain has no valid cell in dim 1."""
    v = F.transform("v", lambda x, i: F.when(i == 0, F.lit(0.25)).otherwise(x))
    m = F.transform("v", lambda x, i: F.when((i == 1) & (F.col("domain") == 0), 0.0).when(x > -0.1, 1.0).otherwise(0.0))
    return vectors(spark, sf).select("vec_id", "domain", v.alias("v"), m.alias("m"))


MASKED = f"{VECTORS}, {CELLS}, mc AS (SELECT domain, dim, CASE WHEN dim = 0 THEN 0.25::DOUBLE ELSE x END AS x, NOT (dim = 1 AND domain = 0) AND x > -0.1::DOUBLE AS ok FROM cells)"


def _fit(t):
    lo, hi = sql_guard(t, "x", "ok")
    return f"WITH {MASKED}, s AS (SELECT domain, dim, {lo}, {hi} FROM mc GROUP BY 1, 2) SELECT domain, dim, {sql_rnd('lo')} AS lo, {sql_rnd('hi')} AS hi FROM s"


def rounded(d, *keys):
    return d.select(*keys, rnd(F.col("lo")).alias("lo"), rnd(F.col("hi")).alias("hi"))


@query("h1_norm_fit_quantile", _fit("quantile"))
def h1_q(spark, sf):
    return rounded(N.norm_fit(_masked(spark, sf), ["domain"], "v", "quantile", "m"), "domain", "dim")


@query("h1_norm_fit_zscore", _fit("zscore"))
def h1_z(spark, sf):
    return rounded(N.norm_fit(_masked(spark, sf), ["domain"], "v", "zscore", "m"), "domain", "dim")


def _wild(spark, sf):
    """Dims 3 and 4 hold infinities and NaN now and then."""
    v = F.transform("v", lambda x, i: F.when((i == 3) & (F.col("vec_id") % 7 == 0), F.lit(float("-inf")))
                    .when((i == 3) & (F.col("vec_id") % 13 == 0), F.lit(float("inf")))
                    .when((i == 4) & (F.col("vec_id") % 11 == 0), F.lit(float("nan"))).otherwise(x))
    return vectors(spark, sf).select("domain", v.alias("v"))


def _wild_sql(t):
    lo, hi = sql_guard(t, "x", "ok")
    return f"""WITH {VECTORS}, {CELLS}, wc AS (SELECT domain, dim, x, NOT (dim = 3 AND (vec_id % 7 = 0 OR vec_id % 13 = 0)) AND NOT (dim = 4 AND vec_id % 11 = 0) AS ok FROM cells),
s AS (SELECT domain, dim, {lo}, {hi}, count(*) FILTER (WHERE NOT ok) AS n_bad FROM wc GROUP BY 1, 2)
SELECT domain, dim, {sql_rnd('lo')} AS lo, {sql_rnd('hi')} AS hi, n_bad FROM s"""


@query("h1_norm_fit_nonfinite_quantile", _wild_sql("quantile"))
def h1_wild_q(spark, sf):
    return rounded(N.norm_fit(_wild(spark, sf), ["domain"], "v", "quantile", report=True), "domain", "dim", "n_bad")


@query("h1_norm_fit_nonfinite_zscore", _wild_sql("zscore"))
def h1_wild_z(spark, sf):
    return rounded(N.norm_fit(_wild(spark, sf), ["domain"], "v", "zscore", report=True), "domain", "dim", "n_bad")


def _time_sql():
    lo, hi = sql_guard("zscore")
    return f"""WITH {VECTORS}, {CELLS}, s AS (SELECT domain, dim // 8 AS t, dim % 8 AS dim, {lo}, {hi} FROM cells GROUP BY 1, 2, 3)
SELECT domain, t, dim, {sql_rnd('lo')} AS lo, {sql_rnd('hi')} AS hi FROM s"""


@query("h1_norm_fit_per_time", _time_sql())
def h1_t(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, F.lit(8)))
    d = vectors(spark, sf).select("domain", rows.alias("chunk"))
    return rounded(N.norm_fit(d, ["domain"], "chunk", "zscore", per_time=True), "domain", "t", "dim")


SHARED = "dim < 9 OR (dim >= 48 AND dim < 57)"


def scoped_sql(t):
    lo, hi = sql_guard(t)
    return f"""stats AS (SELECT CASE WHEN {SHARED} THEN NULL ELSE domain END AS domain, dim, {lo}, {hi} FROM cells GROUP BY 1, 2)"""


def scoped(spark, sf, t):
    return N.norm_fit_scoped(vectors(spark, sf), "v", "joint", t, WIDTH)


@query("h2_norm_fit_scoped", f"""WITH {VECTORS}, {CELLS}, {scoped_sql('quantile')}
SELECT CASE WHEN domain IS NULL THEN 'shared' ELSE 'domain' END AS scope, domain, dim, {sql_rnd('lo')} AS lo, {sql_rnd('hi')} AS hi FROM stats""")
def h2(spark, sf):
    return rounded(scoped(spark, sf, "quantile"), "scope", "domain", "dim")


def _tactile(spark, sf):
    areas = F.array(*[F.slice("v", i * 16 + 1, 16) for i in range(4)])
    return vectors(spark, sf).select("domain", F.concat(F.lit("pad_"), (F.col("vec_id") % 3).cast("string")).alias("stream"),
                                     F.when(F.col("vec_id") % 3 == 0, "binary").otherwise("matrix").alias("ttype"), areas.alias("data"))


def _streams_sql():
    lo, hi = sql_guard("zscore")
    return f"""WITH {VECTORS}, {CELLS},
s AS (SELECT domain, 'pad_' || CAST(vec_id % 3 AS VARCHAR) AS stream, dim % 16 AS dim, {lo}, {hi} FROM cells WHERE vec_id % 3 <> 0 GROUP BY 1, 2, 3)
SELECT domain, stream, dim, {sql_rnd('lo')} AS lo, {sql_rnd('hi')} AS hi, NULL::VARCHAR AS mode FROM s
UNION ALL SELECT DISTINCT domain, 'pad_0', NULL, NULL, NULL, 'ignore' FROM vectors WHERE vec_id % 3 = 0"""


@query("h3_norm_fit_streams", _streams_sql())
def h3(spark, sf):
    return rounded(N.norm_fit_streams(_tactile(spark, sf), "data", "ttype", "zscore"), "domain", "stream", "dim", "mode")


PIX = """px AS (SELECT domain, vec_id // 50 AS batch, vec_id * 16 + p AS pid, v[p * 4 + 1 : p * 4 + 4] AS ch FROM vectors, (SELECT unnest(range(0, 16)) AS p)),
a AS (SELECT *, row_number() OVER (PARTITION BY domain, batch ORDER BY md5(concat_ws('|', '2', CAST(pid AS VARCHAR)))) AS r1 FROM px),
b AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(concat_ws('|', '3', CAST(pid AS VARCHAR)))) AS r2 FROM a WHERE r1 <= 60),
pc AS (SELECT domain, j AS dim, (ch[j + 1] * 100 + 128) / 255.0::DOUBLE * 2 - 1 AS x FROM b, (SELECT unnest(range(0, 4)) AS j) WHERE r2 <= 400)"""

HIST = """m AS (SELECT domain, dim, count(*) AS n, min(x) AS mn, max(x) AS mx, avg(x) AS mean, avg(x * x) AS ms FROM {src} GROUP BY 1, 2),
hb AS (SELECT domain, dim, least(CAST(floor((x - (mn - 1e-10::DOUBLE)) / ((mx + 1e-10::DOUBLE) - (mn - 1e-10::DOUBLE)) * 5000) AS BIGINT), 4999) AS bin, count(*) AS c FROM {src} JOIN m USING (domain, dim) GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(c) OVER (PARTITION BY domain, dim ORDER BY bin) AS cum FROM hb),
q AS (SELECT domain, dim, min(CASE WHEN cum >= 0.01::DOUBLE * n THEN mn - 1e-10::DOUBLE + bin * ((mx + 1e-10::DOUBLE) - (mn - 1e-10::DOUBLE)) / 5000 END) AS q01,
  min(CASE WHEN cum >= 0.99::DOUBLE * n THEN mn - 1e-10::DOUBLE + bin * ((mx + 1e-10::DOUBLE) - (mn - 1e-10::DOUBLE)) / 5000 END) AS q99 FROM cu JOIN m USING (domain, dim) GROUP BY 1, 2)"""


ALL_PIX = """px AS (SELECT domain, vec_id * 16 + p AS pid, v[p * 4 + 1 : p * 4 + 4] AS ch FROM vectors, (SELECT unnest(range(0, 16)) AS p)),
pc AS (SELECT domain, j AS dim, (ch[j + 1] * 100 + 128) / 255.0::DOUBLE * 2 - 1 AS x FROM px, (SELECT unnest(range(0, 4)) AS j))"""


@query("h4_norm_fit_channels_all", f"""WITH {VECTORS}, {ALL_PIX}, {HIST.format(src='pc')} SELECT domain, dim, {sql_rnd('q01')} AS lo, {sql_rnd('q99')} AS hi, 'div255_mul2_minus1' AS preprocess FROM q""")
def h4_all(spark, sf):
    """Every pixel vector: the main form; a budget is an option."""
    d = vectors(spark, sf).select("domain", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    d = d.select("domain", (F.col("vec_id") * 16 + F.col("p")).alias("pid"), F.transform(F.slice("v", F.col("p") * 4 + 1, F.lit(4)), lambda x: x * 100 + 128).alias("ch"))
    return rounded(N.norm_fit_channels(d, ["domain"], "pid", F.col("pid"), "ch", "quantile"), "domain", "dim", "preprocess")


@query("h4_norm_fit_channels", f"""WITH {VECTORS}, {PIX}, {HIST.format(src='pc')} SELECT domain, dim, {sql_rnd('q01')} AS lo, {sql_rnd('q99')} AS hi, 'div255_mul2_minus1' AS preprocess FROM q""")
def h4(spark, sf):
    d = vectors(spark, sf).select("domain", F.floor(F.col("vec_id") / 50).alias("batch"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    d = d.select("domain", "batch", (F.col("vec_id") * 16 + F.col("p")).alias("pid"), F.transform(F.slice("v", F.col("p") * 4 + 1, F.lit(4)), lambda x: x * 100 + 128).alias("ch"))
    s = N.norm_fit_channels(d, ["domain"], "batch", F.col("pid"), "ch", "quantile", per_batch=60, budget=400, seed=2)
    return rounded(s, "domain", "dim", "preprocess")


@query("h5_running_stats", f"""WITH {VECTORS}, {CELLS}, {HIST.format(src='cells')}
SELECT domain, dim, n, {sql_rnd('mn')} AS min, {sql_rnd('mx')} AS max, {sql_rnd('mean')} AS mean, {sql_rnd('sqrt(greatest(0.0::DOUBLE, ms - mean * mean))')} AS std, {sql_rnd('q01', 5)} AS q01, {sql_rnd('q99', 5)} AS q99 FROM m JOIN q USING (domain, dim)""")
def h5(spark, sf):
    c = N.vector_cells(vectors(spark, sf), ["domain"], "v")
    d = N.running_stats(c, ["domain", "dim"])
    return d.select("domain", "dim", "n", *[rnd(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")], *[rnd(F.col(c), 5).alias(c) for c in ("q01", "q99")])


def fwd(t, x="x"):
    if t == "quantile":
        return f"greatest(-2.0::DOUBLE, least(2.0::DOUBLE, ({x} - lo) / (hi - lo + 1e-6::DOUBLE) * 2 - 1))"
    return f"greatest(-10.0::DOUBLE, least(10.0::DOUBLE, ({x} - lo) / (CASE WHEN abs(hi) < 1e-8 THEN 1.0::DOUBLE ELSE hi END)))"


def back(t, y):
    return f"(({y} + 1) / 2 * (hi - lo) + lo)" if t == "quantile" else f"({y} * hi + lo)"


def _apply_sql(t, expr):
    return f"""WITH {VECTORS}, {CELLS}, {scoped_sql(t)}
SELECT vec_id, c.dim, {sql_rnd(expr)} AS value FROM cells c JOIN stats s ON s.dim = c.dim AND (s.domain = c.domain OR s.domain IS NULL)"""


@query("h6_norm_apply_quantile", _apply_sql("quantile", fwd("quantile")))
def h6_q(spark, sf):
    return longer(N.norm_apply(vectors(spark, sf), "v", scoped(spark, sf, "quantile"), "quantile", WIDTH), ["vec_id"])


@query("h6_norm_apply_zscore", _apply_sql("zscore", fwd("zscore")))
def h6_z(spark, sf):
    return longer(N.norm_apply(vectors(spark, sf), "v", scoped(spark, sf, "zscore"), "zscore", WIDTH), ["vec_id"])


@query("h6_norm_apply_streams", f"""WITH {VECTORS}, {CELLS}, st AS (SELECT vec_id % 3 AS k, dim % 16 AS dim, avg(x) AS lo, stddev_pop(x) AS hi FROM cells WHERE vec_id % 3 <> 0 GROUP BY 1, 2)
SELECT vec_id, c.dim, {sql_rnd(f"CASE WHEN vec_id % 3 = 0 THEN x ELSE {fwd('zscore')} END")} AS value FROM cells c LEFT JOIN st ON st.k = c.vec_id % 3 AND st.dim = c.dim % 16 WHERE c.dim < 16""")
def h6_s(spark, sf):
    t = _tactile(spark, sf)
    stats = N.norm_fit_streams(t, "data", "ttype", "zscore", ["stream"])
    d = vectors(spark, sf).select("vec_id", F.concat(F.lit("left_"), F.col("vec_id").cast("string")).alias("own"),
                                  F.concat(F.lit("pad_"), (F.col("vec_id") % 3).cast("string")).alias("identity"), F.slice("v", 1, 16).alias("v"))
    return longer(N.norm_apply_streams(d, "v", stats, "zscore", "own", "identity"), ["vec_id"])


@query("h7_norm_invert_quantile", _apply_sql("quantile", back("quantile", fwd("quantile"))))
def h7_q(spark, sf):
    s = scoped(spark, sf, "quantile")
    return longer(N.norm_invert(N.norm_apply(vectors(spark, sf), "v", s, "quantile", WIDTH), "v", s, "quantile", WIDTH), ["vec_id"])


@query("h7_norm_invert_zscore", _apply_sql("zscore", back("zscore", fwd("zscore"))))
def h7_z(spark, sf):
    s = scoped(spark, sf, "zscore")
    return longer(N.norm_invert(N.norm_apply(vectors(spark, sf), "v", s, "zscore", WIDTH), "v", s, "zscore", WIDTH), ["vec_id"])


def _chunks(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, F.lit(8)))
    return vectors(spark, sf).select("vec_id", "domain", rows.alias("chunk"))


def _chunk_rows(d):
    return longer(d.select("vec_id", F.posexplode("chunk").alias("t", "v")).withColumn("t", F.col("t").cast("bigint")), ["vec_id", "t"])


def _per_time_sql(t, shared, expr):
    """Statistics of every step, per domain or (shared) over all domains."""
    lo, hi = sql_guard(t)
    domain, same = ("NULL", "true") if shared else ("domain", "s.domain = c.domain")
    return f"""WITH {VECTORS}, {CELLS}, tc AS (SELECT vec_id, domain, dim // 8 AS t, dim % 8 AS dim, x FROM cells),
s AS (SELECT {domain} AS domain, t, dim, {lo}, {hi} FROM tc GROUP BY 1, 2, 3)
SELECT vec_id, c.t, c.dim, {sql_rnd(expr)} AS value FROM tc c JOIN s ON s.t = c.t AND s.dim = c.dim AND {same}"""


@query("h6_norm_apply_per_time_quantile", _per_time_sql("quantile", False, fwd("quantile")))
def h6_time_q(spark, sf):
    d = _chunks(spark, sf)
    s = N.norm_fit_scoped(d, "chunk", "all", "quantile", 8, per_time=True)
    return _chunk_rows(N.norm_apply(d, "chunk", s, "quantile", 8))


@query("h6_norm_apply_per_time_zscore", _per_time_sql("zscore", True, fwd("zscore")))
def h6_time_z(spark, sf):
    d = _chunks(spark, sf)
    s = N.norm_fit_scoped(d, "chunk", "none", "zscore", 8, per_time=True)
    return _chunk_rows(N.norm_apply(d, "chunk", s, "zscore", 8))


@query("h7_norm_invert_per_time", _per_time_sql("zscore", False, back("zscore", fwd("zscore"))))
def h7_time(spark, sf):
    d = _chunks(spark, sf)
    s = N.norm_fit_scoped(d, "chunk", "all", "zscore", 8, per_time=True)
    return _chunk_rows(N.norm_invert(N.norm_apply(d, "chunk", s, "zscore", 8), "chunk", s, "zscore", 8))


@query("h2_norm_fit_sample_ratio", f"""WITH {VECTORS}, {CELLS}, k AS (SELECT * FROM cells
  WHERE CAST(concat('0x', substr(md5(concat_ws('|', '3', CAST(vec_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.5),
stats AS (SELECT CASE WHEN {SHARED} THEN NULL ELSE domain END AS domain, dim, {', '.join(sql_guard('zscore'))} FROM k GROUP BY 1, 2)
SELECT CASE WHEN domain IS NULL THEN 'shared' ELSE 'domain' END AS scope, domain, dim, {sql_rnd('lo')} AS lo, {sql_rnd('hi')} AS hi FROM stats""")
def h2_ratio(spark, sf):
    s = N.norm_fit_scoped(vectors(spark, sf), "v", "joint", "zscore", WIDTH, ratio=0.5, sample=F.col("vec_id"), seed=3)
    return rounded(s, "scope", "domain", "dim")


def _simple(spark, sf):
    s = N.stat_arrays(N.norm_fit(vectors(spark, sf), ["domain"], "v", "zscore"), ["domain"], WIDTH)
    return vectors(spark, sf).join(s, "domain")


@query("h8_scale_simple", f"""WITH {VECTORS}, {CELLS}, s AS (SELECT domain, dim, avg(x) AS lo, stddev_pop(x) AS hi FROM cells GROUP BY 1, 2)
SELECT vec_id, dim, {sql_rnd('(x - lo) / (hi + 1e-6::DOUBLE)')} AS value FROM cells JOIN s USING (domain, dim)""")
def h8(spark, sf):
    d = _simple(spark, sf)
    return longer(d.withColumn("v", N.scale_simple(F.col("v"), F.col("__lo"), F.col("__hi"))), ["vec_id"])


@query("h8_unscale_simple", f"""WITH {VECTORS}, {CELLS} SELECT vec_id, dim, {sql_rnd('x')} AS value FROM cells""")
def h8_u(spark, sf):
    d = _simple(spark, sf)
    y = N.scale_simple(F.col("v"), F.col("__lo"), F.col("__hi"), True)
    return longer(d.withColumn("w", y).withColumn("w", N.unscale_simple(F.col("w"), F.col("__lo"), F.col("__hi"), True)), ["vec_id"], "w")


def _stats_of_events(spark, sf):
    """Mean/std per user and stream, some of them damaged."""
    g = events(spark, sf).groupBy(F.col("episode_id").alias("domain"), "stream").agg(F.avg("value").alias("lo"), F.stddev_pop("value").alias("hi"), F.min("event_id").alias("i"))
    return g.select("domain", "stream", F.when(F.col("i") % 10 == 1, F.lit(5e7)).otherwise(F.col("lo")).alias("lo"),
                    F.when(F.col("i") % 10 == 2, F.lit(float("nan"))).when(F.col("i") % 10 == 3, F.lit(2000.0)).otherwise(F.col("hi")).alias("hi"), "i")


@query("h9_stats_sanitize", f"""WITH {EVENTS}, g AS (SELECT episode_id AS domain, stream, avg(value) AS lo, stddev_pop(value) AS hi, min(event_id) % 10 IN (1, 2, 3) AS was_corrupt FROM events0 GROUP BY 1, 2)
SELECT domain, stream, was_corrupt, {sql_rnd('CASE WHEN was_corrupt THEN 0.0::DOUBLE ELSE lo END')} AS lo, {sql_rnd('CASE WHEN was_corrupt THEN 1.0::DOUBLE ELSE hi END')} AS hi FROM g""")
def h9(spark, sf):
    return rounded(N.stats_sanitize(_stats_of_events(spark, sf)), "domain", "stream", "was_corrupt")


@query("h10_stats_overlay", f"""WITH {EVENTS}, g AS (SELECT episode_id AS domain, stream, max(value) AS hi FROM events0 GROUP BY 1, 2), o AS (SELECT episode_id AS domain, stream, max(value) FILTER (WHERE k % 2 = 0) AS hi FROM events0 WHERE episode_id % 3 = 0 GROUP BY 1, 2)
SELECT domain, stream, {sql_rnd('CASE WHEN o.domain IS NULL THEN g.hi ELSE o.hi END')} AS hi, o.domain IS NOT NULL AS replaced, o.domain IS NOT NULL AND g.hi IS DISTINCT FROM o.hi AS changed
FROM g LEFT JOIN o USING (domain, stream)""".replace("SELECT domain, stream, ", "SELECT g.domain, g.stream, ").replace("USING (domain, stream)", "ON o.domain = g.domain AND o.stream = g.stream"))
def h10(spark, sf):
    e = events(spark, sf).withColumnRenamed("episode_id", "domain")
    cur = e.groupBy("domain", "stream").agg(F.max("value").alias("hi"))
    over = e.where("domain % 3 = 0").groupBy("domain", "stream").agg(F.max(F.when(F.col("k") % 2 == 0, F.col("value"))).alias("hi"))
    a = N.stats_overlay(cur, over, ["domain", "stream"], ["hi"])
    b = N.stats_overlay(cur, over, ["domain", "stream"], ["hi"], only_changed=True).select("domain", "stream", F.col("replaced").alias("changed"))
    return a.join(b, ["domain", "stream"]).select("domain", "stream", rnd(F.col("hi")).alias("hi"), "replaced", "changed")


SNAP = """sv AS (SELECT CAST(event_id AS VARCHAR) AS key, event_type AS value FROM events WHERE event_id % 10 <> 0), cu AS (SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE event_type END AS value FROM events WHERE event_id % 11 <> 0)"""


def _snaps(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("value"))
    cur = e.where("event_id % 11 <> 0").withColumn("value", F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.col("value")))
    return e.where("event_id % 10 <> 0").drop("event_id"), cur.drop("event_id")


@query("h11_params_diff", f"""WITH {SNAP} SELECT coalesce(sv.key, cu.key) AS key, sv.value AS saved, cu.value AS current, CASE WHEN sv.key IS NULL OR cu.key IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM sv FULL OUTER JOIN cu ON sv.key = cu.key WHERE sv.value IS DISTINCT FROM cu.value AND coalesce(sv.key, cu.key) NOT IN ('1', '2', '9')""")
def h11(spark, sf):
    return N.params_diff(*_snaps(spark, sf), ignored=["1", "2", "9"])


@query("h11_params_diff_saved", f"""WITH {SNAP} SELECT sv.key, sv.value AS saved, cu.value AS current, CASE WHEN cu.key IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM sv LEFT JOIN cu ON sv.key = cu.key WHERE sv.value IS DISTINCT FROM cu.value OR cu.key IS NULL""")
def h11_s(spark, sf):
    return N.params_diff(*_snaps(spark, sf), saved_only=True)


@query("h12_pick_stats", """WITH c AS (SELECT c_nationkey AS domain, CASE WHEN c_nationkey % 4 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS dir,
  'independent_norm_stats_' || CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'all' WHEN 2 THEN 'joint' ELSE 'x' END || '_t' || CAST(c_custkey % 2 AS VARCHAR) || '_' || CASE c_custkey % 7 WHEN 0 THEN 'quantile' WHEN 1 THEN 'zscore' ELSE 'other' END || '.json' AS name FROM customer),
f AS (SELECT *, bool_or(dir = CAST(domain AS VARCHAR)) OVER (PARTITION BY domain) AS own FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN domain % 5 = 0 AND name = 'independent_norm_stats_x_t1_other.json' THEN 0 ELSE 1 END,
  CASE WHEN ends_with(name, 'quantile.json') THEN 0 ELSE 1 END, CASE WHEN contains(name, '_joint_') THEN 0 WHEN contains(name, '_all_') THEN 1 WHEN contains(name, '_none_') THEN 2 ELSE 3 END,
  CASE WHEN contains(name, '_t0_') THEN 0 ELSE 1 END, name, dir) AS rn FROM f WHERE (NOT own OR dir = CAST(domain AS VARCHAR)) AND (NOT ends_with(name, 'other.json') OR (domain % 5 = 0 AND name = 'independent_norm_stats_x_t1_other.json')))
SELECT CAST(domain AS VARCHAR) AS domain, dir, name FROM r WHERE rn = 1""")
def h12(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    mode = F.when(k % 5 == 0, "none").when(k % 5 == 1, "all").when(k % 5 == 2, "joint").otherwise("x")
    typ = F.when(k % 7 == 0, "quantile").when(k % 7 == 1, "zscore").otherwise("other")
    c = table(spark, sf, "customer").select(
        n.cast("string").alias("domain"), F.when((n % 4 == 0) | (k % 3 == 0), "").otherwise(n.cast("string")).alias("dir"),
        F.concat(F.lit("independent_norm_stats_"), mode, F.lit("_t"), (k % 2).cast("string"), F.lit("_"), typ, F.lit(".json")).alias("name"))
    want = F.when(F.col("domain").cast("int") % 5 == 0, F.lit("independent_norm_stats_x_t1_other.json"))
    return N.pick_stats(c, want)




def _chunk_cells(horizon, stride, clamp):
    """Every cell of every chunk, exploded: the definition that weighted frames have to meet."""
    last = "least((%d) * %d, l - frame_idx)" % (horizon - 1, stride) if clamp else f"least(j * {stride}, (l - frame_idx) // {stride} * {stride})"
    src = f"frame_idx + least(j * {stride}, {last})" if clamp else f"frame_idx + {last}"
    return f"""{SAMPLES}, e AS (SELECT *, max(frame_idx) OVER (PARTITION BY episode_id) AS l FROM samples),
i AS (SELECT episode_id, j, {src} AS src FROM e, (SELECT unnest(range(0, {horizon})) AS j)),
c AS (SELECT i.episode_id % 5 AS domain, j AS t, d AS dim, CASE d WHEN 0 THEN s.value ELSE CAST(s.k AS DOUBLE) END AS x FROM i JOIN samples s ON s.episode_id = i.episode_id AND s.frame_idx = i.src, (SELECT unnest(range(0, 2)) AS d))"""


def _chunk_fit_sql(norm_type, horizon, stride, clamp, per_time):
    lo, hi = sql_guard(norm_type)
    keys = "domain, t, dim" if per_time else "domain, dim"
    return f"""WITH {_chunk_cells(horizon, stride, clamp)}, s AS (SELECT {keys}, {lo}, {hi} FROM c GROUP BY ALL)
SELECT {keys}, {sql_rnd('lo')} AS lo, {sql_rnd('hi')} AS hi FROM s"""


def _chunk_fit(spark, sf, norm_type, horizon, stride, clamp, per_time):
    d = samples(spark, sf).select((F.col("episode_id") % 5).alias("domain"), "episode_id", "frame_idx", F.array(F.col("value"), F.col("k").cast("double")).alias("v"))
    s = N.norm_fit_chunks(d, ["domain"], "v", norm_type, horizon, stride, clamp, per_time=per_time)
    return rounded(s, *(["domain", "t", "dim"] if per_time else ["domain", "dim"]))


for _name, _args in {
    "h1_norm_fit_chunks_zscore": ("zscore", 8, 1, False, False),
    "h1_norm_fit_chunks_quantile": ("quantile", 8, 3, False, False),
    "h1_norm_fit_chunks_clamped": ("quantile", 6, 4, True, False),
    "h1_norm_fit_chunks_per_time": ("quantile", 5, 2, False, True),
}.items():
    query(_name, _chunk_fit_sql(*_args))(lambda spark, sf, a=_args: _chunk_fit(spark, sf, *a))
