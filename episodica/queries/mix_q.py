"""Queries over splits, mixing plans and batches."""

from pyspark.sql import functions as F

from episodica.operators import batch as B, mix as M, split as S
from episodica.operators.permute import Permutation, epoch_batches, epoch_part
from episodica.queries.common import EPISODES, FRAMES, VECTORS, bigint, episodes, frames, table, vectors
from episodica.queries.sources_q import CATALOG, catalog
from episodica.registry import query, rnd, sql_rnd

# Each customer file is a source; three catalog entries select from it.
KINDS = [("full", 1.0, 0), ("half", 0.5, 1), ("again", 1.0, 2)]

POOLS = """pools AS (SELECT n_regionkey AS norm_domain, file_id AS source_id, count(*) AS n_pool
  FROM episodes JOIN nation ON n_name = domain GROUP BY ALL),
kinds AS (SELECT * FROM (VALUES ('full', 1.0::DOUBLE, 0), ('half', 0.5::DOUBLE, 1), ('again', 1.0::DOUBLE, 2)) t(entry, ratio, config_index)),
entry_pos AS (SELECT norm_domain, source_id, entry, ratio, config_index,
  unnest(range(0, CAST(floor(n_pool * ratio) AS BIGINT))) AS position FROM pools, kinds)"""


def pools(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("domain"), F.col("n_regionkey").alias("norm_domain"))
    return episodes(spark, sf).join(n, "domain").groupBy("norm_domain", F.col("file_id").alias("source_id")).agg(
        F.count(F.lit(1)).alias("n_pool"))


def entry_table(p):
    kinds = F.array(*[F.struct(F.lit(k).alias("entry"), F.lit(r).alias("ratio"), F.lit(i).alias("config_index"))
                      for k, r, i in KINDS])
    d = p.withColumn("k", F.explode(kinds)).select("norm_domain", "source_id", "k.*", "n_pool")
    return d.withColumn("n_selected", F.floor(F.col("n_pool") * F.col("ratio"))).drop("n_pool")


def sql_draw(pool, ident, k):
    return f"""SELECT *, row_number() OVER (PARTITION BY norm_domain ORDER BY
  md5(concat_ws('|', '7', CAST(norm_domain AS VARCHAR), {ident}))) - 1 < {k} AS is_val FROM {pool}"""


@query("c1_val_count", f"""WITH {EPISODES}, g AS (SELECT domain, count(*) AS total FROM episodes GROUP BY 1)
SELECT domain, total, CAST(floor(total * 0.021::DOUBLE) AS BIGINT) AS by_ratio, least(600, total) AS by_count FROM g""")
def c1(spark, sf):
    g = episodes(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("total"))
    return g.select("domain", "total", S.val_count(F.col("total"), 0.021).alias("by_ratio"),
                    S.val_count(F.col("total"), 600).alias("by_count"))


@query("c2_split_pooled", f"""WITH {EPISODES}, {POOLS},
d AS ({sql_draw('entry_pos', "entry || '-' || CAST(source_id AS VARCHAR), CAST(position AS VARCHAR)",
 'floor(count(*) OVER (PARTITION BY norm_domain) * 0.1::DOUBLE)')})
SELECT norm_domain, entry || '-' || CAST(source_id AS VARCHAR) AS entry, position, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split FROM d""")
def c2(spark, sf):
    p = pools(spark, sf)
    e = S.entry_prefixes(entry_table(p), p).select(
        "norm_domain", F.concat_ws("-", "entry", F.col("source_id").cast("string")).alias("entry"), "position")
    return S.split_pooled(e, 0.1, 7)


@query("c3_split_by_source", f"""WITH {EPISODES}, {POOLS},
ids AS (SELECT norm_domain, source_id, unnest(range(0, n_pool)) AS position FROM pools),
d AS ({sql_draw('ids', 'CAST(source_id AS VARCHAR), CAST(position AS VARCHAR)', 'floor(count(*) OVER (PARTITION BY norm_domain) * 0.15::DOUBLE)')})
SELECT norm_domain, source_id, entry, position, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split
FROM entry_pos JOIN d USING (norm_domain, source_id, position)""")
def c3(spark, sf):
    p = pools(spark, sf)
    d = S.split_by_source(entry_table(p), p.select("source_id", "n_pool"), 0.15, 7)
    return d.select("norm_domain", "source_id", "entry", "position", "split")


@query("c4_split_by_positions", f"""WITH {EPISODES}, {POOLS},
ids AS (SELECT DISTINCT norm_domain, source_id, position FROM entry_pos),
d AS ({sql_draw('ids', 'CAST(source_id AS VARCHAR), CAST(position AS VARCHAR)', 'least(200, count(*) OVER (PARTITION BY norm_domain))')}),
o AS (SELECT *, row_number() OVER (PARTITION BY norm_domain, source_id, position ORDER BY ratio DESC, config_index) AS owner FROM entry_pos)
SELECT norm_domain, source_id, entry, position, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split
FROM o JOIN d USING (norm_domain, source_id, position) WHERE NOT is_val OR owner = 1""")
def c4(spark, sf):
    p = pools(spark, sf)
    pos = S.entry_prefixes(entry_table(p), p)
    return S.split_by_positions(pos, 200, 7).select("norm_domain", "source_id", "entry", "position", "split")


MANIFEST = f"""{CATALOG}, m AS (
  SELECT c.*, count(*) OVER (PARTITION BY norm_domain) AS n,
    CASE WHEN use_trajectory_ratio >= 1 THEN '' ELSE printf('_r%.4f', use_trajectory_ratio) END AS tag,
    trim(regexp_replace(name, '[^A-Za-z0-9_]+', '_', 'g'), '_') || '_' || substr(sha1(path || '|' || printf('%.8f', use_trajectory_ratio)), 1, 10) AS copy_id
  FROM catalog c),
manifest AS (SELECT config_index, norm_domain,
  CASE WHEN n <= 1 THEN 'train_episode_idx' || tag ELSE 'train_episode_idx_' || copy_id END AS train_key,
  CASE WHEN n <= 1 THEN 'val_episode_idx' || tag ELSE 'val_episode_idx_' || copy_id END AS val_key,
  'train_episode_idx' || tag AS legacy_train_key, 'val_episode_idx' || tag AS legacy_val_key,
  'train_val_split_' || substr(sha1('{{"dataset_config_path": "/cfg/mix.json", "dataset_config_sha1": "abc", "norm_stats_domain_name": "' || norm_domain || '", "seed": 7, "val_ratio": 0.1}}'), 1, 12) AS split_file
  FROM m)"""


def manifest(spark, sf):
    return S.split_manifest(catalog(spark, sf), "/cfg/mix.json", "abc", 0.1, 7)


@query("c5_split_manifest", f"WITH {MANIFEST} SELECT * FROM manifest")
def c5(spark, sf):
    return manifest(spark, sf)


def _stored(m):
    """Stored keys: most entries' own keys, some legacy ones, some of an old version."""
    i = F.col("config_index")
    key = F.when(i % 5 != 0, F.array("train_key", "val_key")).when(i % 10 == 0, F.array("legacy_train_key")) \
        .otherwise(F.array(F.lit("train_episode_idx")))
    return m.select("norm_domain", F.explode(key).alias("key"), F.when(i % 13 == 0, 1).otherwise(4).alias("version"))


STORED = """stored AS (SELECT norm_domain, CASE WHEN config_index % 13 = 0 THEN 1 ELSE 4 END AS version,
  unnest(CASE WHEN config_index % 5 <> 0 THEN [train_key, val_key] WHEN config_index % 10 = 0 THEN [legacy_train_key] ELSE ['train_episode_idx'] END) AS key FROM manifest)"""


@query("c5_manifest_reuse", f"""WITH {MANIFEST}, {STORED},
need AS (SELECT DISTINCT norm_domain, unnest([train_key, val_key]) AS key FROM manifest),
have AS (SELECT DISTINCT norm_domain, key FROM stored WHERE version = 4)
SELECT norm_domain, count(*) - count(h.key) AS n_missing, count(*) = count(h.key) AS reusable
FROM need LEFT JOIN have h USING (norm_domain, key) GROUP BY 1""")
def c5_reuse(spark, sf):
    m = manifest(spark, sf)
    return S.manifest_reuse(m, _stored(m))


@query("c5_resolve_split_key", f"""WITH {MANIFEST}, {STORED},
have AS (SELECT DISTINCT norm_domain, key FROM stored)
SELECT m.config_index, m.norm_domain, coalesce(a.key, b.key, c.key) AS key FROM manifest m
LEFT JOIN have a ON a.norm_domain = m.norm_domain AND a.key = m.train_key
LEFT JOIN have b ON b.norm_domain = m.norm_domain AND b.key = m.legacy_train_key
LEFT JOIN have c ON c.norm_domain = m.norm_domain AND c.key = 'train_episode_idx'""")
def c5_resolve(spark, sf):
    m = manifest(spark, sf)
    return S.resolve_split_key(m, _stored(m), "train")


@query("c6_scan_stats", f"""WITH {FRAMES}
SELECT domain, count(DISTINCT file_id) AS files, count(DISTINCT episode_id) AS episodes, count(*) AS steps FROM frames GROUP BY 1""")
def c6(spark, sf):
    return M.scan_stats(frames(spark, sf))


def _groups(spark, sf):
    r = F.col("r_regionkey")
    regions = table(spark, sf, "region").select(
        F.col("r_name").alias("grp"), (r * 0.25).alias("alpha"), (r + 1.0).alias("share"))
    # a configured group without data still takes its share
    empty = table(spark, sf, "region").agg(F.lit("NONE").alias("grp"), F.lit(0.5).alias("alpha"), (F.count(F.lit(1)) * 1.0).alias("share"))
    groups = regions.unionByName(empty)
    members = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == r).select(
        F.col("r_name").alias("grp"), F.col("n_name").alias("domain"))
    return members, groups


def mixed(spark, sf):
    members, groups = _groups(spark, sf)
    return M.mix_weights(M.scan_stats(frames(spark, sf)), members, groups, total_episodes=50_000)


MIX = f"""{FRAMES},
stats AS (SELECT domain, count(DISTINCT file_id) AS files, count(DISTINCT episode_id) AS episodes, count(*) AS steps FROM frames GROUP BY 1),
grps AS (SELECT r_name AS grp, r_regionkey * 0.25::DOUBLE AS alpha, r_regionkey + 1.0::DOUBLE AS share FROM region
  UNION ALL SELECT 'NONE', 0.5::DOUBLE, count(*)::DOUBLE FROM region),
t AS (SELECT round(50000.0::DOUBLE * (sum(steps)::DOUBLE / sum(episodes)::DOUBLE)) AS target FROM stats),
w AS (SELECT r_name AS grp, n_name AS domain, s.episodes, s.steps, g.share, CASE WHEN alpha = 0 THEN 1.0::DOUBLE ELSE pow(s.steps::DOUBLE, alpha) END AS weight
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN stats s ON s.domain = n_name JOIN grps g ON g.grp = r_name),
x AS (SELECT *, weight / sum(weight) OVER (PARTITION BY grp) AS fraction FROM w),
weights AS (SELECT *, (SELECT target FROM t) * (share / (SELECT sum(share) FROM grps)) * fraction AS target_steps,
  (SELECT target FROM t) * (share / (SELECT sum(share) FROM grps)) * fraction / steps AS scale FROM x),
c AS (SELECT *, floor(scale) + CASE WHEN scale - floor(scale) > 0.99 THEN 1 ELSE 0 END AS nfull,
  CASE WHEN scale - floor(scale) > 0.99 OR scale - floor(scale) < 0.01 THEN 0.0 ELSE scale - floor(scale) END AS rem FROM weights)"""


@query("c7_mix_weights", f"""WITH {MIX} SELECT grp, domain, steps, {sql_rnd('fraction')} AS fraction, {sql_rnd('target_steps', 4)} AS target_steps, {sql_rnd('scale')} AS scale FROM weights""")
def c7(spark, sf):
    return mixed(spark, sf).select("grp", "domain", "steps", rnd(F.col("fraction")).alias("fraction"),
                                   rnd(F.col("target_steps"), 4).alias("target_steps"), rnd(F.col("scale")).alias("scale"))


@query("c8_mix_plan", f"""WITH {MIX}
SELECT grp, domain, CASE WHEN nfull > 1 OR rem > 0 THEN domain || '_copy' || CAST(i AS VARCHAR) ELSE domain END AS name, 1.0::DOUBLE AS ratio
FROM (SELECT *, unnest(range(0, CAST(nfull AS BIGINT))) AS i FROM c)
UNION ALL SELECT grp, domain, CASE WHEN nfull > 0 THEN domain || '_copy' || CAST(CAST(nfull AS BIGINT) AS VARCHAR) || '_partial' ELSE domain || '_partial' END, {sql_rnd('rem', 4)}
FROM c WHERE rem > 0""")
def c8(spark, sf):
    return M.mix_plan(mixed(spark, sf)).withColumn("ratio", rnd(F.col("ratio"), 4))


@query("c9_mix_report", f"""WITH {MIX},
g AS (SELECT grp, domain, sum(episodes * scale) AS fe, sum(steps * scale) AS fs, sum(nfull + CASE WHEN rem > 0 THEN 1 ELSE 0 END) AS entries
  FROM c GROUP BY GROUPING SETS ((grp, domain), ()))
SELECT coalesce(grp, 'TOTAL') AS grp, domain, {sql_rnd('fe', 3)} AS final_episodes, {sql_rnd('fs', 3)} AS final_steps, CAST(entries AS BIGINT) AS entries,
 {sql_rnd('100.0::DOUBLE * fe / sum(fe) OVER (PARTITION BY grp IS NULL)', 4)} AS pct_episodes, {sql_rnd('100.0::DOUBLE * fs / sum(fs) OVER (PARTITION BY grp IS NULL)', 4)} AS pct_steps,
 CASE WHEN grp IS NOT NULL THEN row_number() OVER (PARTITION BY grp ORDER BY fs DESC, domain) END AS pos FROM g""")
def c9(spark, sf):
    d = M.mix_report(mixed(spark, sf))
    return d.select("grp", "domain", rnd(F.col("final_episodes"), 3).alias("final_episodes"), rnd(F.col("final_steps"), 3).alias("final_steps"),
                    F.col("entries").cast("bigint").alias("entries"), rnd(F.col("pct_episodes"), 4).alias("pct_episodes"),
                    rnd(F.col("pct_steps"), 4).alias("pct_steps"), "pos")


@query("c10_dataset_report", f"""WITH {FRAMES},
s AS (SELECT *, CASE WHEN episode_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM frames)
SELECT split, coalesce(domain, 'TOTAL') AS domain, count(DISTINCT domain || '/' || file_id::VARCHAR) AS tasks, count(DISTINCT episode_id) AS trajectories,
 count(*) AS frames, CAST(ceil(count(*) / 64.0::DOUBLE) AS BIGINT) AS steps_per_epoch FROM s GROUP BY GROUPING SETS ((split, domain), (split))""")
def c10(spark, sf):
    d = frames(spark, sf).withColumn("split", F.when(F.col("episode_id") % 10 == 0, "val").otherwise("train"))
    return M.dataset_report(d, 64)


BATCHES = """o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(concat_ws('|', '3', '0', CAST(domain AS VARCHAR), CAST(vec_id AS VARCHAR)))) - 1 AS rn,
  count(*) OVER (PARTITION BY domain) AS n FROM vectors),
b0 AS (SELECT *, rn // 32 AS batch_in_domain, rn % 32 AS p, n % 32 AS r FROM o),
b1 AS (SELECT *, p AS slot FROM b0 UNION ALL
  SELECT b0.*, j AS slot FROM b0, (SELECT unnest(range(0, 32)) AS j) WHERE r > 0 AND rn >= n - r AND j >= r AND (j - r) % r = p),
bn AS (SELECT domain, batch_in_domain, row_number() OVER (ORDER BY md5(concat_ws('|', '3', '0', 'batch', CAST(domain AS VARCHAR), CAST(batch_in_domain AS VARCHAR)))) - 1 AS batch_no
  FROM (SELECT DISTINCT domain, batch_in_domain FROM b0)),
batches AS (SELECT b1.domain, batch_in_domain, vec_id, v, slot, batch_no, batch_no % 3 AS rank FROM b1 JOIN bn USING (domain, batch_in_domain))"""


def batches(spark, sf):
    return B.domain_batches(vectors(spark, sf), "vec_id", 32, world=3, seed=3)


@query("c11_domain_batches", f"WITH {VECTORS}, {BATCHES} SELECT domain, batch_in_domain, vec_id, slot, batch_no, rank FROM batches")
def c11(spark, sf):
    return batches(spark, sf).select("domain", *bigint("batch_in_domain", "vec_id", "slot", "batch_no", "rank"))


@query("c12_rank_shards", """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('|', '5', CAST(event_id AS VARCHAR)))) - 1 AS rn, count(*) OVER () AS n FROM events)
SELECT event_id, rn % 4 AS rank, (rn // 4) // 48 AS batch_no, (rn // 4) % 48 AS slot FROM o WHERE rn // 4 < (n // (4 * 48)) * 48""")
def c12(spark, sf):
    d = B.rank_shards(table(spark, sf, "events").select("event_id"), "event_id", 4, 48, 5)
    return d.select(*bigint("event_id", "rank", "batch_no", "slot"))


@query("c13_collate", f"""WITH {VECTORS}, {BATCHES},
s AS (SELECT batch_no, slot, vec_id, v, CASE WHEN vec_id % 2 = 0 THEN 'cam' ELSE 'tac' END AS k FROM batches),
ks AS (SELECT DISTINCT batch_no, k AS key FROM s)
SELECT s.batch_no, ks.key, s.slot, s.vec_id, CASE WHEN s.k = ks.key THEN {sql_rnd('s.v[1]')} END AS value FROM s JOIN ks USING (batch_no)""")
def c13(spark, sf):
    d = batches(spark, sf).withColumn("first", F.get("v", F.lit(0)))
    d = d.withColumn("extra", F.when(F.col("vec_id") % 2 == 0, F.create_map(F.lit("cam"), "first")).otherwise(F.create_map(F.lit("tac"), "first")))
    c = B.collate(d, ["vec_id"], ["extra"])
    flat = c.select("batch_no", "vec_id", F.explode("extra").alias("key", "vals"))
    flat = flat.select("batch_no", "key", F.posexplode(F.arrays_zip("vec_id", "vals")).alias("slot", "z"))
    return flat.select("key", *bigint("batch_no", "slot"), "z.vec_id", rnd(F.col("z.vals")).alias("value"))


@query("c14_shuffle_pick", """SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '11', CAST(doc_id AS VARCHAR)))) - 1 AS order_no,
 CASE WHEN n_chars % 3 = 0 THEN [lang, source] ELSE [lang, source, 'c' || CAST(n_chars AS VARCHAR)] END[
   1 + CAST(('0x' || substr(md5(concat_ws('|', '12', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) % (CASE WHEN n_chars % 3 = 0 THEN 2 ELSE 3 END)] AS picked
FROM documents""")
def c14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    alt = F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("c"), F.col("n_chars").cast("string")))
    d = d.withColumn("picked", B.pick_one([F.col("lang"), F.col("source"), alt], 12, F.col("doc_id")))
    return B.shuffle_samples(d, "doc_id", 11).select("doc_id", *bigint("order_no"), "picked")




# ---------------------------------------------------------------- epoch orders without a sort
def _epoch_sql(seed, epoch):
    """The grid depends on the number of samples, so the passes are written for it inside the query."""
    out = []
    for n in (1_000, 10_000, 100_000):
        p = Permutation(n, seed, epoch)
        out.append(f"""SELECT * FROM (WITH RECURSIVE w(i, x, first) AS (SELECT event_id, event_id, TRUE FROM events WHERE (SELECT count(*) FROM events) = {n}
  UNION ALL SELECT i, {p.sql('x')}, FALSE FROM w WHERE first OR x >= {n}) SELECT i AS event_id, x AS place FROM w WHERE NOT first AND x < {n})""")
    return "places AS (" + " UNION ALL ".join(out) + ")"


@query("c14_epoch_order", f"""WITH {_epoch_sql(5, 2)}
SELECT event_id, place, place // 32 AS batch_no, place % 32 AS slot, place // 32 % 4 AS rank FROM places WHERE place < (SELECT count(*) FROM events) // 32 * 32""")
def c14_epoch(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    d = epoch_batches(e, "event_id", e.count(), 32, 4, seed=5, epoch=2)
    return d.select("event_id", "place", "batch_no", "slot", "rank")


@query("c14_epoch_restart", f"""WITH {_epoch_sql(5, 3)}
SELECT place, event_id, user_id FROM places JOIN events USING (event_id) WHERE place >= (SELECT count(*) FROM events) // 3""")
def c14_restart(spark, sf):
    """The last two thirds of an epoch: their samples are looked up, no order is made."""
    e = table(spark, sf, "events")
    n = e.count()
    rest = epoch_part(spark, n, n // 3, n, seed=5, epoch=3)
    return rest.join(e, rest["sample_no"] == e["event_id"]).select("place", "event_id", "user_id")
