"""Queries over packing, record transforms and instruction text."""

from pyspark.sql import functions as F

from episodica.operators import instruct as J, pack as P, records as R
from episodica.queries.common import EVENTS, FRAMES, VECTORS, bigint, events, forms, frames, longer, sql_forms, sql_longer, table, vectors
from episodica.registry import query, rnd, sql_rnd

# Embeddings cut into the streams of a frame.
PARTS = """parts AS (SELECT vec_id, domain, v, v[1:9] AS r_pose, v[10:9 + vec_id % 8] AS r_arm, v[17:22] AS r_hand,
  list_transform(range(0, 6), lambda j: (vec_id + 5 * j) % 32) AS slots, CASE WHEN domain % 3 = 0 THEN NULL ELSE v[23:28] END AS l_hand, v[29:30] AS l_arm,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE v[31:39] END AS head, v[40:39 + vec_id % 16] AS supp FROM vectors)"""


def parts(spark, sf, step=0):
    i = F.col("vec_id")
    sl = lambda a, n: F.slice("v", F.lit(a + step), n if not isinstance(n, int) else F.lit(n))
    return dict(
        right_pose9=sl(1, 9), right_arm_joints=sl(10, (i % 8).cast("int")), right_hand_joints=sl(17, 6),
        left_pose9=F.lit(None).cast("array<double>"), left_arm_joints=sl(29, 2),
        left_hand_joints=F.when(F.col("domain") % 3 != 0, sl(23, 6)),
        head_pose9=F.when(i % 5 != 0, sl(31, 9)), supplementary_joints=sl(40, (i % 16).cast("int")),
    )


def framed(spark, sf):
    d = vectors(spark, sf).withColumns(parts(spark, sf))
    slots = F.array(*[((F.col("vec_id") + 5 * j) % 32).cast("int") for j in range(6)])
    return d.withColumns({"right_hand_joints_idx": slots, "left_hand_joints_idx": slots})


def _pad(x, n):
    return f"list_resize({x}, {n}, 0.0::DOUBLE)"


def _scatter(vals, idx="slots"):
    return f"list_transform(range(0, 32), lambda s: coalesce({vals}[list_position({idx}, s)], 0.0::DOUBLE))"


ZERO = "list_resize([0.0::DOUBLE], {0}, 0.0::DOUBLE)"


def _state_sql(r_pose, r_arm, r_hand, l_arm, l_hand, head, supp):
    right = f"{r_pose} || {_pad(r_arm, 7)} || {_scatter(r_hand)}"
    left = f"CASE WHEN {l_hand} IS NULL THEN {ZERO.format(48)} ELSE {ZERO.format(9)} || {_pad(l_arm, 7)} || {_scatter(l_hand)} END"
    return f"{right} || ({left}) || coalesce({head}, {ZERO.format(9)}) || {_pad(supp, 15)}"


@query("g1_pack_state", f"""WITH {VECTORS}, {PARTS}, f AS (SELECT vec_id, {_state_sql('r_pose', 'r_arm', 'r_hand', 'l_arm', 'l_hand', 'head', 'supp')} AS state FROM parts)
{sql_longer('f', 'vec_id', 'state')}""")
def g1(spark, sf):
    return longer(P.pack_state(framed(spark, sf)), ["vec_id"], "state")


def _chunked(spark, sf, steps=3):
    d = framed(spark, sf)
    rows = [parts(spark, sf, k) for k in range(steps)]
    d = d.withColumns({f"chunk_{n}": F.array(*[r[n] for r in rows]) for n in rows[0] if n != "left_pose9"})
    d = d.withColumn("chunk_left_pose9", F.lit(None).cast("array<array<double>>"))
    return d.withColumn("chunk_right_hand_usage", F.array(*[((F.col("vec_id") + k) % 2).cast("int") for k in range(steps)]))


def _actions_sql(mode):
    """One row per (vec_id, step) of packed actions and masks."""
    rel = mode != "absolute"

    def v(a, n):
        return f"v[{a} + k : {a} + k + ({n}) - 1]"

    def minus(x, b):
        return f"list_transform(list_zip({x}, {b}), lambda p: p[1] - p[2])" if rel else x

    def hand(x, b):
        if mode != "mix":
            return minus(x, b)
        return f"list_transform(list_zip({x}, {b}, slots), lambda p: CASE WHEN p[3] = 28 THEN p[1] ELSE p[1] - p[2] END)"

    supp = v(40, "vec_id % 16")
    vec = _state_sql(v(1, 9), minus(v(10, "vec_id % 8"), "r_arm"), hand(v(17, 6), "r_hand"), minus(v(29, 2), "l_arm"),
                     f"(CASE WHEN l_hand IS NULL THEN NULL ELSE {hand(v(23, 6), 'l_hand')} END)", f"(CASE WHEN head IS NULL THEN NULL ELSE {v(31, 9)} END)",
                     minus(supp, "supp") if mode == "relative" else supp)
    one = "list_resize([]::DOUBLE[], {0}, 1.0::DOUBLE)"
    hm = _scatter("list_transform(slots, lambda s: 1.0::DOUBLE)")
    right = f"list_transform({one.format(9)} || {_pad(one.format('vec_id % 8'), 7)} || {hm}, lambda x: x * ((vec_id + k) % 2))"
    left = f"CASE WHEN l_hand IS NULL THEN {ZERO.format(48)} ELSE {ZERO.format(9)} || {_pad(one.format(2), 7)} || {hm} END"
    mask = f"{right} || ({left}) || (CASE WHEN head IS NULL THEN {ZERO.format(9)} ELSE {one.format(9)} END) || {_pad(one.format('vec_id % 16'), 15)}"
    return f"""WITH {VECTORS}, {PARTS}, f AS (SELECT vec_id, k AS step, {vec} AS actions, {mask} AS action_mask FROM parts, (SELECT unnest(range(0, 3)) AS k))
{sql_forms('f', 'vec_id, step', ['actions', 'action_mask'])}"""


def _packed(spark, sf, mode):
    d = P.pack_actions(_chunked(spark, sf), mode)
    d = d.select("vec_id", F.posexplode(F.arrays_zip("actions", "action_mask")).alias("step", "z")).select(
        "vec_id", F.col("step").cast("bigint").alias("step"), "z.actions", "z.action_mask")
    return forms(d, ["vec_id", "step"], ["actions", "action_mask"])


@query("g2_pack_actions", _actions_sql("absolute"))
def g2(spark, sf):
    return _packed(spark, sf, "absolute")


@query("g3_joints_relative", _actions_sql("relative"))
def g3_rel(spark, sf):
    return _packed(spark, sf, "relative")


@query("g3_joints_mix", _actions_sql("mix"))
def g3_mix(spark, sf):
    return _packed(spark, sf, "mix")


@query("g4_coalesce_camera", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 = 0 THEN source ELSE 'w' || lang END AS base_image,
 doc_id % 2 = 0 AS ego, doc_id % 3 = 0 AS wrist, true AS left_wrist, false AS main FROM documents""")
def g4(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("camera_ego_rgb"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("right_wrist_camera_rgb"), F.concat(F.lit("w"), "lang").alias("left_wrist_camera_rgb"))
    d = P.coalesce_camera(d)
    return d.select("doc_id", "base_image", F.col("camera_ego_rgb_mask").alias("ego"), F.col("right_wrist_camera_rgb_mask").alias("wrist"),
                    F.col("left_wrist_camera_rgb_mask").alias("left_wrist"), F.col("camera_main_rgb_mask").alias("main"))


@query("g5_side_area_offset", f"""WITH {EVENTS} SELECT event_id, CAST(k % 24 + CASE WHEN event_id % 2 = 0 THEN 24 ELSE 0 END AS BIGINT) AS a0, CAST((k + 1) % 24 + CASE WHEN event_id % 2 = 0 THEN 24 ELSE 0 END AS BIGINT) AS a1 FROM events0""")
def g5(spark, sf):
    side = F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")
    a = P.side_area_offset(F.array(F.col("k") % 24, (F.col("k") + 1) % 24), side)
    return events(spark, sf).select("event_id", F.get(a, F.lit(0)).cast("bigint").alias("a0"), F.get(a, F.lit(1)).cast("bigint").alias("a1"))


CLEAN = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("g6_prompt_clean", f"""WITH p AS (SELECT doc_id, source, {CLEAN} AS t FROM documents), d AS (SELECT doc_id, source, CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS t FROM p)
SELECT doc_id, md5(t) AS plain, md5('[' || source || '] ' || t) AS conditioned, md5(replace(replace(lower(t), '_', ' '), chr(10), ' ')) AS flat FROM d""")
def g6(spark, sf):
    t, s = F.col("text"), F.col("source")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(P.prompt_clean(t)).alias("plain"), F.md5(P.prompt_clean(t, s)).alias("conditioned"),
        F.md5(P.prompt_clean(t, lower=True, flatten=True)).alias("flat"))


def _rows(v="v", h=8, d=8):
    return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda k: F.slice(F.col(v), k * d + 1, F.lit(d)))


def _chunk_long(df, col, key="vec_id"):
    d = df.select(key, F.posexplode(col).alias("step", "a")).select(key, F.col("step").cast("bigint").alias("step"), F.posexplode("a").alias("dim", "x"))
    return d.select(key, "step", F.col("dim").cast("bigint").alias("dim"), rnd(F.col("x")).alias("value"))


CELLS = """cells AS (SELECT vec_id, v, (i - 1) // 8 AS step, (i - 1) % 8 AS dim, v[i] AS x, v[(i - 1) % 8 + 33] AS s FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM vectors))"""


@query("g7_delta_actions", f"""WITH {VECTORS}, {CELLS} SELECT vec_id, step, dim, {sql_rnd('CASE WHEN dim IN (0, 1, 4, 5, 6) THEN x - s ELSE x END')} AS value FROM cells""")
def g7(spark, sf):
    m = (2, -2, 3)
    d = vectors(spark, sf).withColumn("chunk", P.delta_actions(_rows(), F.slice("v", 33, 8), m))
    return _chunk_long(d, "chunk")


@query("g7_absolute_actions", f"""WITH {VECTORS}, {CELLS} SELECT vec_id, step, dim, {sql_rnd('x')} AS value FROM cells""")
def g7_abs(spark, sf):
    m = (2, -2, 3)
    d = vectors(spark, sf).withColumn("chunk", P.delta_actions(_rows(), F.slice("v", 33, 8), m))
    return _chunk_long(d.withColumn("chunk", P.absolute_actions(F.col("chunk"), F.slice("v", 33, 8), m)), "chunk")


@query("g8_pad_subsample", f"""WITH {VECTORS}, {CELLS} SELECT vec_id, step // 3 AS step, dim, {sql_rnd('x')} AS value FROM cells WHERE step % 3 = 0
UNION ALL SELECT vec_id, j // 3, d, 0.0 FROM vectors, (SELECT unnest([0, 3, 6]) AS j), (SELECT unnest([8, 9]) AS d)""")
def g8(spark, sf):
    d = vectors(spark, sf).withColumn("chunk", F.transform(P.subsample_chunk(_rows(), 3), lambda a: P.pad_dims(a, 10)))
    return _chunk_long(d, "chunk")


@query("g9_repack", f"""WITH {EVENTS} SELECT event_id, stream AS kind, {sql_rnd('value')} AS v, CAST(k AS BIGINT) AS slot FROM events0""")
def g9(spark, sf):
    d = events(spark, sf).select("event_id", F.struct(F.struct(F.col("stream").alias("top")).alias("image"), F.struct("value", "k").alias("state")).alias("observation"))
    d = R.repack(d, {"event_id": "event_id", "out": {"kind": "observation/image/top", "body": {"v": "observation/state/value", "slot": "observation/state/k"}}})
    return d.select("event_id", "out.kind", rnd(F.col("out.body.v")).alias("v"), F.col("out.body.slot").cast("bigint").alias("slot"))


@query("g9_rename_tree", f"""WITH {EVENTS} SELECT event_id, stream AS cam_top, {sql_rnd('value')} AS signal FROM events0""")
def g9_rename(spark, sf):
    d = events(spark, sf).select("event_id", F.struct(F.struct(F.col("stream").alias("top")).alias("image"), F.struct("value", "k").alias("state")).alias("observation"))
    d = R.rename_tree(d, {r"observation/image/(\w+)": r"image/cam_\1", "observation/state/k": None, r"observation/(state)/value": r"\1/signal"})
    return d.select("event_id", "image.cam_top", rnd(F.col("state.signal")).alias("signal"))


@query("g10_inject_apply", f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE lang END AS prompt, CAST(n_chars * 3 AS BIGINT) AS n FROM documents""")
def g10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("prompt"), F.struct("n_chars", "source").alias("meta"))
    d = R.apply_to_keys(R.inject_default(d, "prompt", "none"), {"meta/n_chars": 3}, lambda c, k: c * k, strict=True)
    return R.drop_strings(d.withColumn("extra", F.lit("x"))).join(d.select("doc_id", "prompt"), "doc_id").select("doc_id", "prompt", F.col("meta.n_chars").alias("n"))


@query("g11_task_prompt", f"""WITH {FRAMES}, t AS (SELECT n_nationkey AS task_index, 'work in ' || n_name AS task, n_name FROM nation)
SELECT episode_id, frame_idx, task_index, task AS prompt FROM frames JOIN t ON domain = n_name""")
def g11(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("task_index"), F.concat(F.lit("work in "), "n_name").alias("task"), F.col("n_name").alias("domain"))
    d = frames(spark, sf).join(n.select("task_index", "domain"), "domain")
    return R.task_prompt(d, n.select("task_index", "task")).select("episode_id", *bigint("frame_idx"), "task_index", "prompt")


@query("g11_unknown_tasks", f"""WITH {FRAMES} SELECT DISTINCT file_id AS task_index FROM frames WHERE file_id NOT IN (SELECT s_suppkey FROM supplier)""")
def g11_unknown(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("task_index"))
    return R.unknown_tasks(frames(spark, sf).withColumnRenamed("file_id", "task_index"), t)


SIGN = "[1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1]"


@query("g12_adapter_two_arm", f"""WITH {VECTORS},
s AS (SELECT vec_id, d, v[d + 1] * ({SIGN})[d + 1] AS x FROM vectors, (SELECT unnest(range(0, 14)) AS d)),
a AS (SELECT vec_id, d, x, x * (0.058::DOUBLE - 0.01844::DOUBLE) + 0.01844::DOUBLE AS l FROM s)
SELECT vec_id, 'state' AS form, d AS dim, {sql_rnd('CASE WHEN d IN (6, 13) THEN (asin(greatest(-1.0, least(1.0, (0.022::DOUBLE**2 + l*l - 0.036::DOUBLE**2) / (2*0.022::DOUBLE*l)))) - 0.5476::DOUBLE) / (1.6296::DOUBLE - 0.5476::DOUBLE) ELSE x END', 5)} AS value FROM a
UNION ALL SELECT vec_id, 'actions_in', d, {sql_rnd('CASE WHEN d IN (6, 13) THEN x * (1.4910::DOUBLE + 0.6213::DOUBLE) - 0.6213::DOUBLE - 0.5476::DOUBLE ELSE x END', 5)} FROM a
UNION ALL SELECT vec_id, 'actions_out', d, {sql_rnd('CASE WHEN d IN (6, 13) THEN (x + 0.5476::DOUBLE + 0.6213::DOUBLE) / (1.4910::DOUBLE + 0.6213::DOUBLE) ELSE x END', 5)} FROM a""")
def g12(spark, sf):
    d = vectors(spark, sf).select("vec_id", F.slice("v", 1, 14).alias("state"), F.array(F.slice("v", 1, 14)).alias("actions"), F.array("v").alias("model"), F.slice("v", 1, 2).alias("cam_high"))
    d = R.embodiment_adapter(d, "two_arm").withColumn("actions_in", F.get("actions", F.lit(0))).withColumn(
        "actions_out", F.get(R.adapter_output(F.col("model"), "two_arm"), F.lit(0)))
    return forms(d, ["vec_id"], ["state", "actions_in", "actions_out"], 5)


@query("g12_adapter_joint_gripper", f"""WITH {VECTORS}, f AS (SELECT vec_id, v[1:7] || v[8:8] AS state, v[1:8] AS actions, v[20:21] AS base, [0.0::DOUBLE, 0.0] AS pad, v[1:7] AS seven,
  [1.0::DOUBLE, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END, 0.0] AS masks FROM vectors)
{sql_forms('f', 'vec_id', ['state', 'actions', 'base', 'pad', 'seven', 'masks'])}""")
def g12_joint(spark, sf):
    d = vectors(spark, sf).select("vec_id", "v", F.slice("v", 1, 7).alias("joint_position"), F.slice("v", 8, 1).alias("gripper_position"),
                                  F.slice("v", 20, 2).alias("exterior_image_1_left"), F.when(F.col("vec_id") % 3 != 0, F.slice("v", 22, 2)).alias("wrist_image_left"))
    d = R.embodiment_adapter(d, "joint_gripper")
    d = d.withColumns({"actions": F.get(R.adapter_output(F.array("v"), "joint_gripper"), F.lit(0)), "seven": F.get(R.adapter_output(F.array("v"), "single_arm"), F.lit(0)),
                       "base": F.col("image.base_0_rgb"), "pad": F.col("image.right_wrist_0_rgb"),
                       "masks": F.array(*[F.col(f"image_mask.{c}").cast("double") for c in ("base_0_rgb", "left_wrist_0_rgb", "right_wrist_0_rgb")])})
    return forms(d, ["vec_id"], ["state", "actions", "base", "pad", "seven", "masks"])


@query("g13_discretize_state", f"""WITH {VECTORS}, c AS (SELECT vec_id, d, v[d + 1] * 6 AS x FROM vectors, (SELECT unnest(range(0, 64)) AS d)),
b AS (SELECT vec_id, d, CASE WHEN x < -1 THEN -1 ELSE least(CAST(floor((x + 1) * 128) AS BIGINT), 255) END AS bin FROM c)
SELECT b.vec_id, d AS dim, bin, {sql_rnd('bin / 256.0::DOUBLE * 2 - 1')} AS back, t.txt FROM b JOIN (SELECT vec_id, md5(string_agg(CAST(bin AS VARCHAR), ' ' ORDER BY d)) AS txt FROM b GROUP BY 1) t USING (vec_id)""")
def g13(spark, sf):
    d = vectors(spark, sf).withColumn("x", F.transform("v", lambda v: v * 6)).withColumn("b", P.discretize_state(F.col("x"))).withColumn("txt", F.md5(P.state_text(F.col("x"))))
    z = F.posexplode(F.arrays_zip(F.col("b"), P.undiscretize(F.col("b")).alias("u")))
    d = d.select("vec_id", "txt", z.alias("dim", "z"))
    return d.select("vec_id", "txt", *bigint("dim"), F.col("z.b").cast("bigint").alias("bin"), rnd(F.col("z.u")).alias("back"))


@query("g14_transform_chain", f"""WITH {VECTORS}, f AS (SELECT vec_id, 'none' AS note, list_resize(list_transform(v, lambda x: x * 2 + 1), 66, 0.0::DOUBLE) AS state FROM vectors)
{sql_longer('f', 'vec_id, note', 'state')}""")
def g14(spark, sf):
    before, _ = R.with_steps([("scale", "state", 2.0), ("shift", "state", 1.0)], [], [("pad", "state", 66), ("default", "note", "none")])
    d = vectors(spark, sf).select("vec_id", F.col("v").alias("state"))
    return longer(R.run_steps(d, before), ["vec_id", "note"], "state")


@query("g15_pixel_scale", f"""WITH {VECTORS}, f AS (SELECT vec_id, list_transform(v, lambda x: x * 100 / 255.0::DOUBLE * 2 - 1) AS scaled, list_transform(v, lambda x: x * 100) AS back,
 CASE WHEN list_max(v) > 0.3 THEN list_transform(v, lambda x: (x + 0.7) / 255.0::DOUBLE * 2 - 1) ELSE list_transform(v, lambda x: x + 0.7) END AS detected FROM vectors)
{sql_forms('f', 'vec_id', ['scaled', 'back', 'detected'])}""")
def g15(spark, sf):
    d = vectors(spark, sf).withColumn("px", F.transform("v", lambda x: x * 100)).withColumn("shifted", F.transform("v", lambda x: x + 0.7))
    d = d.withColumn("scaled", P.pixel_scale(F.col("px"))).withColumn("back", P.pixel_unscale(F.col("scaled"))).withColumn("detected", P.pixel_scale(F.col("shifted"), True))
    return forms(d, ["vec_id"], ["scaled", "back", "detected"])


# ----------------------------------------------------------------------- text


@query("j1_instruction_from_name", f"""WITH n AS (SELECT doc_id, replace(source, 'src', 'pick up ') AS t, source, lang FROM documents)
SELECT doc_id, t || '.' AS instruction, 'pick_up_' || source AS parts, doc_id % 7 <> 0 AS valid FROM n""")
def j1(spark, sf):
    name = F.concat(F.lit("robot_me+ "), F.replace(F.col("source"), F.lit("src"), F.lit("pick_up_")), F.when(F.col("doc_id") % 5 == 0, ".").otherwise(""), F.lit(" +"), F.col("lang"))
    maybe = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("+"), name)).otherwise(name)
    folder = F.concat(F.lit("robot_me_pick_up_"), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", J.instruction_from_name(name).alias("instruction"), J.instruction_from_parts(folder).alias("parts"),
                                                J.valid_instruction_name(maybe).alias("valid"))


@query("j2_instruction_normalize", r"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'dataset_' ELSE 'fold_' || source || '_dataset_' || lang END AS t FROM documents),
x AS (SELECT doc_id, t, trim(replace(replace(replace(t, '_dataset', ''), 'dataset', ''), '_', ' ')) AS c FROM n),
y AS (SELECT doc_id, CASE WHEN c = '' THEN t ELSE c END AS c FROM x)
SELECT doc_id, c AS plain, CASE WHEN length(c) < 12 THEN rpad(c, 12, ' ') ELSE c END AS padded FROM y""")
def j2(spark, sf):
    t = F.when(F.col("doc_id") % 9 == 0, F.lit("dataset_")).otherwise(F.concat(F.lit("fold_"), "source", F.lit("_dataset_"), "lang"))
    return table(spark, sf, "documents").select("doc_id", J.instruction_normalize(t).alias("plain"), J.instruction_normalize(t, 12).alias("padded"))


POOL = """base AS (SELECT DISTINCT source AS task, 'do ' || source AS text FROM documents),
ex0 AS (SELECT source AS task, doc_id, 'please ' || source || ' ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 1 + doc_id % 13) AS text FROM documents),
ex AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY doc_id) - 1 AS pos, text FROM ex0),
n AS (SELECT task, max(pos) + 1 AS n FROM ex GROUP BY 1),
pool AS (SELECT task, pos AS cand_no, CASE WHEN length(text) < 22 THEN rpad(text, 22, ' ') ELSE text END AS text FROM ex WHERE length(text) <= 22
  UNION ALL SELECT b.task, coalesce(n.n, 0) + c, rpad(b.text, 22, ' ') FROM base b LEFT JOIN n USING (task), (SELECT unnest(range(0, 10)) AS c)),
cand AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY cand_no) - 1 AS ci, count(*) OVER (PARTITION BY task) AS k FROM pool)"""


def _pool(spark, sf):
    from episodica.plans.ordered import number_rows

    d = table(spark, sf, "documents").select(F.col("source").alias("task"), "doc_id")
    base = d.select("task", F.concat(F.lit("do "), "task").alias("text")).distinct()
    ex = d.select("task", "doc_id", F.concat(
        F.lit("please "), "task", F.lit(" "), F.substring(F.md5(F.col("doc_id").cast("string")), F.lit(1), (1 + F.col("doc_id") % 13).cast("int"))).alias("text"))
    ex = number_rows(ex, ["task"], ["doc_id"], F.floor(F.col("doc_id") / 100_000), "pos")
    return d, base, J.instruction_pool(base, ex, 22)


def sql_hash(seed, col, start=1):
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', CAST({col} AS VARCHAR))), {start}, 8)) AS BIGINT)"


@query("j3_draw_instruction", f"""WITH {POOL}
SELECT d.doc_id AS episode_id, c.task, c.text AS instruction FROM documents d JOIN (SELECT DISTINCT task, k FROM cand) k ON k.task = d.source
JOIN cand c ON c.task = d.source AND c.ci = {sql_hash(4, 'd.doc_id')} % k.k""")
def j3(spark, sf):
    d, _, pool = _pool(spark, sf)
    return J.draw_instruction(d.withColumnRenamed("doc_id", "episode_id"), pool, 4).select("episode_id", "task", "instruction")


@query("j3_draw_per_frame", f"""WITH {POOL}
SELECT d.doc_id AS frame_id, c.task, CASE WHEN {sql_hash(6, 'd.doc_id')} % 5 = 0 THEN 'do ' || c.task ELSE c.text END AS instruction FROM documents d JOIN (SELECT DISTINCT task, k FROM cand) k ON k.task = d.source
JOIN cand c ON c.task = d.source AND c.ci = {sql_hash(6, 'd.doc_id', 9)} % k.k""")
def j3_frame(spark, sf):
    d, base, pool = _pool(spark, sf)
    return J.draw_instruction_per_frame(d.withColumnRenamed("doc_id", "frame_id"), base, pool, 6).select("frame_id", "task", "instruction")


@query("j4_pool_clean", r"""WITH t AS (SELECT source || '_dataset' AS task, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN ' the dataset ' WHEN doc_id % 3 = 1 THEN source || '_data set' ELSE ' wipe ' || lang || ' ' END AS text FROM documents WHERE source <> 'src3'
  UNION ALL SELECT 'src3_dataset', doc_id, 'a dataset' FROM documents WHERE source = 'src3'),
c AS (SELECT task, pos, CASE WHEN contains(text, 'dataset') OR replace(trim(text), ' ', '') = task THEN replace(task, '_dataset', '') ELSE trim(text) END AS text, replace(task, '_dataset', '') AS b FROM t),
h AS (SELECT task, bool_or(text <> b) AS has, min(pos) AS first FROM c GROUP BY 1)
SELECT c.task, c.pos, c.text FROM c JOIN h USING (task) WHERE c.text <> c.b OR (NOT has AND pos = first)""")
def j4(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("_dataset")).alias("task"), F.col("doc_id").alias("pos"), "source", "lang")
    m = F.col("pos") % 3
    text = F.when(F.col("source") == "src3", F.lit("a dataset")).when(m == 0, F.lit(" the dataset ")).when(m == 1, F.concat("source", F.lit("_data set"))) \
        .otherwise(F.concat(F.lit(" wipe "), "lang", F.lit(" ")))
    return J.instruction_pool_clean(d.select("task", "pos", text.alias("text")))


@query("j4_parse_numbered_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
m AS (SELECT doc_id, i, trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS t FROM l),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, t FROM m WHERE t <> '')
SELECT doc_id, n - 1 AS pos, md5(t) AS h FROM k""")
def j4_lines(spark, sf):
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.regexp_replace(x, r"^\s+|\s+$", "") == "", x).otherwise(
        F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.regexp_replace(F.regexp_replace(x, r"\] ", "]"), r"^\s+", "")))), "\n")
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(J.parse_numbered_lines(numbered)).alias("pos", "t"))
    return d.select("doc_id", *bigint("pos"), F.md5("t").alias("h"))
