"""One named test per known pitfall of the semantics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import layout as L
from episodica.operators import align as A, batch as B, episodes as E, instruct as J, metrics as M, mix as X, normalize as N, pack as P, records as R
from episodica.operators import sensors as S, split as SP
from episodica.sources import catalog as C


def seq(spark, values, ts=None):
    rows = [(1, i, float(ts[i]) if ts is not None else float(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "episode_id long, frame_idx long, ts double, value double")


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()])


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_t1_state_order_is_right_left_head_supplementary(spark):
    assert [b for b, _ in L.BLOCKS][0].startswith("right") and L.WIDTH == 120 and L.block_ranges()[4][1] == 48
    d = one(spark, right_pose9=arr(*[1] * 9), right_arm_joints=arr(2), right_hand_joints=arr(3), right_hand_joints_idx=F.array(F.lit(28)),
            left_pose9=arr(*[4] * 9), left_arm_joints=arr(5), left_hand_joints=arr(6), left_hand_joints_idx=F.array(F.lit(0)),
            head_pose9=arr(*[7] * 9), supplementary_joints=arr(8))
    s = P.pack_state(d).first().state
    assert len(s) == 120 and s[0] == 1 and s[9] == 2 and s[10] == 0 and s[16 + 28] == 3 and s[48] == 4 and s[64] == 6 and s[96] == 7 and s[105] == 8


def test_t2_t4_t5_clip_and_guards(spark):
    d = spark.createDataFrame([("d", [float(i), 5.0, 0.0])for i in range(11)], "domain string, v array<double>")
    z = {r.dim: (r.lo, r.hi) for r in N.norm_fit(d, ["domain"], "v", "zscore").collect()}
    assert z[0] == (5.0, pytest.approx(np.std(range(11)))) and z[1] == (5.0, 1.0)
    q = {r.dim: (r.lo, r.hi) for r in N.norm_fit(d, ["domain"], "v", "quantile").collect()}
    assert q[0] == (pytest.approx(0.1), pytest.approx(9.9)) and q[1] == (4.5, 5.5) and q[2] == (-0.5, 0.5)
    st = N.norm_fit(d, ["domain"], "v", "zscore").withColumn("scope", F.lit("domain"))
    far = spark.createDataFrame([("d", [1e6, 5.0, 0.0])], "domain string, v array<double>")
    assert N.norm_apply(far, "v", st, "zscore", 3).first().v[0] == 10.0
    sq = N.norm_fit(d, ["domain"], "v", "quantile").withColumn("scope", F.lit("domain"))
    assert N.norm_apply(far, "v", sq, "quantile", 3).first().v[0] == 2.0


def test_t3_quantile_inverse_omits_the_epsilon(spark):
    d = spark.createDataFrame([("d", [float(i)]) for i in range(101)], "domain string, v array<double>")
    st = N.norm_fit(d, ["domain"], "v", "quantile").withColumn("scope", F.lit("domain"))
    x = spark.createDataFrame([("d", [30.0])], "domain string, v array<double>")
    back = N.norm_invert(N.norm_apply(x, "v", st, "quantile", 1), "v", st, "quantile", 1).first().v[0]
    assert back != 30.0 and abs(back - 30.0) < 1e-5
    lo, hi = arr(1), arr(99)
    y = one(spark, v=arr(30)).withColumn("w", N.unscale_simple(N.scale_simple(F.col("v"), lo, hi, True), lo, hi, True)).first().w[0]
    assert y == pytest.approx(30.0, abs=1e-12)


def test_width_mismatch_is_an_error(spark):
    d = spark.createDataFrame([("d", [1.0, 2.0])], "domain string, v array<double>")
    st = spark.createDataFrame([("d", 0, 0.0, 1.0, "domain")], "domain string, dim long, lo double, hi double, scope string")
    with pytest.raises(Exception, match="wide"):
        N.norm_apply(d, "v", st, "zscore", 3).collect()


def loop_d1(ts, start, dt, nxt=0, neg=False):
    out = []
    for i, t in enumerate(ts):
        g = math.floor((t - start) / dt + 1e-5)
        if g < 0 and not neg:
            continue
        if nxt is None:
            nxt = g
        while nxt <= g:
            out.append((nxt, i))
            nxt += 1
    return out


@pytest.mark.parametrize("first,neg", [(0, False), (None, False), (-3, True)])
def test_t6_gaps_fill_from_the_next_record(spark, first, neg):
    rng = np.random.default_rng(3)
    ts = np.sort(rng.random(60) * 30 - 4)
    d = A.grid_align(seq(spark, range(60), ts), 0.0, 1.0, first=first, allow_negative=neg)
    assert sorted((r.bucket, r.frame_idx) for r in d.collect()) == loop_d1(ts, 0.0, 1.0, first, neg)


def test_d2_has_every_target(spark):
    d = A.align_to_targets(seq(spark, range(4), [0.2, 0.9, 5.5, 6.1]), 0.0, 1.0, -2, 12)
    got = {r.bucket: r.frame_idx for r in d.collect()}
    assert list(sorted(got)) == list(range(-2, 13)) and got[12] == 3 and got[-2] == 0


def test_t7_speed_above_one_makes_more_frames(spark):
    d = seq(spark, range(11))
    assert A.resample_grid(d, 2.5).count() == 26 and A.resample_grid(d, 0.5).count() == 6
    v = {r.grid_idx: r.value for r in A.interp_linear(d, 2.5, ["value"]).collect()}
    assert v[1] == pytest.approx(0.4) and v[25] == pytest.approx(10.0)


@pytest.mark.parametrize("n,want", [(16, 1), (17, 2), (5, 1), (2, 1), (32, 3)])
def test_t8_tail_of_overlapped_chunks(spark, n, want):
    d = E.chunk_overlap(seq(spark, range(n)), 8, 4)
    rows = d.collect()
    full = max((n - 4) // 8, 0)
    chunks = {c: [i for i in range(n) if 8 * c <= i < 8 * (c + 1) + 4] for c in range(full + (n % 8 != 0))}
    got = {}
    for r in rows:
        got.setdefault(r.chunk_no, []).append(r.frame_idx)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in chunks.items() if v}
    assert len(got) == want or n == 8


def test_t10_padding_repeats_the_last_strided_step(spark):
    r = A.action_chunk(seq(spark, range(8)), ["value"], 4, 3).where("frame_idx = 3").first()
    assert r.chunk_value == [3.0, 6.0, 6.0, 6.0] and r.n_valid == 2
    r = A.action_chunk(seq(spark, range(8)), ["value"], 4, 3, clamp=True).where("frame_idx = 3").first()
    assert r.chunk_value == [3.0, 6.0, 7.0, 7.0]


def test_history_is_oldest_first_and_clamped(spark):
    r = {x.frame_idx: x.hist_value for x in A.history(seq(spark, range(6)), ["value"], [1, 4]).collect()}
    assert r[5] == [1.0, 4.0, 5.0] and r[0] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        A.history(seq(spark, range(3)), ["value"], [1], disable_history=True)


def test_static_window_large_stride_matches_brute_force(spark):
    vals = [1.0] * 20 + [2.0] + [1.0] * 25
    for stride in (1, 7):
        d = A.static_window_flag(seq(spark, vals), [F.col("value")], 1, 3, stride)
        for r in d.collect():
            i, n = r.frame_idx, len(vals)
            acts = [i + k * stride for k in range(3) if i + k * stride < n]
            w = vals[max(max(i - 1, 0) - 5, 0): min(acts[-1] + 5, n)]
            assert r.is_static == all(abs(x - w[0]) <= 1e-6 + 1e-5 * abs(w[0]) for x in w), (stride, i)


def test_t11_presence_uses_the_first_sample(spark):
    d = spark.createDataFrame([("a", 0, [1.0] + [0.0] * 63), ("a", 1, [0.0] * 64), ("b", 2, [0.0] * 64), ("b", 3, [1.0] * 64)], "domain string, i long, m array<double>")
    f = {(r.domain, r.block): r.frequency for r in M.group_frequency(d, "m", 64, "i").collect()}
    assert f[("a", "right-wrist-pos")] == 1.0 and f[("b", "right-wrist-pos")] == 0.0 and f[(None, "right-wrist-pos")] == 0.5


def test_t12_loss_divides_by_at_least_one(spark):
    c = spark.createDataFrame([(1, "a", 4.0, 1.0), (1, "b", 8.0, 0.0)], "sample_id long, block string, loss double, mask double")
    w = spark.createDataFrame([("a", 0.25), ("b", 1.0)], "block string, weight double")
    assert M.balanced_loss(c, w).first().loss == 1.0


def test_t13_weighted_ape_and_invalid(spark):
    d = spark.createDataFrame([("d", 0, 0, 1.0, 2.0), ("d", 0, 0, 3.0, 2.0), ("d", 0, 0, 9.0, 0.0)], "domain string, batch_id long, dim long, err double, truth double")
    v = {(r.block, r.name): r.value for r in M.error_metrics(d).collect()}
    assert v[("total", "ape")] == 1.0 and v[("total", "rmse")] == pytest.approx(math.sqrt(91 / 3))
    m = spark.createDataFrame([("d", "x", -1.0), ("d", "x", 3.0), ("d", "y", -1.0)], "domain string, name string, value double")
    r = {(x.domain, x.name): x.value for x in M.metric_rollup(m).collect()}
    assert r[("d", "x")] == 3.0 and r[(None, "y")] is None


def test_t15_glitch_ties_go_to_the_earlier_frame(spark):
    vals = [1.0, 1e30, 3.0, float("nan"), float("nan"), 6.0]
    d = seq(spark, range(6)).withColumn("j", F.array(F.element_at(F.array(*[F.lit(v) for v in vals]), (F.col("frame_idx") + 1).cast("int"))))
    got = [r.j[0] for r in S.repair_glitches(d, "j").orderBy("frame_idx").collect()]
    assert got == [1.0, 1.0, 3.0, 3.0, 6.0, 6.0]
    bad = seq(spark, range(2)).withColumn("j", arr(1e9, 1))
    assert S.repair_glitches(bad, "j").first().j == [0.0, 0.0]


def test_t16_shares_count_empty_groups(spark):
    st = spark.createDataFrame([("x", 10, 100), ("y", 10, 300)], "domain string, episodes long, steps long")
    mem = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "z")], "grp string, domain string")
    g = spark.createDataFrame([("g", 1.0, 1.0), ("h", 0.0, 3.0)], "grp string, alpha double, share double")
    w = {r.domain: r.target_steps for r in X.mix_weights(st, mem, g).collect()}
    assert w == {"x": 25.0, "y": 75.0}


def test_t17_batches_are_pure_full_and_cycle_their_own_rows(spark):
    d = spark.createDataFrame([("a" if i < 70 else "b", i) for i in range(75)], "domain string, k long")
    rows = B.domain_batches(d, "k", 16, world=2, seed=1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch_no, []).append(r)
    assert len(by) == 6 and all(len(v) == 16 and len({r.domain for r in v}) == 1 and sorted(r.slot for r in v) == list(range(16)) for v in by.values())
    assert {r.k for r in rows} == set(range(75)) and all(r.rank == r.batch_no % 2 for r in rows)
    tail = sorted((r for r in rows if r.domain == "b"), key=lambda r: r.slot)
    assert [r.k for r in tail] == [tail[j % 5].k for j in range(16)]
    assert {r.domain: r.n_batches for r in B.batch_count(d, 16).collect()} == {"a": 5, "b": 1}


def test_t18_total_row_uses_the_ceiling_of_the_total(spark):
    rows = [("train", dom, f, f * 10 + e, i) for dom in "ab" for f in range(2) for e in range(2) for i in range(5)]
    d = spark.createDataFrame(rows, "split string, domain string, file_id long, episode_id long, frame_idx long")
    r = {x.domain: x for x in X.dataset_report(d, 16).collect()}
    assert r["a"].steps_per_epoch == 2 and r["TOTAL"].steps_per_epoch == 3 and r["TOTAL"].tasks == 4


def test_t19_overlay_counts(spark):
    cur = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "key string, v double")
    ov = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("z", 9.0)], "key string, v double")
    n = {r.key: (r.v, r.replaced) for r in N.stats_overlay(cur, ov, ["key"], ["v"]).collect()}
    assert n == {"a": (1.0, True), "b": (5.0, True), "c": (3.0, False)}
    t = {r.key: r.replaced for r in N.stats_overlay(cur, ov, ["key"], ["v"], only_changed=True).collect()}
    assert t == {"a": False, "b": True, "c": False}


def test_t20_split_has_exact_counts_and_no_leak(spark):
    ents = spark.createDataFrame([("n", e, s, n) for s in range(4) for e, n in (("full", 25), ("half", 12))], "norm_domain string, entry string, source_id long, n_selected long")
    pools = spark.createDataFrame([(s, 25) for s in range(4)], "source_id long, n_pool long")
    d = SP.split_by_source(ents, pools, 0.13, 5)
    full = [r for r in d.collect() if r.entry == "full"]
    assert len(full) == 100 and sum(r.split == "val" for r in full) == 13 and SP.split_leaks(d).count() == 0
    pos = SP.entry_prefixes(ents, pools).withColumn("ratio", F.when(F.col("entry") == "full", 1.0).otherwise(0.5)).withColumn("config_index", F.lit(0))
    owner = SP.split_by_positions(pos, 10, 5).where("split = 'val'").collect()
    assert len(owner) == 10 and {r.entry for r in owner} == {"full"} and SP.split_leaks(SP.split_by_positions(pos, 10, 5)).count() == 0
    with pytest.raises(Exception, match="more episodes"):
        SP.entry_prefixes(ents.withColumn("n_selected", F.lit(26)), pools).collect()


def test_prefix_ratio_is_checked(spark):
    with pytest.raises(ValueError):
        E.take_trajectory_prefix(spark.range(1), 1.5)


def test_baseline_denoise_edges(spark):
    v = [1.0, 1.0, 4.0, 7.0, 0.0]
    got = [r.value for r in S.baseline_denoise(seq(spark, v), n=2, threshold=0.2).orderBy("frame_idx").collect()]
    x = np.array([0, 0, 3, 6, 0.0])
    p = np.pad(x, 1, mode="edge")
    assert np.allclose(got, [p[i:i + 3].mean() for i in range(5)])


def test_contact_threshold_matches_numpy(spark):
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.random(50), [0.0, -1.0]])
    d = spark.createDataFrame([("s", float(x)) for x in s] + [("dead", 0.0)], "stream string, score double")
    r = {x.stream: x for x in S.contact_thresholds(d).collect()}
    p = s[s > 0]
    noise = p[p <= np.median(p)]
    t = np.median(noise) + 3 * 1.4826 * np.median(np.abs(noise - np.median(noise)))
    assert r["s"].threshold == pytest.approx(t) and r["s"].exceed_count == (p > t).sum() and r["dead"].status == "no_positive_scores"
    with pytest.raises(Exception, match="no contact threshold"):
        S.contact_flag(d.withColumn("f", F.lit(1)), S.contact_thresholds(d), ["f"]).collect()


def test_running_stats_needs_two(spark):
    d = spark.createDataFrame([("a", 1.0)], "key string, value double")
    with pytest.raises(Exception, match="at least two"):
        N.running_stats(d, ["key"]).collect()


def test_transform_groups_and_renames(spark):
    assert R.with_steps([(1,)], [(4,)], [(2,)], [(3,)]) == ([(1,), (2,)], [(3,), (4,)])
    d = one(spark, v=arr(1, 2))
    assert R.run_steps(d, [("scale", "v", 2.0), ("shift", "v", 1.0), ("pad", "v", 3)]).first().v == [3.0, 5.0, 0.0]
    with pytest.raises(ValueError):
        R.rename_paths(["a", "b"], {"a|b": "c"})
    with pytest.raises(ValueError):
        R.rename_paths(["a", "b/c"], {"a": "b"})
    for names in (["a", "a-b", "a/c"], ["a/c", "a-b", "a"], ["a/b", "a/b/c/d"]):
        with pytest.raises(ValueError, match="field and a struct"):
            R.rename_paths(names, {})
    assert R.rename_paths(["x/y", "z"], {"x/(.*)": r"w/\1", "z": None}) == {"w/y": "x/y"}
    got = one(spark, v=P.delta_actions(F.array(arr(9, 9, 9, 9, 9, 9)), arr(1, 2, 3, 4, 5), (2, -2, 0, 1))).first().v
    assert got == [[8.0, 7.0, 9.0, 9.0, 4.0, 9.0]]


def test_errors_in_records(spark):
    with pytest.raises(Exception, match="arm joints"):
        one(spark, v=P.side_vector(arr(*[0] * 9), arr(*[1] * 8), arr(1), F.array(F.lit(0)))).collect()
    with pytest.raises(Exception, match="unknown task"):
        R.task_prompt(spark.range(2).withColumnRenamed("id", "task_index"), spark.range(1).select(F.col("id").alias("task_index"), F.lit("t").alias("task"))).collect()
    with pytest.raises(Exception, match="no camera"):
        P.coalesce_camera(one(spark, camera_ego_rgb=F.lit(None).cast("string"))).collect()
    with pytest.raises(Exception, match="instruction"):
        one(spark, t=J.instruction_from_name(F.lit("no marks"))).collect()
    with pytest.raises(Exception, match="instruction"):
        one(spark, t=J.instruction_from_name(F.lit("a+b+c+d"))).collect()


def test_text_pools(spark):
    d = spark.createDataFrame([('{"fold_dataset": ["the dataset", " fold it "], "x": ["x"]}',)], "doc string")
    got = sorted((r.task, r.text) for r in J.instruction_pool_clean(J.parse_pools(d)).collect())
    assert got == [("fold_dataset", "fold it"), ("x", "x")]
    assert one(spark, t=J.parse_numbered_lines(F.lit("[1] pick up\n\n [2]  put down \n"))).first().t == ["pick up", "put down"]


def test_catalog_roundtrip(spark, tmp_path):
    src = tmp_path / "in.json"
    src.write_text('{"default_use_trajectory_ratio": 0.4, "datasets": [{"path": "/d/one/"}, {"name": "two", "path": "/d/two", "enabled": false}, {"name": "three", "path": "/d/3", "use_trajectory_ratio": 0.9, "norm_stats_domain_name": "n"}]}')
    c = C.read_catalog(spark, str(src))
    want = [("one", 0.4, "one"), ("three", 0.9, "n")]
    assert [(r.name, r.use_trajectory_ratio, r.norm_domain) for r in c.orderBy("config_index").collect()] == want
    C.write_catalog(c, str(tmp_path / "out"))
    again = C.read_catalog(spark, str(tmp_path / "out"))
    assert [(r.name, r.use_trajectory_ratio, r.norm_domain) for r in again.orderBy("config_index").collect()] == want


def test_a_cluster_needs_a_shared_folder():
    from episodica.session import require_local

    for master in ("local", "local[*]", "local[4]", "local[2,3]"):
        require_local(master)
    for master in ("yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            require_local(master)


def test_json_strings(spark):
    import json

    from episodica.operators.split import json_string

    texts = ['plain', 'a"b\\c', "tab\tnl\nbs\bff\fcr\r\x01\x7f", "é漢😀", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string(F.col("t")).alias("j"))
    for r in d.collect():
        assert r.j == json.dumps(r.t), r.t


def test_a_domain_without_statistics_is_an_error(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0])], "domain string, v array<double>")
    s = N.norm_fit_scoped(d, "v", "all", "zscore", 2)
    other = spark.createDataFrame([("b", [100.0, 1.0])], "domain string, v array<double>")
    assert N.norm_apply(d, "v", s, "zscore", 2).count() == 2
    with pytest.raises(Exception, match="no statistics for b"):
        N.norm_apply(other, "v", s, "zscore", 2).collect()


def test_statistics_per_step_need_enough_steps(spark):
    d = spark.createDataFrame([("a", [[1.0], [2.0]]), ("a", [[3.0], [5.0]])], "domain string, v array<array<double>>")
    s = N.norm_fit_scoped(d, "v", "all", "zscore", 1, per_time=True)
    assert {(r.t, r.lo) for r in s.collect()} == {(0, 2.0), (1, 3.5)}
    back = N.norm_invert(N.norm_apply(d, "v", s, "zscore", 1), "v", s, "zscore", 1)
    assert sorted(r.v for r in back.collect()) == [[[1.0], [2.0]], [[3.0], [5.0]]]
    longer = spark.createDataFrame([("a", [[1.0], [2.0], [3.0]])], "domain string, v array<array<double>>")
    with pytest.raises(Exception, match="more steps"):
        N.norm_apply(longer, "v", s, "zscore", 1).collect()
