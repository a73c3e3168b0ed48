"""Operators over null keys.

The smallest key of a table becomes null before the operator and gets its name back
behind it, so the SQL of the plain query says what has to come out: nothing is lost
and nothing changes.
"""

from episodica.queries.common import with_null_keys
from episodica.registry import ORACLES, QUERIES, query

EPISODE = ("domain", "file_id", "episode_id")

#: plain query -> the keys that are hidden in it
HIDDEN = {
    "a5_drop_last_episode": EPISODE, "a5_pop_episode": EPISODE, "b1_episode_index": EPISODE, "b3_take_trajectory_prefix": EPISODE,
    "b4_slice_episodes": EPISODE, "b5_trim_idle": ("episode_id",), "b6_chunk_overlap": ("episode_id",), "b8_global_index": EPISODE,
    "b9_keep_ranges": ("episode_id",), "d3_attach_camera": ("episode_id",), "d8_interp_linear": ("episode_id",),
    "d10_interp_floor": ("episode_id",), "f1_baseline_denoise": ("episode_id", "stream"), "f6_contact_thresholds": ("stream",),
    "f7_contact_flag": ("stream",), "f12_blank_frames": ("episode_id",), "h2_norm_fit_scoped": ("domain",), "h3_norm_fit_streams": ("domain",),
    "h5_running_stats": ("domain",), "h6_norm_apply_quantile": ("domain",), "h7_norm_invert_quantile": ("domain",),
    "i1_error_metrics_trimmed": ("domain",), "i3_pose_errors_trimmed": ("domain",),
}

for name, keys in HIDDEN.items():
    query(f"{name}_null_keys", ORACLES[name])(with_null_keys(QUERIES[name], *keys))
