"""Registered queries against their SQL twins in DuckDB.

One query per group by default; EPISODICA_ALL=1 runs every one.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools_check import compare

SAMPLE = [
    "a8_task_settings_filter", "b1_episode_index", "b9_keep_ranges", "c4_split_by_positions", "c11_domain_batches", "d3_attach_camera",
    "d5_action_accumulator_stream", "d9_interp_pose", "e5_rig_calibrate", "f7_contact_flag", "g3_joints_mix", "h6_norm_apply_quantile",
    "i3_pose_errors_trimmed", "j3_draw_instruction",
]


@pytest.mark.parametrize("name", [n for n in sorted(queries()) if n in oracle_sql()] if os.environ.get("EPISODICA_ALL") else SAMPLE)
def test_query_equals_sql(spark, sf, name):
    ok, msg, _ = compare(spark, name, queries()[name], oracle_sql().get(name), sf)
    assert ok, msg


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    own = [n for n, f in queries().items() if f.__module__.startswith("episodica.queries")]
    assert own and [n for n in own if n not in oracle_sql()] == []
