"""Plans that matter at scale: what is shuffled, pushed down, broadcast, and never collected."""

from __future__ import annotations

import re

import pytest

from compare import SMALL
from joblog import queries
from joblog.operators import dispatch, outcomes, quota, state, tasks


@pytest.fixture(scope="module")
def views(spark):
    return queries.Views(spark, SMALL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", text)


def test_latest_is_one_pruned_shuffle(views):
    text = plan(state.latest_tasks(views.task_log))
    assert shuffles(text) == ["hashpartitioning"]
    # Each map task sends at most one row per id.
    assert "row_number(), 1, Partial" in text
    assert "PushedFilters: []" in text


def test_live_filter_stays_above_the_pick(views):
    text = plan(state.latest_tasks(views.task_log))
    assert text.index("isnull(deleted_at") < text.index("WindowGroupLimit")


def test_top_k_does_not_sort_everything(views):
    text = plan(dispatch.dispatch_batch(tasks.live_tasks(views.tasks)))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_scans_read_only_what_is_used(views):
    text = plan(state.active_payload_keys(views.task_log))
    assert "value" not in re.search(r"FileScan parquet \[(.*?)\]", text).group(1)
    text = plan(tasks.get_latest_task(views.executions, "8").select("exec_id"))
    assert "EqualTo(event_type,view)" in text.split("PushedFilters")[1]
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text


def test_registered_types_are_joined_inside_the_plan(views):
    text = plan(outcomes.dispatchable(views.tasks, outcomes.registered_types(views.decoded())))
    # Only the distinct types are shuffled; whether they are broadcast is for Spark to measure.
    assert "Join [task_type" in text and shuffles(text)[:1] == ["hashpartitioning"]


def test_a_tick_lets_free_rows_pass_and_a_backlog_needs_no_checkpoint(views):
    text = plan(quota.pace_backlog(views.due(), "1998-01-01 00:00:00"))
    assert "ExistingRDD" not in text and "rangepartitioning" not in text
    windows = views.spark.createDataFrame([], "rate_limit_group string, count int, window_start timestamp")
    text = plan(quota.admit_due(views.due(), windows, "1998-01-01 00:00:00"))
    assert "Union" in text and "__salt" in text


def test_ordered_windows_are_cut_into_slices(views):
    ordered = {
        "dedupe": (queries.dedupe_in_flight(views), "payload_key"),
        "attempts": (queries.number_attempts(views), "task_id"),
        "results": (queries.match_results(views), "task_id"),
        "timeouts": (queries.timed_out(views), "task_id"),
        "summary": (queries.attempt_summary(views), "task_id"),
        "progress": (queries.assemble_progress(views), "task_id"),
    }
    for name, (df, key) in ordered.items():
        text = plan(df)
        # Whatever is shuffled by the key alone has been aggregated per slice before.
        for part in re.split(r"\n(?=[ :+-]*Exchange hashpartitioning\(" + key + r"#\d+, \d+\))", text)[1:]:
            head = part.split("FileScan")[0]
            assert "Aggregate" in head or "WindowGroupLimit" in head or "orders" in part, name
        assert re.search(rf"hashpartitioning\({key}#\d+, __chunk#\d+L?, \d+\)", text), name


def test_quota_folds_slices_not_groups(views):
    text = plan(quota.admit_quota(views.requests))
    assert "collect_list" not in text and "FlatMapGroups" not in text
    assert len(re.findall(r"hashpartitioning\(rate_limit_group#\d+, __slice#\d+L", text)) >= 2


def test_due_rows_are_struck_out_before_they_meet(views):
    text = plan(quota.admit_due(queries.Views.due(views), queries._saved_windows(views), "1998-01-01 00:00:00"))
    meeting = text[text.index("REPARTITION_BY_COL") :]
    assert "MapInArrow" in meeting.split("FileScan")[0]
    assert "task_data" not in meeting.split("ReadSchema")[0]


def test_null_payload_keys_skip_the_shuffle(views):
    text = plan(queries.dedupe_in_flight(views))
    free = re.split(r"\n   \+- ", text)[-1]
    assert "isnull" in free and "FileScan" in free and "Exchange" not in free


def test_hot_keys_are_counted_bounded_and_broadcast(views):
    text = plan(queries.number_attempts(views))
    assert "TakeOrderedAndProject(limit=50000" in text and "BroadcastHashJoin" in text
    assert "partial_count(1)" in text


@pytest.mark.parametrize("name", ["live_tasks", "due_tasks", "next_retry", "resolve_execute_at", "cron_next", "webhook_outbox"])
def test_row_rules_do_not_shuffle(views, name):
    text = plan(getattr(queries, name)(views))
    # in-flight ids are the one join among these, broadcast here by their size
    assert shuffles(text) == []
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_cross_joins_anywhere(spark):
    for name, query in queries.queries().items():
        if name.startswith("stream_") or name.startswith(("read_", "append", "compact")):
            continue
        text = plan(query(spark, SMALL))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
