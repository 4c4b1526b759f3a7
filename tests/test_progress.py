from __future__ import annotations

from joblog import queries
from joblog.operators import outcomes


def test_read_progress_is_one_row_a_task_beyond_a_part(spark, monkeypatch):
    query = queries.queries()["read_progress"]
    want = sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))
    assert max(chunks for _, chunks, _ in want) > 2
    assemble = outcomes.assemble_progress
    # As if every task had more chunks than a part.
    monkeypatch.setattr(outcomes, "assemble_progress", lambda rows, part_chunks: assemble(rows, part_chunks=min(part_chunks, 2)))
    assert sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect())) == want
    assert len({task for task, _, _ in want}) == len(want)
