import sys

from panelspark.llm.common import lean, worker_state


def test_a_task_frees_what_other_operators_left(monkeypatch):
    monkeypatch.delitem(sys.modules, "_panelspark_worker_state", raising=False)
    own, other = worker_state("own", lambda: [1]), worker_state("other", lambda: [2])
    assert list(lean(lambda batches: batches, "own")([3])) == [3]
    assert worker_state("own", lambda: None) is own and worker_state("other", lambda: None) is not other
    list(lean(lambda batches: batches)([]))
    assert worker_state("own", lambda: [4]) == [4]
    monkeypatch.delitem(sys.modules, "_panelspark_worker_state", raising=False)
