"""A worker gives freed memory back after a task, also when the task fails, and its batches come through as they are."""

import pytest

from folioscan.llm import common


def test_lean_passes_batches_and_releases_once(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]
    assert calls == [1]

    def broken(batches):
        yield next(batches)
        raise ValueError("broken")

    with pytest.raises(ValueError):
        list(common.lean(broken)(iter([1])))
    assert calls == [1, 1]


def test_release_runs():
    assert common.release() is None
