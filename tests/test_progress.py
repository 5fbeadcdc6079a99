import sys
import types

import pytest

from tidewell.progress import progress_bar
from tidewell.sync import Progress


class Bar:
    made: list = []

    def __init__(self, **options):
        self.options, self.n, self.closed = options, 0, False
        Bar.made.append(self)

    def update(self, n):
        self.n += n

    def close(self):
        self.closed = True


def test_the_bar_shows_rows_and_is_closed(monkeypatch):
    monkeypatch.setitem(sys.modules, "tqdm", types.SimpleNamespace(tqdm=Bar))
    with progress_bar(100, desc="orders") as show:
        for n in (10, 10, 35):
            show(Progress(n, n, 0, 1.0))
    bar = Bar.made[-1]
    assert bar.n == 35 and bar.closed and bar.options == {"total": 100, "unit": "rows", "desc": "orders"}


def test_the_bar_is_closed_when_a_transfer_fails(monkeypatch):
    monkeypatch.setitem(sys.modules, "tqdm", types.SimpleNamespace(tqdm=Bar))
    with pytest.raises(ValueError), progress_bar():
        raise ValueError
    assert Bar.made[-1].closed


def test_without_the_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "tqdm", None)
    with pytest.raises(ImportError, match="tqdm"), progress_bar():
        pass
