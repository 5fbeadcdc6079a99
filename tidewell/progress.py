"""A bar that shows how many rows a transfer has written."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any


@contextmanager
def progress_bar(total: int | None = None, **options: Any) -> Iterator[Any]:
    """Give what this yields to sync(on_progress=...). The bar is closed even if the transfer fails."""
    try:
        from tqdm import tqdm
    except ImportError:
        raise ImportError("progress_bar needs the package tqdm") from None
    bar = tqdm(total=total, unit="rows", **options)
    shown = 0

    def show(p: Any) -> None:
        nonlocal shown
        bar.update(p.rows_written - shown)
        shown = p.rows_written

    try:
        yield show
    finally:
        bar.close()
