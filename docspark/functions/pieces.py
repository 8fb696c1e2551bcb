"""Rows that Python functions make of texts and files, handed on in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Rows and characters of a piece; a longer row is a piece of its own.
ROWS, CHARACTERS = 2000, 1 << 20


def pieces(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows as frames, each handed on as soon as it is full: a batch's rows are never all there at once."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= ROWS or size >= CHARACTERS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)
