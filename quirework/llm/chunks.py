"""Features of whole texts from counts over their space-separated chunks.

A worker works out the properties of a distinct chunk once and keeps them as a row of an array; a
text's features are then sums over the rows of its chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Distinct chunks whose properties a worker keeps; beyond that it starts anew.
CHUNKS_KEPT = 200_000


class Properties:
    def __init__(self, width: int, of: Callable[[str], tuple[float, ...]], kept: int = CHUNKS_KEPT):
        self.width, self.of, self.kept = width, of, kept
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def __call__(self, chunks: list[str]) -> np.ndarray:
        """A row for each chunk."""
        index = self.index
        if len(index) > self.kept:
            self.clear()
            index = self.index
        places = list(map(index.get, chunks))
        if None in places:
            for k, place in enumerate(places):
                if place is None:
                    chunk = chunks[k]
                    if (place := index.get(chunk)) is None:
                        place = index[chunk] = len(index)
                        if place == len(self.rows):
                            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                        self.rows[place] = self.of(chunk)
                    places[k] = place
        return self.rows[places]
