"""A table of units (words of texts) and their token ids, found again by Arrow so that numpy can write the ids of whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class UnitTable:
    """learn(units) gives for new units their ids one after another, how many each has, and a flag for each.

    Units stay known until there are more than `cached`; then all are forgotten.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], cached: int):
        self.learn, self.cached = learn, cached
        self._forget()

    def _forget(self) -> None:
        self.units, self.ids, self.begins, self.flags = pa.array([], pa.string()), np.empty(0, "<u4"), np.zeros(1, np.int64), np.empty(0, np.uint8)

    def _look_up(self, units: pa.Array) -> np.ndarray:
        """Where, among the units known then, these distinct units are."""
        if len(self.units) > self.cached:
            self._forget()
        at, n = pc.index_in(units, value_set=self.units), len(self.units)
        missing = at.is_null()
        new = units.filter(missing)
        ids, sizes, flags = self.learn(new.to_pylist())
        self.ids, self.flags = np.concatenate([self.ids, ids]), np.concatenate([self.flags, flags])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
        self.units = pa.concat_arrays([self.units, new])
        out = at.fill_null(0).to_numpy().astype(np.int64)
        out[missing.to_numpy(zero_copy_only=False)] = np.arange(n, len(self.units))
        return out

    def encode(self, units: pa.Array, begins: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of each text, whose units are units[begins[i]:begins[i + 1]], and the bitwise and of their flags."""
        coded = units.dictionary_encode()
        known = self._look_up(coded.dictionary)[coded.indices.to_numpy()]
        first, own = self.begins[known], np.diff(self.begins)[known]
        ends = np.concatenate([[0], np.cumsum(own)])
        data = self.ids[np.repeat(first - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[begins]).tolist()
        flags = np.full(len(begins) - 1, 255, np.uint8)
        full = begins[1:] > begins[:-1]
        if full.any():
            flags[full] = np.bitwise_and.reduceat(self.flags[known], begins[:-1][full])
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], flags
