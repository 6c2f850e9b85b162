"""Results kept for as long as the data they come from is the same."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame


class VersionedCache:
    """Persisted frames by key and data version, ``most`` of them for ``ttl_s`` seconds each; what falls out is unpersisted."""

    def __init__(self, most: int = 16, ttl_s: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.ttl_s, self._clock = most, ttl_s, clock
        self._kept: OrderedDict[Hashable, tuple[object, float, DataFrame]] = OrderedDict()

    def get(self, key: Hashable, version: object, build: Callable[[], DataFrame]) -> DataFrame:
        """The frame of the key at this version, built if it is missing, of another version or too old."""
        held = self._kept.get(key)
        if held and held[0] == version and self._clock() - held[1] < self.ttl_s:
            self._kept.move_to_end(key)
            return held[2]
        self.drop(key)
        frame = build().persist()
        self._kept[key] = (version, self._clock(), frame)
        while len(self._kept) > self.most:
            self.drop(next(iter(self._kept)))
        return frame

    def drop(self, key: Hashable) -> None:
        if held := self._kept.pop(key, None):
            held[2].unpersist()

    def __len__(self) -> int:
        return len(self._kept)
