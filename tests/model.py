"""A sequential store, written from its rules, to compare plans with."""

from __future__ import annotations


class Store:
    """Puts, deletes and flushes one after another; reads in both modes."""

    def __init__(self, max_bytes: int | None = None):
        self.memory: dict = {}  # key -> value, None: tombstone
        self.size, self.runs, self.max_bytes = 0, [], max_bytes
        self.history: dict = {}

    def put(self, key: str, value: str) -> None:
        if key not in self.memory:
            self.size += len(key.encode()) + len(value.encode())
        self.memory[key] = self.history[key] = value
        self._check()

    def delete(self, key: str) -> bool:
        self.size += 1
        existed = key in self.memory
        if existed:
            self.size -= len((self.memory[key] or "").encode())
            self.memory[key] = None
        self.history[key] = None
        self._check()
        return existed

    def _check(self) -> None:
        if self.max_bytes is not None and self.size >= self.max_bytes:
            self.flush()

    def flush(self) -> None:
        self.runs.append(self.memory)
        self.memory, self.size = {}, 0

    def get(self, key: str, mode: str):
        if mode == "intended":
            return self.history.get(key)
        for held in [self.memory, *self.runs]:
            if held.get(key) is not None:
                return held[key]
        return None
