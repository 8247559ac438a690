"""A bounded memory of what a Python worker has computed, in two generations."""

from __future__ import annotations


class Memory:
    """now: what was asked for lately. When it has more than limit entries it becomes the old generation, from which
    entries come back when asked for; what nobody asked for since goes with the generation before."""

    def __init__(self, limit: int):
        self.limit, self.now, self._old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that must be computed and put into now; all others are there afterwards."""
        if len(self.now) > self.limit:
            self.now, self._old = {}, self.now
        absent, old = keys.difference(self.now), self._old
        found = [k for k in absent if k in old]
        self.now.update((k, old[k]) for k in found)
        return absent.difference(found)
