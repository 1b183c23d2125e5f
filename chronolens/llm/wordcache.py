"""A bounded cache from fragments of text to their token ids, for use inside tasks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores


class FragmentCache:
    """get_all returns the value of every fragment. Two generations of `limit` entries at most; the older one goes when the newer is full."""

    def __init__(self, compute: Callable[[list], Iterable], limit: int = 400_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.new: dict = {}
        self.old: dict = {}

    def get_all(self, fragments: list) -> list:
        new, old = self.new, self.old
        out = list(map(new.get, fragments))
        places, at = [], -1
        try:
            while True:
                at = out.index(None, at + 1)
                places.append(at)
        except ValueError:
            pass
        if places:
            found = {x: old.get(x) for x in {fragments[i] for i in places}}
            absent = [x for x, v in found.items() if v is None]
            found.update(zip(absent, self.compute(absent), strict=True))
            for i in places:
                out[i] = found[fragments[i]]
            new.update((x, v) for x, v in found.items() if len(x) <= self.longest)
            if len(new) > self.limit:
                self.old, self.new = new, {}
        return out
