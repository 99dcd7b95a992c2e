"""What a worker remembers of parts of texts (words, runs between spaces).

Text is mostly made of parts met before, so what was found for a part is kept, in two
generations: when the newer one is full it becomes the older one, and a part found in the
older one moves to the newer.  Long parts aren't kept, so a number of parts bounds the bytes.
"""

from __future__ import annotations

from itertools import compress, repeat
from operator import is_

LONGEST = 64   # letters (or bytes) of a part that is kept


class PartCache:
    """``make`` turns a list of new parts into a list of their values (never None); at most
    ``entries`` short parts are kept, and those of the list at hand."""

    def __init__(self, make, entries: int):
        self.make, self.most = make, entries // 2
        self.new: dict = {}
        self.old: dict = {}

    def values(self, parts: list) -> list:
        new = self.new
        got = list(map(new.get, parts))
        at = list(compress(range(len(parts)), map(is_, got, repeat(None))))
        if not at:
            return got
        missing = set(map(parts.__getitem__, at))
        again = missing & self.old.keys()
        if again:
            new.update(zip(again, map(self.old.__getitem__, again)))
            missing -= again
        todo = list(missing)
        if todo:
            new.update(zip(todo, self.make(todo)))
        for i in at:
            got[i] = new[parts[i]]
        for p in [p for p in todo if len(p) > LONGEST]:
            del new[p]
        if len(new) > self.most:
            self.old, self.new = new, {}
        return got


def blocks(sizes: list[int], most: int):
    """Ranges of rows of at most ``most`` bytes together (or one row)."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
