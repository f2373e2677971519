"""External suffix sorting by induction.

The order of the leftmost S-type (LMS) suffixes induces the order of all others. A pass over the
characters upwards pops the L-type suffixes of a character from a priority queue, in their order,
and pushes their predecessors; a pass downwards does the same for S-type ones. What the queues hold
are suffix tuples: position, the characters before it (so that the text isn't read at random) and
the common prefix with the tuple before, which the pass carries on to the next one. Queues spill
to an unnamed file of the task, are read back in blocks, and text and results lie in such files
too. The LMS suffixes themselves are ordered by the same induction, naming of their substrings by
comparison, and recursion on the string of names.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: A suffix tuple: position, up to eight characters before it (the nearest in the low byte), how
#: many those are, and the common prefix with the tuple before it, up to a limit.
TUPLE = np.dtype([("pos", "<i8"), ("before", "<u8"), ("known", "<u2"), ("lcp", "<u2")])


class Queues:
    """First-in first-out queues by key, with a common memory budget.

    Pushes to one key come in the order of their suffixes, so the keys and the order of arrival
    together are the priority.
    """

    def __init__(self, budget: int, dtype=TUPLE):
        self.budget, self.dtype, self.held, self.file, self.at, self.spilled = budget, np.dtype(dtype), 0, None, 0, 0
        self.parts: dict[int, list[np.ndarray | tuple[int, int]]] = {}

    def push(self, keys: np.ndarray, items: np.ndarray) -> None:
        """Append each item to its key's queue, keeping the order of arrival."""
        if not len(items):
            return
        order = np.argsort(keys, kind="stable")
        keys, items = keys[order], items[order]
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            self.append(int(keys[a]), items[a:b])

    def append(self, key: int, items: np.ndarray) -> None:
        self.parts.setdefault(key, []).append(items)
        self.held += items.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.at)
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    self.file.write(part.tobytes())
                    parts[i] = (self.at, len(part))
                    self.at += part.nbytes
        self.spilled += self.held
        self.held = 0

    def blocks(self, key: int, block: int, reverse: bool = False) -> Iterator[np.ndarray]:
        """A queue's items so far, in order of arrival or against it, at most ``block`` at once; the queue is emptied."""
        parts = self.parts.pop(key, [])
        size, held, n_held = self.dtype.itemsize, [], 0

        def together() -> np.ndarray:
            whole = held[0] if len(held) == 1 else np.concatenate(held[::-1] if reverse else held)
            held.clear()
            return whole[::-1] if reverse else whole

        for part in reversed(parts) if reverse else parts:
            if isinstance(part, np.ndarray):
                self.held -= part.nbytes
                held.append(part)
                n_held += len(part)
                if n_held >= block:
                    n_held = 0
                    yield together()
                continue
            if held:
                n_held = 0
                yield together()
            offset, n = part
            firsts = range(0, n, block)
            for first in reversed(firsts) if reverse else firsts:
                self.file.seek(offset + first * size)
                got = np.frombuffer(self.file.read(min(block, n - first) * size), dtype=self.dtype)
                yield got[::-1] if reverse else got
        if held:
            yield together()

    def pop(self, key: int) -> np.ndarray:
        found = list(self.blocks(key, 1 << 40))
        return np.concatenate(found) if found else np.empty(0, dtype=self.dtype)


class Carried:
    """Common prefixes from scanned suffixes to the tuples that they induce.

    Of two predecessors pushed to one queue in turn, the common prefix is one more than the least
    among those of the suffixes scanned from the first to the second.
    """

    def __init__(self, keys: int, limit: int):
        self.since, self.limit = np.zeros(keys, dtype=np.uint16), limit
        self.any = np.zeros(keys, dtype=bool)  # queues with a push before

    def over(self, lcp: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``lcp``: of each scanned suffix and the one before. ``keys``, ``at``: the queue and the place
        in the scan of each push. The common prefix of each push and the last one to its queue."""
        out = np.zeros(len(at), dtype=np.uint16)
        if self.limit == 0:
            return out
        rest = np.minimum(self.since, lcp.min()) if len(lcp) else self.since
        if len(at):
            order = np.argsort(keys, kind="stable")
            k, j = keys[order], at[order]
            first = np.append(True, k[1:] != k[:-1])
            start = np.where(first, 0, np.append(0, j[:-1] + 1))
            padded = np.append(lcp, np.uint16(0))
            least = np.minimum.reduceat(padded, np.stack([start, j + 1], axis=1).ravel())[::2]
            least[first] = np.minimum(least[first], self.since[k[first]])
            shared = np.minimum(least.astype(np.int64) + 1, self.limit)
            out[order] = np.where(first & ~self.any[k], 0, shared)
            self.any[k] = True
            last = np.append(first[1:], True)
            tail = np.minimum.accumulate(np.append(lcp, np.uint16(self.limit))[::-1])[::-1]
            rest[k[last]] = tail[j[last] + 1]
        self.since = rest
        return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class ByteText:
    """Suffix order of bytes. Characters are 1 to 256; 0 is the end, which is less than all."""

    def __init__(self, data: np.ndarray, budget: int, limit: int, block: int = 1 << 20):
        self.data, self.n, self.budget, self.limit, self.block = data, len(data), budget, limit, block

    def char(self, pos: np.ndarray) -> np.ndarray:
        return np.where(pos < self.n, self.data[np.minimum(pos, self.n - 1)].astype(np.int64) + 1, 0)

    def fetch(self, tuples: np.ndarray) -> np.ndarray:
        """The tuples with the characters before them, read from the text where they have none left."""
        bare = np.flatnonzero((tuples["known"] == 0) & (tuples["pos"] > 0))
        if len(bare):
            if not tuples.flags.writeable or tuples.base is not None:
                tuples = tuples.copy()
            pos = tuples["pos"][bare]
            near = self.data[np.maximum(pos[:, None] - np.arange(1, 9), 0)]
            tuples["before"][bare] = np.ascontiguousarray(near).view("<u8").ravel()
            tuples["known"][bare] = np.minimum(pos, 8)
        return tuples

    def tuples(self, pos: np.ndarray, lcp: np.ndarray | int = 0) -> np.ndarray:
        out = np.zeros(len(pos), dtype=TUPLE)
        out["pos"], out["lcp"] = pos, lcp
        return out

    def common(self, p: int, q: int) -> int:
        """Common prefix of two suffixes, up to the limit."""
        a, b = self.data[p : p + self.limit], self.data[q : q + self.limit]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def neighbours(self, pos: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at ``pos`` with the one before each, 16 characters at a time."""
        out, at = np.zeros(len(pos), dtype=np.uint16), np.arange(1, len(pos))
        late = np.maximum(pos[1:], pos[:-1]) + self.limit + 16 > self.n
        for i in (np.flatnonzero(late) + 1).tolist():  # near the end: one by one
            out[i] = self.common(int(pos[i - 1]), int(pos[i]))
        at = at[~late]
        for depth in range(0, self.limit, 16):
            if not len(at):
                break
            rows = np.lib.stride_tricks.sliding_window_view(self.data, 16)
            same = rows[pos[at] + depth] == rows[pos[at - 1] + depth]
            all_ = same.all(1)
            short = ~all_
            out[at[short]] += same[short].argmin(1).astype(np.uint16)
            at = at[all_]
            out[at] += np.uint16(16)
        return np.minimum(out, self.limit).astype(np.uint16)

    def lms(self) -> np.ndarray:
        """Positions of LMS suffixes in text order, the end included, found from the end in blocks."""
        found, after, is_s = [np.array([self.n])], 0, True  # character and type at the block's right
        for first in reversed(range(0, self.n, self.block)):
            chars = np.append(self.data[first : first + self.block].astype(np.int64) + 1, after)
            step = np.sign(np.diff(chars))
            nxt = np.minimum.accumulate(np.where(step != 0, np.arange(len(step)), len(step))[::-1])[::-1]
            s = np.append(np.append(step, 1 if is_s else -1)[nxt] > 0, is_s)
            found.append(first + 1 + np.flatnonzero(s[1:-1] & ~s[:-2]) if len(s) > 2 else np.empty(0, dtype=np.int64))
            if first + len(step) < self.n and is_s and not s[-2]:
                found.append(np.array([first + len(step)]))
            after, is_s = int(chars[0]), bool(s[0])
        return _distinct(np.concatenate(found))

    def induce(self, seeds: Iterator[np.ndarray], sink: Callable[[np.ndarray, bool], None], limit: int) -> None:
        """All suffixes in falling order to ``sink(tuples, is_s)``, from the LMS tuples in ``seeds``.

        A tuple's ``lcp`` there is the common prefix with the suffix given out before it, up to ``limit``.
        """
        sources, larger, lower = Queues(self.budget // 3), Queues(self.budget // 3), Queues(self.budget // 3)
        for part in seeds:
            sources.push(self.char(part["pos"]), part)
        carried = Carried(257, limit)

        def scan(tuples: np.ndarray, char: int, least: int, most: int, target: Queues) -> None:
            """Push the predecessors whose character lies in [least, most]."""
            tuples = self.fetch(tuples)
            before = (tuples["before"] & np.uint64(0xFF)).astype(np.int64) + 1
            at = np.flatnonzero((tuples["pos"] > 0) & (before >= least) & (before <= most))
            keys, out = before[at], tuples[at]
            out["pos"] -= 1
            out["before"] >>= np.uint64(8)
            out["known"] -= 1
            out["lcp"] = carried.over(np.ascontiguousarray(tuples["lcp"]), keys, at)
            target.push(keys, out)

        for c in range(257):
            last = -1
            while c in larger.parts:
                for part in larger.blocks(c, self.block):
                    lower.append(c, part)
                    last = int(part["pos"][-1])
                    scan(part, c, c, 256, larger)
            for part in sources.blocks(c, self.block):
                if last >= 0 and limit:
                    part = part.copy()
                    part["lcp"][0] = self.common(last, int(part["pos"][0]))
                    last = -1
                scan(part, c, c + 1, 256, larger)

        smaller, carried = Queues(self.budget // 3), Carried(257, limit)
        for c in range(256, 0, -1):
            last = -1
            while c in smaller.parts:
                for part in smaller.blocks(c, self.block):
                    sink(part, True)
                    last = int(part["pos"][-1])
                    scan(part, c, 1, c, smaller)
            shared = None
            for part in lower.blocks(c, self.block, reverse=True):
                part = part.copy()
                if shared is None:
                    shared = self.common(last, int(part["pos"][0])) if last >= 0 else 0
                own = part["lcp"].copy()
                # each had the common prefix with the lesser one, which now comes after it
                part["lcp"][1:], part["lcp"][0], shared = own[:-1], shared, int(own[-1])
                sink(part, False)
                scan(part, c, 1, c - 1, smaller)

    def named(self, lms: np.ndarray) -> np.ndarray:
        """Rank of each LMS substring (up to the next LMS position, included), in text order."""
        order: list[np.ndarray] = []

        def lms_only(part: np.ndarray, is_s: bool) -> None:
            if is_s:
                part = self.fetch(part)
                before = (part["before"] & np.uint64(0xFF)).astype(np.int64) + 1
                order.append(part["pos"][(part["pos"] > 0) & (before > self.char(part["pos"]))])

        self.induce((self.tuples(lms[a : a + self.block]) for a in range(0, len(lms), self.block)), lms_only, 0)
        ranked = np.append(np.concatenate(order or [np.empty(0, dtype=np.int64)]), self.n)[::-1]
        return name_runs(lambda i: self.char(i), np.append(lms, self.n), ranked, self.block)


def name_runs(char: Callable, ends: np.ndarray, ranked: np.ndarray, block: int) -> np.ndarray:
    """Names of the LMS substrings in text order. ``ends``: LMS positions and the end once more;
    ``ranked``: LMS positions in the order of their substrings. Neighbours are compared by their characters."""
    lms = ends[:-1]
    place = np.searchsorted(lms, ranked)
    size = ends[1:][place] - ranked + 1
    new = np.ones(len(ranked), dtype=bool)
    maybe = np.flatnonzero(size[1:] == size[:-1]) + 1
    total = np.cumsum(size[maybe])
    at = 0
    while at < len(maybe):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + block)))
        rows = maybe[at:upto]
        lengths = size[rows]
        offset = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        same = char(np.repeat(ranked[rows], lengths) + offset) == char(np.repeat(ranked[rows - 1], lengths) + offset)
        new[rows] = ~np.logical_and.reduceat(same, np.cumsum(lengths) - lengths)
        at = upto
    names = np.empty(len(lms), dtype=np.int64)
    names[place] = np.cumsum(new) - 1
    return names


def s_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end, one place further, is S-type."""
    step = np.sign(np.diff(np.append(text, -1)))
    n = len(step)
    nxt = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    return np.append(np.append(step, 1)[nxt] > 0, True)


def order_names(names: np.ndarray, budget: int, queues: int | None = None) -> np.ndarray:
    """Suffix array of a string of names, by the same induction and recursion.

    Names are too many for a queue each: a queue has a range of names, and a popped range is ordered
    by name. Predecessors that fall into the range that is being popped take their turn by a heap;
    the number of queues balances theirs against the heaps' work.
    """
    n = len(names)
    keys = queues or 1 + int((n / 50) ** 0.5)
    if n < 2:
        return np.arange(n)
    is_s = s_types(names)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    lms = lms[lms < n]
    if len(lms) > 1:
        first = _induce_names(names, is_s, lms, budget, keys)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        padded = np.append(names, -1)
        reduced = name_runs(lambda i: padded[np.minimum(i, n)], np.append(lms, n), first[is_lms[first]], 1 << 22)
        if int(reduced.max()) + 1 < len(lms):
            lms = lms[order_names(reduced, budget, queues)]
        else:
            lms = lms[np.argsort(reduced)]
    return _induce_names(names, is_s, lms, budget, keys)


def _induce_names(names: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, budget: int, keys: int) -> np.ndarray:
    """The suffix array that LMS suffixes in the order of ``seeds`` induce."""
    n, width = len(names), int(names.max()) + 1
    keys = min(keys, width)
    key_of = lambda x: x * keys // width
    larger, sources = Queues(budget // 2, "<i8"), Queues(budget // 2, "<i8")
    sources.push(key_of(names[seeds]), seeds)
    larger.append(int(key_of(names[n - 1])), np.array([n - 1]))  # the end induces the last suffix

    def in_range(key: int, items: np.ndarray, rank: np.ndarray, wanted: Callable, sign: int) -> np.ndarray:
        """Predecessors within the range, in the order in which they are reached.

        ``rank``: 0 for items of the queue, 2 for those that come after all of their name.
        """
        pred = items - 1
        good = np.flatnonzero((pred >= 0) & wanted(items) & (key_of(names[pred]) == key))
        heap = [(sign * int(names[items[i]]), int(rank[i]), int(i), int(items[i])) for i in good]
        heapq.heapify(heap)
        out, turn = [], 0
        while heap:
            _, r, _, item = heapq.heappop(heap)
            if r == 1:
                out.append(item)
            p = item - 1
            if p >= 0 and is_s.item(p) == (sign < 0):
                name = names.item(p)
                if name * keys // width == key:
                    heapq.heappush(heap, (sign * name, 1, turn, p))
                    turn += 1
        return np.array(out, dtype=np.int64)

    to_l = lambda x: ~is_s[x - 1]
    to_s = lambda x: is_s[x - 1]
    lows: list[np.ndarray] = []
    for key in range(keys):
        items, own = larger.pop(key), sources.pop(key)
        items = items[np.argsort(names[items], kind="stable")]
        both = np.concatenate([items, own])
        rank = np.repeat([0, 2], [len(items), len(own)])
        items = np.concatenate([items, in_range(key, both, rank, to_l, 1)])
        items = items[np.argsort(names[items], kind="stable")]
        lows.append(items)
        both = np.concatenate([items, own])
        both = both[np.argsort(names[both], kind="stable")]
        pred = both[both > 0] - 1
        pred = pred[~is_s[pred]]
        where = key_of(names[pred])
        larger.push(where[where > key], pred[where > key])

    smaller, out = Queues(budget // 2, "<i8"), []
    for key in reversed(range(keys)):
        items, own = smaller.pop(key), lows[key][::-1]
        items = items[np.argsort(-names[items], kind="stable")]
        both = np.concatenate([items, own])
        rank = np.repeat([0, 2], [len(items), len(own)])
        items = np.concatenate([items, in_range(key, both, rank, to_s, -1)])
        items = items[np.argsort(-names[items], kind="stable")]
        both = np.concatenate([items, own])
        both = both[np.argsort(-names[both], kind="stable")]
        out.append(both)
        pred = both[both > 0] - 1
        pred = pred[is_s[pred]]
        where = key_of(names[pred])
        smaller.push(where[where < key], pred[where < key])
    return np.concatenate(out)[::-1]


def sorted_lms(text: ByteText) -> np.ndarray:
    """LMS positions in the order of their suffixes, the end first."""
    lms = text.lms()
    if len(lms) < 2:
        return lms
    names = text.named(lms)
    if int(names.max()) + 1 < len(names):
        return lms[order_names(names, text.budget)]
    return lms[np.argsort(names)]


def fall(data: np.ndarray, sink: Callable[[np.ndarray], None], limit: int, budget: int = 256 << 20, block: int = 1 << 20) -> None:
    """All suffixes of ``data`` (bytes; a file mapped to memory will do) in falling order, as tuples with
    the common prefix of each and the one before it, up to ``limit``."""
    if not len(data):
        return
    text = ByteText(data, budget, limit, block)
    order = sorted_lms(text)

    def seeds() -> Iterator[np.ndarray]:
        for a in range(0, len(order), block):
            pos = order[max(a - 1, 0) : a + block]
            yield text.tuples(pos, text.neighbours(pos))[(1 if a else 0) :]

    text.induce(seeds(), lambda part, _: sink(part), limit)


def suffix_array(data: np.ndarray, budget: int = 256 << 20, block: int = 1 << 20) -> np.ndarray:
    """Order of all suffixes of ``data``."""
    found: list[np.ndarray] = []
    fall(data, lambda part: found.append(part["pos"].copy()), 1, budget, block)
    return np.concatenate(found)[::-1] if found else np.empty(0, dtype=np.int64)


def repeated_starts(data: np.ndarray, wanted: np.ndarray, length: int, budget: int = 256 << 20, block: int = 1 << 20) -> np.ndarray:
    """Positions marked in ``wanted`` whose ``length`` characters also begin at another such position."""
    found: list[np.ndarray] = []
    state = {"last": -1, "least": 0}

    def sink(part: np.ndarray) -> None:
        at = np.flatnonzero(wanted[part["pos"]])
        lcp = np.ascontiguousarray(part["lcp"])
        if not len(at):
            state["least"] = min(state["least"], int(lcp.min()))
            return
        # least common prefix from each marked suffix to the one before it
        shared = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1)).astype(np.int64)
        shared[0] = min(shared[0], state["least"])
        pos = part["pos"][at]
        again = shared >= length
        found.append(pos[again])
        found.append(np.append(state["last"], pos[:-1])[again])
        state["last"] = int(pos[-1])
        state["least"] = int(lcp[at[-1] + 1 :].min(initial=length))

    fall(data, sink, length, budget, block)
    out = _distinct(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    return out[out >= 0]
