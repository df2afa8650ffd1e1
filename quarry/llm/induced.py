"""Suffix arrays with common prefixes by external induced sorting.

Suffixes that start a rise after a fall are the seeds. They are sorted by a first induction
from seeds in order of their symbol alone, which names the stretches between them, and, where
names repeat, by recursion on the names. A second induction gives the order of all suffixes.

An induction takes suffixes off a priority queue by symbol and then by order of entry; each
sends the suffix before it into the queue. Queues lie on disk, in blocks of symbols; the block
that is open is put in order at once: suffixes that enter it while it is open form chains,
and doubling along the chains gives their places. A symbol too frequent for a block is
streamed. Every tuple carries its symbol, the symbols before it, and the least common prefix
met since the last tuple that was sent to the same symbol, so that common prefixes come
along without looking at the text again.

Text, names, seeds, order, common prefixes and queues are files of numbers; what is held in
memory is bounded by ``memory`` and doesn't grow with the text.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

#: Numbers that a queue holds in memory before it writes them to disk (8 bytes each).
MEMORY = 1 << 20
#: Numbers of a tuple, and numbers read from a file at once.
_WIDTH, _PAGE = 8, 1 << 15
#: Seeds of the first induction that have their symbol in common count as alike.
ALIKE = 1 << 40
#: A symbol that isn't known yet, and one before the text.
_UNKNOWN, _NONE = -1, -2
_BEFORE = 3
#: Suffixes of a long run that take many steps at once.
_FEW = 16


class Numbers:
    """Rows of numbers in a file; a few are held until they are written."""

    def __init__(self, folder: Path, width: int, memory: int):
        self.path, self.width, self.memory = folder / uuid.uuid4().hex, width, memory
        self.rows = self.written = self.waiting = 0
        self.held: list[np.ndarray] = []
        self.file: int | None = None

    def append(self, rows: np.ndarray) -> None:
        if len(rows):
            self.held.append(np.ascontiguousarray(rows, np.int64).reshape(-1, self.width))
            self.rows += len(self.held[-1])
            self.waiting += len(self.held[-1])
            if self.waiting * self.width > self.memory:
                self.spill()

    def spill(self) -> None:
        if self.waiting:
            with self.path.open("ab") as file:
                for part in self.held:
                    part.tofile(file)
            self.written, self.waiting = self.rows, 0
            self.held = []

    def read(self, a: int, b: int) -> np.ndarray:
        """Rows a to b."""
        a, b = max(a, 0), min(b, self.rows)
        if b <= a:
            return np.zeros((0, self.width), np.int64)
        if self.written and self.waiting:
            self.spill()
        if self.written:
            if self.file is None:
                self.file = os.open(self.path, os.O_RDONLY)
            size, parts = (b - a) * self.width * 8, []
            while size:  # one call may give less than was asked for
                parts.append(os.pread(self.file, size, b * self.width * 8 - size))
                size -= len(parts[-1])
            return np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), np.int64).reshape(-1, self.width)
        if len(self.held) > 1:
            self.held = [np.concatenate(self.held)]
        return self.held[0][a:b]

    def take(self, at: np.ndarray) -> np.ndarray:
        """Rows by number, read page by page in the order of the file."""
        if not len(at) or not self.written:
            return self.read(0, self.rows)[at] if len(at) else np.zeros((0, self.width), np.int64)
        self.spill()
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        out = np.empty((len(at), self.width), np.int64)
        page = sorted_at // _PAGE
        cut = np.flatnonzero(page[1:] != page[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            low = int(sorted_at[a])
            out[order[a:b]] = self.read(low, int(sorted_at[b - 1]) + 1)[sorted_at[a:b] - low]
        return out

    def parts(self, size: int) -> Iterator[np.ndarray]:
        for a in range(0, self.rows, size):
            yield self.read(a, a + size)

    def close(self) -> None:
        self.held, self.rows, self.written, self.waiting = [], 0, 0, 0
        if self.file is not None:
            os.close(self.file)
            self.file = None
        self.path.unlink(missing_ok=True)


class Queue:
    """A priority queue on disk: rows leave by their first number, then in order of entry.

    bounds: the least numbers of its blocks. Rows may enter any block that hasn't been left.
    """

    def __init__(self, bounds: np.ndarray, folder: Path, width: int, memory: int):
        self.bounds, self.memory, self.waiting, self.width = bounds, memory, 0, width
        self.blocks = [Numbers(folder, width, 1 << 62) for _ in bounds]

    def push(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        block = np.searchsorted(self.bounds, rows[:, 0], "right") - 1
        order = np.argsort(block, kind="stable")
        rows, block = rows[order], block[order]
        cut = np.flatnonzero(block[1:] != block[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True):
            self.blocks[block[a]].append(rows[a:b].copy())
        self.waiting += rows.size
        if self.waiting > self.memory:
            self.spill()

    def spill(self) -> None:
        for b in self.blocks:
            b.spill()
        self.waiting = 0

    def open(self, k: int) -> Numbers:
        self.waiting = max(0, self.waiting - self.blocks[k].waiting * self.width)
        return self.blocks[k]

    def close(self) -> None:
        for b in self.blocks:
            b.close()


class _Least:
    """Minima of ranges."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (1 << len(self.levels)) <= len(values):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of the values from low to high, both included."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k) + 1])
        return out


def _bounds(text: Numbers, top: int, most: int) -> np.ndarray:
    """Least symbols of blocks of at most ``most`` suffixes each; a more frequent symbol is alone in its block."""
    lows, width = np.zeros(1, np.int64), top + 1
    done: list[np.ndarray] = []
    while len(lows):
        # Each heavy range is split into up to 4096 or, later, 256 parts, which are counted.
        fine = max(1, -(-width // (4096 if not done else 256)))
        many = -(-width // fine)
        counts = np.zeros((len(lows), many), np.int64)
        for part in text.parts(_PAGE):
            s = part[:, 0]
            owner = np.searchsorted(lows, s, "right") - 1
            sound = owner >= 0
            sound[sound] = s[sound] - lows[owner[sound]] < width
            np.add.at(counts, (owner[sound], (s[sound] - lows[owner[sound]]) // fine), 1)
        starts = (lows[:, None] + np.arange(many) * fine).ravel()
        flat = counts.ravel()
        heavy = (flat > most) & (fine > 1)
        keep = (flat > 0) & ~heavy
        done.append(np.stack([starts[keep], starts[keep] + fine, flat[keep]], axis=1))
        lows, width = starts[heavy], fine
    pieces = np.concatenate(done)
    pieces = pieces[np.argsort(pieces[:, 0])]
    out, held, last_end = [0], 0, 0
    for low, end, count in pieces.tolist():
        if held and held + count > most:
            if low != out[-1]:
                out.append(low)
            held = 0
        held, last_end = held + count, end
        if count > most and end - low == 1:
            out.append(end)
            held = 0
    return np.array([b for b in out if b < max(last_end, 1)], np.int64)


class _Induction:
    """One direction: suffixes from the least symbol on, each giving rise to the one before it where that isn't less.

    turned: symbols count from the greatest one down. emit gets, chunk by chunk in order,
    (rows, seed): rows of symbol, suffix, symbols before, common prefix with the last one, run.
    """

    def __init__(self, text: Numbers, bounds: np.ndarray, top: int, turned: bool, folder: Path, memory: int, emit: Callable):
        self.text, self.top, self.turned, self.folder, self.emit = text, top, turned, folder, emit
        self.bounds = bounds
        if turned:
            ends = np.append(bounds[1:], top + 1) - 1
            self.bounds = (top - ends)[::-1].copy()
        self.memory, self.most = memory, max(4, memory // 32)
        self.queue = Queue(self.bounds, folder, _WIDTH, memory)
        self.low: list[int] = []

    def _fill(self, suffix: np.ndarray, before: np.ndarray) -> None:
        ask = np.flatnonzero(before[:, 0] == _UNKNOWN)
        if not len(ask):
            return
        at = suffix[ask, None] - np.arange(1, _BEFORE + 1)
        found = self.text.take(np.maximum(at, 0).ravel())[:, 0].reshape(at.shape)
        if self.turned:
            found = self.top - found
        before[ask] = np.where(at < 0, _NONE, found)

    def _links(self, rows: np.ndarray, last: np.ndarray | None) -> np.ndarray:
        """Common prefixes of tuples from the queue with the ones before them; ``last`` precedes the first."""
        if last is not None:
            rows = np.concatenate([last[None], rows])
        out = np.zeros(len(rows), np.int64)
        same = np.flatnonzero(rows[1:, 0] == rows[:-1, 0]) + 1
        x, y = rows[same], rows[same - 1]
        value = np.where(x[:, 5] == y[:, 5], x[:, 6], np.minimum(x[:, 6], y[:, 7]))
        far = np.flatnonzero((x[:, 5] > y[:, 5] + 1) & (value > 0))
        if len(far):
            value[far] = np.minimum(value[far], [min(self.low[a + 1 : b]) for a, b in zip(y[far, 5].tolist(), x[far, 5].tolist(), strict=True)])
        out[same] = value + 1
        return out if last is None else out[1:]

    def _children(self, rows: np.ndarray, seed: np.ndarray, at_least: int) -> np.ndarray:
        """Tuples that the rows send on, to symbols from ``at_least`` on: one step of the induction."""
        common = rows[:, 5]
        target = rows[:, 2]
        at = np.flatnonzero((target >= at_least) & (target >= rows[:, 0] + seed))
        step = len(self.low)
        self.low.append(int(common.min()) if len(rows) else ALIKE)
        if not len(at):
            return np.zeros((0, _WIDTH), np.int64)
        pre = np.minimum.accumulate(common)[at]
        post = np.append(np.minimum.accumulate(common[::-1])[::-1], ALIKE)[at + 1]
        order = np.argsort(target[at], kind="stable")
        goes = target[at][order]
        again = np.flatnonzero(goes[1:] == goes[:-1]) + 1
        if len(again):
            pre[order[again]] = _Least(common).of(at[order[again - 1]] + 1, at[order[again]])
        r = rows[at]
        return np.stack([r[:, 2], r[:, 1] - 1, r[:, 3], r[:, 4], np.where(r[:, 4] == _NONE, _NONE, _UNKNOWN), np.full(len(at), step), pre, post], axis=1)

    def _chain(self, row: np.ndarray, run: int, above: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of a block that follow from one of them, and their runs."""
        symbol, at, found, after = int(row[0]), int(row[1]), [], _NONE
        while True:
            before = self.text.read(at - 1024, at)[::-1, 0]
            if self.turned:
                before = self.top - before
            ends = np.flatnonzero((before < np.append(symbol, before[:-1])) | (before >= above))
            n = int(ends[0]) if len(ends) else len(before)
            found.append(before[:n])
            if n < len(before):
                after = int(before[n])
                break
            at -= n
            if not n or not at:
                break
            symbol = int(before[-1])
        symbols = np.concatenate(found)
        n, k = len(symbols), np.arange(len(symbols))
        rows = np.full((n, 5), _UNKNOWN)
        rows[:, 0], rows[:, 1] = symbols, row[1] - 1 - k
        rows[:, 2] = np.append(symbols[1:], after)
        new = symbols != np.append(row[0], symbols[:-1])
        since = np.maximum.accumulate(np.where(new, k, -1))
        return rows, np.where(since >= 0, k - since + 1, run + k + 1)

    def _ordered(self, fresh: np.ndarray, seeds: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of a block in order, as rows, and which are seeds."""
        fresh = fresh[np.argsort(fresh[:, 0], kind="stable")]
        seeds = seeds[np.argsort(seeds[:, 0], kind="stable")]
        first = self._links(fresh, None)
        seed_common = np.where(np.append(False, seeds[1:, 0] == seeds[:-1, 0])[: len(seeds)], seeds[:, 5], 0)
        n0, n1 = len(fresh), len(seeds)
        level = np.concatenate([fresh[:, :5], seeds[:, :5]])
        run = np.concatenate([np.ones(n0, np.int64), seeds[:, 6]])
        strict = np.arange(n0 + n1) >= n0
        rows, runs, parents, size = [level], [run], [np.full(n0 + n1, -1)], 0
        while True:
            self._fill(level[:, 1], level[:, 2:])
            goes = np.flatnonzero((level[:, 2] >= level[:, 0] + strict) & (level[:, 2] < above))
            if not len(goes):
                break
            if len(goes) <= _FEW and len(rows) > _FEW:
                # Few chains that go on for long are followed one by one.
                base = size + len(level)
                for k in goes.tolist():
                    made, its_run = self._chain(level[k], int(run[k]), above)
                    parents.append(np.append(size + k, np.arange(base, base + len(made) - 1)))
                    rows.append(made)
                    runs.append(its_run)
                    base += len(made)
                break
            up = level[goes]
            run = np.where(up[:, 2] == up[:, 0], run[goes] + 1, 1)
            level = np.stack([up[:, 2], up[:, 1] - 1, up[:, 3], up[:, 4], np.where(up[:, 4] == _NONE, _NONE, _UNKNOWN)], axis=1)
            strict = np.zeros(len(level), bool)
            parents.append(size + goes)
            size += len(rows[-1])
            rows.append(level)
            runs.append(run)
        rows, run, parent = np.concatenate(rows), np.concatenate(runs), np.concatenate(parents)
        n = len(rows)
        # Tuples from the queue, then chains, then seeds; those of the first and last kind have places of their own.
        kind = np.ones(n, np.int64)
        kind[:n0], kind[n0 : n0 + n1] = 0, 2
        tie = np.where(kind == 1, 0, np.arange(n))
        order = np.lexsort((tie, kind, rows[:, 0]))
        s, k, t = rows[order, 0], kind[order], tie[order]
        new = np.append(True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (t[1:] != t[:-1]))
        begin = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
        tied = order[np.repeat(np.diff(np.append(begin, n)) > 1, np.diff(np.append(begin, n)))]
        single, above_by, far, history = rank, np.where(parent < 0, np.arange(n), parent), 1, []
        while len(tied):
            history.append((far, rank, above_by))
            key = rank[above_by[tied]]
            by = np.lexsort((key, rank[tied]))
            tied, key = tied[by], key[by]
            old = rank[tied]
            outer = np.append(True, old[1:] != old[:-1])
            inner = outer | np.append(True, key[1:] != key[:-1])
            at = np.arange(len(tied))
            start = np.maximum.accumulate(np.where(inner, at, 0))
            rank = rank.copy()
            rank[tied] = old + start - np.maximum.accumulate(np.where(outer, at, 0))
            sizes = np.diff(np.append(np.flatnonzero(inner), len(tied)))
            tied = tied[np.repeat(sizes > 1, sizes)]
            above_by, far = above_by[above_by], far * 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        # Common prefixes of neighbours: along the chains as far as they agree, then as where the chains began.
        common = np.zeros(n, np.int64)
        y, x = order[:-1].copy(), order[1:].copy()
        ask = np.flatnonzero(single[y] == single[x])
        for far, ranks, up in reversed(history):
            alike = ask[ranks[y[ask]] == ranks[x[ask]]]
            common[alike + 1] += far
            y[alike], x[alike] = up[y[alike]], up[x[alike]]
        same = np.flatnonzero(rows[y, 0] == rows[x, 0])
        ky, kx = kind[y[same]], kind[x[same]]
        tail = np.where((ky == 1) & (kx == 2), np.minimum(run[y[same]], run[x[same]]), 1)
        for what, values, shift in ((0, first, 0), (2, seed_common, n0)):
            at = np.flatnonzero((ky == what) & (kx == what))
            if len(at):
                tail[at] = _Least(values).of(y[same[at]] - shift + 1, x[same[at]] - shift)
        common[same + 1] += tail
        out = np.concatenate([rows[order], common[:, None], run[order, None]], axis=1)
        return out, kind[order] == 2

    def run(self, seeds: Callable[[int], Numbers]) -> None:
        ends = np.append(self.bounds[1:], self.top + 1)
        for k, (low, above) in enumerate(zip(self.bounds.tolist(), ends.tolist(), strict=True)):
            fresh, mine = self.queue.open(k), seeds(k)
            if fresh.rows + mine.rows:
                if above - low == 1:
                    self._stream(fresh, mine, low)
                else:
                    rows, seed = self._ordered(fresh.read(0, fresh.rows), mine.read(0, mine.rows), above)
                    self.queue.push(self._children(rows, seed, above))
                    self.emit(rows, seed)
            fresh.close()
            mine.close()
        self.queue.close()

    def _stream(self, fresh: Numbers, seeds: Numbers, symbol: int) -> None:
        """The suffixes of one symbol: those with one of it, with two, and so on, then the seeds; a part of them at a time."""
        run, level = 0, fresh
        while level.rows:
            run += 1
            if level.rows <= _FEW and (ahead := self._alike_before(level.read(0, level.rows)[:, 1], symbol)) > 1:
                level, run = self._leap(level, symbol, run, ahead)
                continue
            following, last = Numbers(self.folder, _WIDTH, self.memory // 8), None
            for part in level.parts(self.most):
                common = self._links(part, last)
                if last is None:
                    common[0] = run - 1
                last = part[-1]
                rows = np.concatenate([part[:, :5], common[:, None], np.full((len(part), 1), run)], axis=1)
                self._fill(rows[:, 1], rows[:, 2:5])
                made = self._children(rows, np.zeros(len(rows), bool), symbol)
                following.append(made[made[:, 0] == symbol])
                self.queue.push(made[made[:, 0] > symbol])
                self.emit(rows, np.zeros(len(rows), bool))
            level.close()
            level = following
        level.close()
        for a in range(0, seeds.rows, self.most):
            rows = seeds.read(a, a + self.most).copy()
            if a == 0:
                rows[0, 5] = min(run, int(rows[0, 6])) if run else 0
            self._fill(rows[:, 1], rows[:, 2:5])
            self.queue.push(self._children(rows, np.ones(len(rows), bool), symbol + 1))
            self.emit(rows, np.ones(len(rows), bool))


    def _alike_before(self, suffix: np.ndarray, symbol: int) -> int:
        """How many times the symbol stands before every one of the suffixes, as far as there is room for rows."""
        room = self.most // len(suffix)
        for at in suffix.tolist():
            before = self.text.read(at - room, at)[:, 0]
            other = np.flatnonzero(before != (self.top - symbol if self.turned else symbol))
            room = min(room, len(before) - (int(other[-1]) + 1 if len(other) else 0))
        return room

    def _leap(self, level: Numbers, symbol: int, run: int, ahead: int) -> tuple[Numbers, int]:
        """Many steps of a long run at once: none of its few suffixes ends within them."""
        part = level.read(0, level.rows)
        k, common, step = len(part), self._links(part, None), np.repeat(np.arange(ahead), level.rows)
        rows = np.empty((ahead * k, 7), np.int64)
        rows[:, 0] = rows[:, 2] = symbol
        rows[:, 3:5] = _UNKNOWN
        rows[:, 1] = np.tile(part[:, 1], ahead) - step
        rows[:, 5] = np.tile(common, ahead) + step
        rows[::k, 5] = run - 1 + np.arange(ahead)
        rows[:, 6] = run + step
        self.low.append(int(rows[:, 5].min()))
        self.emit(rows, np.zeros(len(rows), bool))
        level.close()
        following = Numbers(self.folder, _WIDTH, self.memory // 8)
        part = part.copy()
        part[:, 1] -= ahead
        part[:, 2:5] = _UNKNOWN
        part[:, 5] = len(self.low) - 1
        part[:, 6] = common + ahead - 1
        following.append(part)
        return following, run + ahead - 1


class _Reversed:
    """The rows a to b of a file of suffixes in order, from the last to the first, with symbols turned."""

    def __init__(self, of: Numbers, a: int, b: int, top: int):
        self.of, self.a, self.b, self.top, self.rows = of, a, b, top, b - a

    def read(self, a: int, b: int) -> np.ndarray:
        b = min(b, self.rows)
        rows = self.of.read(self.b - b, self.b - a + (a > 0))[::-1]
        common = np.append(0, rows[:-1, 5]) if a == 0 else rows[:-1, 5]
        rows = rows[a > 0 :].copy()
        rows[:, 5] = common
        return _turned(rows, self.top)

    def close(self) -> None:
        pass


def _turned(rows: np.ndarray, top: int) -> np.ndarray:
    rows[:, 0] = top - rows[:, 0]
    rows[:, 2:5] = np.where(rows[:, 2:5] < 0, rows[:, 2:5], top - rows[:, 2:5])
    return rows


def _seeds(text: Numbers, part: int) -> Iterator[np.ndarray]:
    """Suffixes that start a rise after a fall, in the order of the text: symbol, suffix, symbols before, ALIKE, run."""
    n = text.rows
    starts = list(range(0, n, part))
    edges = {}
    after, rise, run = -1, True, 0

    def shape(v, after, rise, run, last):
        ends = np.append(np.flatnonzero(v[1:] != v[:-1]), len(v) - 1)
        goes = not last and v[-1] == after
        rises = np.append(v[ends[:-1]] < v[ends[:-1] + 1], True if last else rise if goes else v[-1] < after)
        sizes = np.diff(np.append(-1, ends))
        length = np.repeat(ends, sizes) - np.arange(len(v)) + 1
        if goes:
            length[len(v) - sizes[-1] :] += run
        return np.repeat(rises, sizes), length

    for a in reversed(starts):
        v = text.read(a, a + part)[:, 0]
        edges[a] = (after, rise, run)
        rises, length = shape(v, after, rise, run, a + part >= n)
        after, rise, run = int(v[0]), bool(rises[0]), int(length[0])
    for a in starts:
        left = min(_BEFORE, a)
        w = text.read(a - left, a + part)[:, 0]
        v = w[left:]
        rises, length = shape(v, *edges[a], a + part >= n)
        w = np.concatenate([np.full(_BEFORE - left, _NONE), w])
        at = np.flatnonzero(rises & (w[_BEFORE - 1 : -1] > v))
        yield np.stack([v[at], a + at, w[at + 2], w[at + 1], w[at], np.full(len(at), ALIKE), length[at]], axis=1)


def _agree(text: Numbers, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols agree from x and from y on."""
    out, live, width = np.zeros(len(x), np.int64), np.arange(len(x)), 4
    while len(live):
        step = np.arange(width)
        a, b = (text.take(np.minimum((p[live] + out[live])[:, None] + step, text.rows - 1).ravel())[:, 0].reshape(-1, width) for p in (x, y))
        differ = a != b
        met = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[live] += met
        live = live[met == width]
        width = max(4, min(width * 2, 1 << 14, (_PAGE * 8) // max(1, len(live))))
    return out


def suffix_file(text: Numbers, folder: Path, memory: int = MEMORY) -> Numbers:
    """Rows (suffix, common prefix with the row before, its successor) from the greatest suffix to the least.

    text: symbols from 0 on; the last one must be 0 and occur nowhere else.
    """
    small = memory // 8
    n, part = text.rows, max(4, memory // 32)
    out = Numbers(folder, 2, small)
    if n == 1:
        out.append(np.zeros((1, 2), np.int64))
        return out
    top = max(int(p.max()) for p in text.parts(_PAGE))
    bounds = _bounds(text, top, part)
    starts = Numbers(folder, 7, small)
    for rows in _seeds(text, part):
        starts.append(rows)

    def induced(seeds: Queue, emit: Callable) -> None:
        falls, blocks = Numbers(folder, 7, small), [0]

        def fallen(rows: np.ndarray, seed: np.ndarray) -> None:
            falls.append(rows[~seed])

        def opened(k: int) -> Numbers:
            if k:
                blocks.append(falls.rows)
            return seeds.open(k)

        _Induction(text, bounds, top, False, folder, memory, fallen).run(opened)
        blocks.append(falls.rows)
        last = len(bounds) - 1
        _Induction(text, bounds, top, True, folder, memory, emit).run(lambda k: _Reversed(falls, blocks[last - k], blocks[last - k + 1], top))
        falls.close()

    # Names of the stretches, from the greatest down.
    width = max(part, -(-n // (1 << 12)))
    by_place = Queue(np.arange(0, n, width), folder, 2, memory)
    sorted_starts = Numbers(folder, 7, small)
    state = {"name": -1, "low": ALIKE}

    def name(rows: np.ndarray, seed: np.ndarray) -> None:
        at = np.flatnonzero(~seed & (rows[:, 2] >= 0) & (rows[:, 2] < rows[:, 0]))
        low = np.minimum.reduceat(np.append(rows[:, 5], ALIKE), np.append(0, at + 1))
        low[0] = min(low[0], state["low"])
        state["low"] = int(low[-1])
        if len(at):
            low = low[:-1]
            new = low < ALIKE
            if state["name"] < 0:
                new[0] = True
            names = state["name"] + np.cumsum(new)
            state["name"] = int(names[-1])
            by_place.push(np.stack([rows[at, 1], names], axis=1))
            kept = rows[at].copy()
            kept[:, 5] = low
            sorted_starts.append(_turned(kept, top))

    first = Queue(bounds, folder, 7, memory)
    for rows in starts.parts(part):
        first.push(rows)
    induced(first, name)
    first.close()
    distinct = state["name"] + 1
    seeds = Queue(bounds, folder, 7, memory)
    seeds.push(starts.read(starts.rows - 1, starts.rows))
    if distinct == starts.rows - 1:
        for b in range(sorted_starts.rows, 0, -part):
            a = max(0, b - part)
            # From the least up; the row before it comes first, and common prefixes of names alone don't count.
            rows = sorted_starts.read(a, b + 1)[::-1]
            lead = b < sorted_starts.rows
            made = rows[lead:].copy()
            made[:, 5] = np.append(np.zeros(1 - lead, np.int64), _agree(text, rows[:-1, 1], rows[1:, 1]))
            seeds.push(made)
        sorted_starts.close()
    else:
        sorted_starts.close()
        names = Numbers(folder, 1, small)
        for k in range(len(by_place.bounds)):
            block = by_place.open(k)
            rows = block.read(0, block.rows)
            names.append(distinct - rows[np.argsort(rows[:, 0]), 1])
            block.close()
        names.append(np.zeros(1, np.int64))
        for held in (text, starts, names, seeds):
            held.spill()
        order = suffix_file(names, folder, memory)
        # The least is the last start, which is there already.
        for b in range(order.rows - 1, 0, -part):
            a = max(0, b - part)
            # The row before comes first; its entry is the common prefix with the one after it.
            rows = order.read(a, b + 1)[::-1]
            k, ahead, same = rows[1:, 0], rows[:-1, 0], rows[:-1, 1]
            made = starts.take(k)
            x, y = starts.take(ahead + same)[:, 1], starts.take(k + same)[:, 1]
            made[:, 5] = (y - made[:, 1]) + _agree(text, x, y)
            seeds.push(made)
        order.close()
        names.close()
    by_place.close()

    def final(rows: np.ndarray, seed: np.ndarray) -> None:
        out.append(np.stack([rows[:, 1], rows[:, 5]], axis=1))

    induced(seeds, final)
    seeds.close()
    starts.close()
    out.append(np.array([[n - 1, 0]]))
    return out


def suffixes(text: np.ndarray, folder: Path, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes with predecessors (0 for the first), for texts that fit in memory."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    file = Numbers(folder, 1, memory // 8)
    file.append(np.asarray(text, np.int64))
    made = suffix_file(file, folder, memory)
    rows = made.read(0, made.rows)[::-1].copy()
    file.close()
    made.close()
    return rows[:, 0], np.append(0, rows[:-1, 1])
