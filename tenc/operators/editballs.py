"""Partners within an edit distance, all texts against all: many left texts step through a right text side by side.

Left texts of about one length are the lanes of small arrays. A right text is cut in two: the table of its beginning with all
lanes, and that of its ending read backwards, meet in a minimum over the places where a lane may be cut. Only places that
so few edits can reach are kept. Right texts are taken in order of their beginnings, so those that begin alike share
their columns; endings that many share are computed once for all lanes.
"""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-9
# Left texts side by side, and right texts whose hits are counted at once.
LANES = 8192
_BATCH = 16
# Right texts that must end alike for their ending to be kept, and what endings and columns may take.
_ENDING = 8
_DEEPEST = 64
_ENDING_BYTES = 128 << 20
_COLUMN_BYTES = 64 << 20
# What a column of all lanes may take.
_STATE_BYTES = 1 << 20
# Fewer lanes than this, or longer ones, are compared pair by pair.
_FEW_LANES = 96
_LONG = 512
# Pairs whose edit distance is computed side by side, and those whose state is held at once.
_PAIR_LANES = 8192
_PAIRS = 1 << 21
# Right texts that must begin alike for their beginning to be computed once for all pairs.
_BEGINNING = 8
_WORD = 64
#: Kinds of numbers, the value of a place that cannot be reached, and the largest that may come up.
_KINDS = ((np.int8, 60, 62), (np.int16, 8000, 16000), (np.int32, 1 << 28, 1 << 29))


class Texts:
    """The characters of some texts, one after the other."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        self.chars = np.frombuffer(raw, np.uint32).astype(np.int64) + 1
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)

    def place(self) -> np.ndarray:
        return np.arange(len(self.chars)) - self.starts[self.owner]


class EditTable:
    """Edit distances between two strips of texts, by bit vectors over the left text.

    A column of the distance table is two bit vectors of its steps up and down. Right texts that begin alike share the
    columns of their beginning: these are computed once for every left text and beginning.
    """

    def __init__(self, left: Texts, right: Texts):
        self.left, self.right = left, right
        symbols, coded = np.unique(left.chars, return_inverse=True)
        self.symbols = len(symbols) + 1
        self.words = max(1, -(-int(left.sizes.max(initial=0)) // _WORD))
        place = left.place()
        # By word, text and symbol the places of the symbol; the last symbol stands for all that no left text has.
        where = np.zeros((self.words, len(left.sizes), self.symbols), np.uint64)
        bit = np.uint64(1) << (place % _WORD).astype(np.uint64)
        np.bitwise_or.at(where, (place // _WORD, left.owner, coded), bit)
        self.where = where.reshape(self.words, -1)
        seen = np.searchsorted(symbols, right.chars)
        known = seen < len(symbols)
        known[known] = symbols[seen[known]] == right.chars[known]
        self.wide = np.full((int(right.sizes.max(initial=0)), len(right.sizes)), self.symbols - 1, np.int32)
        self.wide[right.place(), right.owner] = np.where(known, seen, self.symbols - 1)
        self._find_beginnings()

    def _find_beginnings(self) -> None:
        """For each right text the longest beginning that enough others share."""
        n = len(self.right.sizes)
        self.depth, self.node = np.zeros(n, np.int64), np.zeros(n, np.int64)
        group, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for step, line in enumerate(self.wide):
            alive &= self.right.sizes > step
            # Symbols unknown on the left are alike to the table, and so to a beginning.
            _, inverse, size = np.unique(
                np.where(alive, group * self.symbols + line, -1), return_inverse=True, return_counts=True
            )
            group = inverse
            alive &= size[inverse] >= _BEGINNING
            if not alive.any():
                break
            self.depth[alive], self.node[alive] = step + 1, group[alive]
        key, self.first, self.node = np.unique(
            self.depth * (n + 1) + self.node, return_index=True, return_inverse=True
        )
        x, y = np.meshgrid(np.arange(len(self.left.sizes)), self.first, indexing="ij")
        x, y = x.ravel(), y.ravel()
        up = np.full((self.words, len(x)), ~np.uint64(0))
        down = np.zeros((self.words, len(x)), np.uint64)
        self._advance(x, y, np.zeros(len(y), np.int64), self.depth[y], up, down)
        self.begun = up, down

    def _advance(self, x, y, begin, steps, up, down) -> None:
        """Go on by ``steps`` characters of texts ``y`` from ``begin``; changes ``up`` and ``down`` (word by pair)."""
        one = np.uint64(1)
        # Short numbers are sorted by their digits.
        short = steps.astype(np.int16) if int(steps.max(initial=0)) < 1 << 15 else steps
        by_steps = np.argsort(-short, kind="stable")
        width = len(self.right.sizes)
        flat = self.wide.ravel()
        for low in range(0, len(x), _PAIR_LANES):
            lanes = by_steps[low : low + _PAIR_LANES]
            base, at, left = x[lanes] * self.symbols, begin[lanes] * width + y[lanes], steps[lanes]
            pairs = [(up[w][lanes], down[w][lanes]) for w in range(self.words)]
            active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
            for step, k in enumerate(active):
                place = base[:k] + flat[at[:k] + step * width]
                more, less = one, np.uint64(0)
                for w, (pv_all, mv_all) in enumerate(pairs):
                    pv, mv = pv_all[:k], mv_all[:k]
                    eq = self.where[w][place]
                    xv = eq | mv
                    if w:
                        eq |= less
                    xh = (((eq & pv) + pv) ^ pv) | eq
                    ph = mv | ~(xh | pv)
                    mh = pv & xh
                    shifted_up, shifted_down = (ph << one) | more, (mh << one) | less
                    if w + 1 < self.words:
                        more, less = ph >> np.uint64(63), mh >> np.uint64(63)
                    pv_all[:k] = shifted_down | ~(xv | shifted_up)
                    mv_all[:k] = shifted_up & xv
            for w, (pv, mv) in enumerate(pairs):
                up[w][lanes], down[w][lanes] = pv, mv

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the pairs of left texts ``i`` and right texts ``j``."""
        out = np.empty(len(i), np.int64)
        for low in range(0, len(i), _PAIRS):
            x, y = i[low : low + _PAIRS], j[low : low + _PAIRS]
            begun = x * len(self.first) + self.node[y]
            up, down = self.begun[0][:, begun], self.begun[1][:, begun]
            self._advance(x, y, self.depth[y], self.right.sizes[y] - self.depth[y], up, down)
            found = self.right.sizes[y].copy()
            for w in range(self.words):
                bits = np.clip(self.left.sizes[x] - w * _WORD, 0, _WORD).astype(np.uint64)
                # A shift by all 64 bits is not defined.
                mask = np.where(bits > 0, ~np.uint64(0) >> (np.uint64(_WORD) - np.maximum(bits, np.uint64(1))), np.uint64(0))
                found += np.bitwise_count(up[w] & mask).astype(np.int64)
                found -= np.bitwise_count(down[w] & mask).astype(np.int64)
            out[low : low + _PAIRS] = found
        return out


def most_edits(longest: int, level: float) -> np.ndarray:
    """The edits that leave a similarity of ``level``, by the length of the longer text."""
    size = np.arange(longest + 1)
    edits = np.floor(size * (1 - level)).astype(np.int64) + 1
    for _ in range(3):
        edits -= (edits > 0) & (1 - edits / np.maximum(size, 1) < level - TOLERANCE)
    return edits


def _by_pairs(texts: list[str], rights: list[str], levels: list[float], both: np.ndarray, right_hits: np.ndarray) -> np.ndarray:
    """As ``_strip``, by the distance of every pair that lengths allow."""
    hits = np.zeros((len(levels), len(texts)), np.int64)
    left, size = Texts(texts), np.array([len(t) for t in rights], np.int64)
    longest = np.maximum(int(left.sizes.max()), size)
    allowed = most_edits(int(longest.max()), min(levels))
    low, high = size - left.sizes.max(), left.sizes.min() - size
    known = np.flatnonzero(np.maximum(low, high) <= allowed[longest])
    step = max(1, (_PAIRS >> 1) // (len(texts) * max(1, int(left.sizes.max()) // _WORD)))
    for at in range(0, len(known), step):
        some = known[at : at + step]
        pair_longest = np.maximum(left.sizes[:, None], size[some][None, :])
        i, j = np.nonzero(np.abs(left.sizes[:, None] - size[some][None, :]) <= allowed[pair_longest])
        if not len(i):
            continue
        distance = EditTable(left, Texts([rights[x] for x in some])).distances(i, j)
        for level, share in enumerate(levels):
            hit = distance <= most_edits(int(pair_longest.max()), share)[pair_longest[i, j]]
            hits[level] += np.bincount(i[hit], minlength=len(texts))
            right_hits[level, some] += np.bincount(j[hit], minlength=len(some)) * both[some]
    return hits


def _common(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many first symbols each row shares with the row before it; the first shares none."""
    if len(codes) < 2:
        return np.zeros(len(codes), np.int64)
    differ = codes[1:] != codes[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])
    return np.concatenate([[0], np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))])


class Rights:
    """Right texts in order of their beginnings, each with its ending."""

    def __init__(self, texts: list[str], most_endings: int):
        backward = [t[::-1] for t in texts]
        order = np.array(sorted(range(len(texts)), key=backward.__getitem__), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        depth = np.zeros(len(texts), np.int64)
        deepest = min(_DEEPEST, int(sizes.max(initial=0)))
        tails = _matrix([backward[i][:deepest] for i in order], deepest)
        shared = _common(tails, np.minimum(sizes[order], deepest))
        alike = np.zeros((len(texts), deepest), np.int32)
        for step in range(1, deepest + 1):
            run = np.cumsum(shared < step) - 1
            count = np.bincount(run)[run]
            if count.max() < _ENDING:
                break
            alike[:, step - 1] = count
        least = _ENDING
        while True:
            # An ending of its own is a run that enough texts share to that depth.
            depth = (alike >= least).sum(axis=1)
            new = (shared < depth) | (np.concatenate([[-1], depth[:-1]]) != depth)
            if new.sum() <= most_endings or not depth.any():
                break
            least += max(1, least // 8)
        name = np.empty(len(texts), np.int64)
        name[order] = np.cumsum(new) - 1
        cut = np.empty(len(texts), np.int64)
        cut[order] = sizes[order] - depth
        self.endings = [backward[i][:d] for i, d in zip(order[new], depth[new])]
        heads = [t[:c] for t, c in zip(texts, cut)]
        self.order = np.array(sorted(range(len(texts)), key=heads.__getitem__), np.int64)
        self.sizes, self.cuts, self.ending = sizes[self.order], cut[self.order], name[self.order]
        self.heads = [heads[i] for i in self.order]


def _matrix(texts: list[str], width: int) -> np.ndarray:
    """Characters by text and place; zero after the end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), width), np.int32)
    out[np.arange(width)[None, :] < sizes[:, None]] = (
        np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1
    )
    return out


class _Lanes:
    """Left texts and the steps of their tables.

    Row ``r`` of a column for ``j`` symbols is the place ``j + low + r`` of the lane; what stands there is the distance less ``r``.
    """

    def __init__(self, chars: np.ndarray, outside: np.ndarray, low: int, rows: int, depth: int, kind, far: int):
        self.low, self.rows, self.kind, self.far = low, rows, kind, far
        # Places 1 + low and on; behind a lane's end nothing matches. Symbols are short numbers where they are few.
        places = np.arange(1 + low, 1 + low + depth + rows)
        known = (places >= 1) & (places <= len(chars))
        symbols, coded = np.unique(chars, return_inverse=True)
        self.codes = {int(c): i for i, c in enumerate(symbols) if c > 0}
        self.chars = np.full((len(places), chars.shape[1]), -1, np.int8 if len(symbols) < 127 else np.int32)
        self.chars[known] = np.where(chars > 0, coded.reshape(chars.shape), -1)[places[known] - 1]
        # Places before a lane's beginning are out of reach in every column.
        self.last_before = int(outside.max()) - 1
        self.before = places[:, None] < outside[None, :]
        first = low + np.arange(rows)[:, None]
        self.begin = np.full((rows + 1, chars.shape[1]), far, kind)
        self.begin[:rows] = np.where(first < outside[None, :], far, low - outside[None, :])
        self.differ = np.empty((rows, chars.shape[1]), bool)
        # One byte a place: what differs becomes a way through it where it stands.
        self.spare = self.differ.view(np.int8) if kind is np.int8 else np.empty(self.differ.shape, kind)

    def column(self) -> np.ndarray:
        out = np.empty_like(self.begin)
        out[self.rows] = self.far
        return out

    def step(self, old: np.ndarray, symbol: str, j: int, new: np.ndarray, start: int, rows: int) -> None:
        """Column ``j`` from the one before it, for ``rows`` rows from ``start`` of the band; ``old`` has one row more."""
        own, spare, differ, top = new[:rows], self.spare[:rows], self.differ[:rows], j - 1 + start
        np.not_equal(self.chars[top : top + rows], self.codes.get(ord(symbol) + 1, -2), out=differ)
        np.add(old[:rows], differ.view(np.int8), out=spare)
        np.add(old[1 : rows + 1], 2, out=own, dtype=self.kind, casting="unsafe")
        np.minimum(spare, own, out=own)
        for r in range(min(rows, self.last_before - j - self.low - start + 1)):
            np.copyto(own[r], self.far, where=self.before[top + r])
        above = own[0]
        for row in own[1:]:
            np.minimum(row, above, row)
            above = row


def _endings(lanes: _Lanes, rights: Rights, reach: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Of each ending that is asked for its last column, rows from the highest asked down to the lowest."""
    out, stack, before = {}, [lanes.begin], ""
    # Endings come sorted.
    for name in sorted(reach):
        text = rights.endings[name]
        same = 0
        while same < min(len(text), len(before), len(stack) - 1) and text[same] == before[same]:
            same += 1
        del stack[same + 1 :]
        for j in range(same + 1, len(text) + 1):
            stack.append(lanes.column())
            lanes.step(stack[-2], text[j - 1], j, stack[-1], 0, lanes.rows)
        low, high = reach[name]
        out[name] = np.ascontiguousarray(stack[-1][low : high + 1][::-1])
        before = text
    return out


def _strip(texts: list[str], rights: Rights, levels: list[float], both: np.ndarray, right_hits: np.ndarray) -> np.ndarray:
    """Hits by level of some texts of about one length with all right texts; adds those of right texts marked ``both``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n, longest = len(texts), int(sizes.max())
    right_longest = int(rights.sizes.max(initial=0))
    edits = [most_edits(max(longest, right_longest), level) for level in levels]
    widest = np.max(edits, axis=0)
    lengths = np.unique(sizes)
    hits = np.zeros((len(levels), n), np.int64)
    # By length of a right text: the places that few enough edits reach, counted from the end of the longest lane.
    reach: dict[int, tuple[int, int]] = {}
    for size in np.unique(rights.sizes).tolist():
        most, apart = widest[np.maximum(lengths, size)], lengths - size
        near = np.abs(apart) <= most
        if near.any():
            # Lanes too far off keep their straightest way, so that every value is that of a way.
            shift, spare = longest - lengths, np.maximum(most, np.abs(apart))
            reach[size] = int((-((spare - apart) // 2) + shift).min()), int(((apart + spare) // 2 + shift).max())
    if not reach:
        return hits
    low, high = min(a for a, _ in reach.values()), max(b for _, b in reach.values())
    back_low = min(longest - size - b for size, (_, b) in reach.items())
    back_high = max(longest - size - a for size, (a, _) in reach.items())
    largest = max(low, back_low, 0) + max(longest, max(reach)) + 3
    # Values grow by one a symbol at most.
    kind, far = next(
        (k, f) for k, f, top in _KINDS if largest <= top and max(int(widest[max(longest, max(reach))]), 1) < f - 4
    )
    chars = np.full((longest, n), -1, np.int32)
    padding = longest - sizes
    placed = _matrix(texts, longest)
    inside = np.arange(longest)[None, :] < sizes[:, None]
    chars.T[np.arange(longest)[None, :] >= padding[:, None]] = placed[inside]
    front = _Lanes(chars, padding, low, high - low + 1, int(rights.cuts.max()), kind, far)
    rear = _Lanes(
        np.ascontiguousarray(chars[::-1]), np.zeros(n, np.int64), back_low, back_high - back_low + 1,
        max(map(len, rights.endings)), kind, far,
    )
    asked = np.array([size in reach for size in rights.sizes.tolist()], bool)
    taken = np.flatnonzero(asked)
    bounds: dict[int, tuple[int, int]] = {}
    plan = {}
    for size, (a, b) in reach.items():
        whole = longest - size - low - back_low
        plan[size] = (a - low, b - a + 1, whole)
    for name, size in set(zip(rights.ending[taken].tolist(), rights.sizes[taken].tolist())):
        start, rows, whole = plan[size]
        one = (whole - start - rows + 1, whole - start)
        known = bounds.get(name, one)
        bounds[name] = (min(known[0], one[0]), max(known[1], one[1]))
    tails = _endings(rear, rights, bounds)
    # Thresholds on what is found, by length of the right text.
    number = {size: i for i, size in enumerate(plan)}
    limit = [
        np.stack([np.minimum(e[np.maximum(sizes, size)] - whole, far - 4) for size, (_, _, whole) in plan.items()]).astype(kind)
        for e in edits
    ]
    heads = [rights.heads[i] for i in taken]
    cuts = rights.cuts[taken].tolist()
    right_sizes, names = rights.sizes[taken].tolist(), rights.ending[taken].tolist()
    common = _shared_heads(heads)
    deepest = max(1, _COLUMN_BYTES // front.begin.nbytes)
    starts = np.array([plan[size][0] for size in right_sizes])
    ends = starts + np.array([plan[size][1] for size in right_sizes])
    until = _until(common)
    stack, spans = [front.begin], [(0, front.rows)]
    spare = [front.column(), front.column()]
    met = np.empty((front.rows, n), kind)
    found = np.empty((_BATCH, n), kind)
    kept = 0
    pending: list[int] = []

    def count() -> None:
        rows = np.array([number[right_sizes[i]] for i in pending])
        at = rights.order[taken[pending]]
        for level in range(len(levels)):
            hit = found[: len(pending)] <= limit[level][rows]
            hits[level] += np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8)
            right_hits[level, at] += np.array([np.count_nonzero(h) for h in hit]) * both[at]
        pending.clear()

    for i, head in enumerate(heads):
        cut = cuts[i]
        share = min(common[i + 1], cut, deepest)
        if share > kept:
            # The rows that any text with this beginning needs.
            low_row, high_row = int(starts[i : until[i]].min()), int(ends[i : until[i]].max())
        for j in range(kept + 1, share + 1):
            if len(stack) <= j:
                stack.append(front.column())
                spans.append((0, 0))
            skip = low_row - spans[j - 1][0]
            front.step(stack[j - 1][skip : skip + high_row - low_row + 1], head[j - 1], j, stack[j], low_row, high_row - low_row)
            stack[j][high_row - low_row] = far
            spans[j] = (low_row, high_row)
        at = max(kept, share)
        start, rows, whole = plan[right_sizes[i]]
        skip = start - spans[at][0]
        state = stack[at][skip : skip + rows + 1]
        for j in range(at + 1, cut + 1):
            new = spare[j & 1]
            front.step(state, head[j - 1], j, new, start, rows)
            new[rows] = far
            state = new
        kept = share
        first = bounds[names[i]][1] - (whole - start)
        np.add(state[:rows], tails[names[i]][first : first + rows], out=met[:rows])
        np.minimum.reduce(met[:rows], axis=0, out=found[len(pending)])
        pending.append(i)
        if len(pending) == _BATCH:
            count()
    if pending:
        count()
    return hits


def _shared_heads(heads: list[str]) -> list[int]:
    """How many first symbols each beginning shares with the one before it, and none after the last."""
    out = []
    before = ""
    for text in heads:
        most, same = min(len(text), len(before)), 0
        if before[:most] == text[:most]:
            same = most
        else:
            low, high = 0, most
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if before[:middle] == text[:middle] else (low, middle)
            same = low
        out.append(same)
        before = text
    return [*out, 0]


def _until(common: list[int]) -> list[int]:
    """For each text the next one that shares no more with the text before it than this one does."""
    n = len(common) - 1
    out, waiting = [n] * n, []
    for i in range(n):
        while waiting and common[waiting[-1]] >= common[i]:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def count_hits(lefts: list[str], rights: list[str], both: np.ndarray, levels: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """By level: for each left text the right ones as similar, and for each right text marked ``both`` the left ones."""
    left_hits = np.zeros((len(levels), len(lefts)), np.int64)
    right_hits = np.zeros((len(levels), len(rights)), np.int64)
    if not lefts or not rights:
        return left_hits, right_hits
    sizes = np.array([len(t) for t in lefts], np.int64)
    order = np.argsort(sizes, kind="stable")
    longest = int(sizes.max())
    rows = int(most_edits(longest, min(levels))[-1]) * 2 + 8
    most = max(16, min(LANES, _STATE_BYTES // rows))
    known, both = None, both.astype(np.int64)
    at = 0
    while at < len(order):
        # Lanes of one array are of about one length.
        first = int(sizes[order[at]])
        end = min(at + most, int(np.searchsorted(sizes[order], first + max(4, first // 8), side="right")))
        own = order[at:end]
        texts = [lefts[i] for i in own]
        if len(own) < _FEW_LANES or len(texts[-1]) > _LONG:
            left_hits[:, own] = _by_pairs(texts, rights, levels, both, right_hits)
        else:
            known = known or Rights(rights, max(1, _ENDING_BYTES // (rows * min(most, len(lefts)))))
            left_hits[:, own] = _strip(texts, known, levels, both, right_hits)
        at = end
    return left_hits, right_hits
