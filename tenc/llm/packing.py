"""Packing documents into fixed windows by order-preserving dynamic programming.

The documents of a partition form one stream of token ids in their order, each closed by an end
id. Windows are cut out of the stream without gaps. Cuts at the end of a document are free,
cuts at the end of a sentence cost a little, cuts elsewhere more. A window shorter than the
limit is padded to it, unless its length is a power of two. Cuts minimise padding plus
penalties: padding is linear in the cut before, so the best one within reach is the head of a
monotone queue.

The stream is cut in blocks; what the last two windows of a block hold is cut again with the
next block. Nothing is shuffled, unless rows are first dealt in the order of their files, and a task holds one block and the ids of its longest
document. A retried task gives the same sequences. Missing texts are packed as their end id.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tenc.llm.common import as_written, map_texts
from tenc.llm.tokens import Lookup

BLOCK = 1 << 18
# In tokens of padding: a cut inside a document after a sentence or elsewhere, and any window.
SENTENCE_COST, INSIDE_COST, WINDOW_COST = 8, 64, 1
# Where no sentence ends, cuts are allowed every so many tokens.
STRIDE = 128


def sentence_ids(text: str) -> np.ndarray:
    """Per id of a tokenizer's JSON, whether a sentence may end with it."""
    spec = json.loads(text)["model"]
    suffix = spec.get("end_of_word_suffix") or ""
    table = np.zeros(max(spec["vocab"].values()) + 1, bool)
    for piece, number in spec["vocab"].items():
        if piece.endswith(suffix):
            table[number] = piece.removesuffix(suffix).endswith((".", "!", "?"))
    return table


def _candidates(
    n: int, documents: np.ndarray, sentences: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may lie, from 0 to ``n``, and their costs; neighbours lie within a window."""
    stride = min(STRIDE, window)
    cost = np.full(n + 1, -1, np.int64)
    cost[sentences] = SENTENCE_COST
    cost[documents] = 0
    cost[0] = cost[n] = 0
    known = np.flatnonzero(cost >= 0)
    for i in np.flatnonzero(np.diff(known) > stride):
        cost[known[i] + stride : known[i + 1] : stride] = INSIDE_COST
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def cut_points(n: int, documents: np.ndarray, sentences: np.ndarray, window: int) -> list[int]:
    """The cheapest cuts of a stream of ``n`` tokens, without 0 and with ``n``."""
    places, costs = _candidates(n, documents, sentences, window)
    at = np.full(n + 1, -1, np.int64)
    at[places] = np.arange(len(places))
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        later = np.flatnonzero(places >= size)
        before = at[places[later] - size]
        for j, i in zip(later[before >= 0].tolist(), before[before >= 0].tolist()):
            exact.setdefault(j, []).append(i)
        size *= 2
    pos, price = places.tolist(), (costs + WINDOW_COST).tolist()
    total, back = [0] * len(pos), [0] * len(pos)
    queue = deque([0])
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0]] < p - window:
            queue.popleft()
        best_i = queue[0]
        best = total[best_i] + pos[best_i] + window - p
        for i in exact.get(j, ()):
            if total[i] < best:
                best, best_i = total[i], i
        total[j], back[j] = best + price[j], best_i
        key = total[j] + p
        while queue and total[queue[-1]] + pos[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    found, j = [], len(pos) - 1
    while j:
        found.append(pos[j])
        j = back[j]
    return found[::-1]


class _Packer:
    """The open end of one partition's stream: spans of (document, its tokens, tokens before, ids)."""

    def __init__(self, window: int, block: int, ends_sentence: np.ndarray):
        self.window, self.block = window, max(block, 8 * window)
        self.ends_sentence = ends_sentence
        self.spans: deque = deque()
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.spans.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)

    def _take(self) -> list[tuple]:
        taken, room = [], self.block
        while self.spans and room:
            doc_id, tokens, before, ids = self.spans.popleft()
            if len(ids) > room:
                self.spans.appendleft((doc_id, tokens, before + room, ids[room:]))
                ids = ids[:room]
            taken.append((doc_id, tokens, before, ids))
            room -= len(ids)
        return taken

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """Closed windows, each a list of spans; all of the stream if ``last``."""
        while self.held >= self.block or (last and self.held):
            spans = self._take()
            final = last and not self.spans
            ends = np.cumsum([len(s[3]) for s in spans])
            n = int(ends[-1])
            whole = [b + len(i) == t for _, t, b, i in spans]
            stream = np.concatenate([s[3] for s in spans])
            known = stream < len(self.ends_sentence)
            stops = np.flatnonzero(self.ends_sentence[np.where(known, stream, 0)] & known) + 1
            cuts = cut_points(n, ends[np.array(whole, bool)], stops, self.window)
            if not final:
                cuts = [c for c in cuts if c <= n - 2 * self.window]
            start = 0
            rest = deque(spans)
            for cut in cuts:
                room, out = cut - start, []
                while room:
                    doc_id, tokens, before, ids = rest.popleft()
                    if len(ids) > room:
                        rest.appendleft((doc_id, tokens, before + room, ids[room:]))
                        ids = ids[:room]
                    room -= len(ids)
                    if out and out[-1][2] + len(out[-1][3]) < out[-1][1]:  # cut by a block, not by a window
                        doc_id, tokens, before, head = out.pop()
                        ids = np.concatenate([head, ids])
                    out.append((doc_id, tokens, before, ids))
                start = cut
                yield out
            self.held -= start
            self.spans.extendleft(reversed(rest))


def pack(
    docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, block: int = BLOCK,
    ordered: bool = False,
) -> DataFrame:
    """A row for each piece of a document: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and the piece's ``ids`` (little-endian, 4 bytes each).

    Repeated rows are packed as often as they come. Sequence numbers are unique, not gapless. With
    ``ordered`` they ascend in the order in which the files of ``docs`` were written.
    """
    lookup = Lookup(docs, path, ids=True)
    with open(path, encoding="utf-8") as file:
        ends_sentence = sentence_ids(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    end = end_id.to_bytes(4, "little")

    def rows(windows, number: list[int], key: pa.DataType):
        first = TaskContext.get().partitionId() << 40
        out: list[list] = [[] for _ in names]
        for spans in windows:
            offset = 0
            for doc_id, tokens, before, ids in spans:
                raw = ids.tobytes()
                row = (doc_id, before, len(ids), zlib.crc32(raw), tokens, first + number[0], offset, raw)
                for column, value in zip(out, row):
                    column.append(value)
                offset += len(ids)
            number[0] += 1
        kinds = [key, *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    def run(batches):
        ids_of = lookup.ids()
        packer, number, key = _Packer(window, block, ends_sentence), [0], None
        for batch, texts in batches:
            key = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                packer.add(doc_id, np.frombuffer(ids_of(text or "") + end, "<u4"))
            yield rows(packer.windows(last=False), number, key)
        if key is not None:
            yield rows(packer.windows(last=True), number, key)

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", ids binary"
    return map_texts(as_written(docs) if ordered else docs, ["doc_id"], schema, run)
