"""Packing token sequences into windows by multiway differencing.

A document's ids are cut into whole windows and a remainder. Remainders are gathered
into batches that just fill a few windows, cut into pieces, and split over the
windows by Karmarkar-Karp differencing: each piece starts as a partition of its own,
and the two partitions with the largest imbalance are merged, the fullest part of
one with the emptiest of the other, until one is left. Its parts are the windows,
nearly equal. If the fullest exceeds the capacity, the batch first hands a few
tokens on to the next one; if that doesn't help, the number of windows rises. Where pieces
are alike and fill no window well, the last part of the batch is cut into small pieces.

Each task packs the documents of its own partition, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Chunks of text whose ids a worker remembers at a time; some 30 MB.
CHUNK_CACHE = 200_000
_SCHEMA = "doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], parts: int) -> tuple[list[int], list[list[int]]]:
    """Split items into ``parts`` of nearly equal sums: (sums, item numbers), fullest first."""
    rest = [0] * (parts - 1)
    heap = [(-s, i, [s, *rest], [[i], *([] for _ in rest)]) for i, s in enumerate(sizes)]
    if not heap:
        return [0] * parts, [[] for _ in range(parts)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, sums_a, items_a = heapq.heappop(heap)
        _, _, sums_b, items_b = heapq.heappop(heap)
        merged = sorted(
            ((a + b, j) for j, (a, b) in enumerate(zip(sums_a, reversed(sums_b), strict=True))), reverse=True
        )
        items = [items_a[j] + items_b[parts - 1 - j] for _, j in merged]
        sums = [s for s, _ in merged]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, items))
        tie += 1
    return heap[0][2], heap[0][3]


@lru_cache(maxsize=1)
def text_ids(tokenizer_path: str, ranks_path: str, pattern: str) -> "TextIds":
    """One for each worker, which the tasks that it runs share."""
    return TextIds(tokenizer_path, ranks_path, pattern)


class TextIds:
    """Ids of whole texts under a byte-level BPE, those that ``tokenizers`` gives for the vocabulary.

    Within a text, a single space between other characters always starts a new unit of
    this vocabulary's splitting pattern, so ids are found and remembered for each stretch between
    spaces. Texts with other white space beside a space, or with a special token's
    string, are encoded whole.
    """

    _odd = re.compile(r"\s | \s|^ | $")

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.tokenizer_path = tokenizer_path
        with open(tokenizer_path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """Made by the first text with a special token's string; few workers meet one."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_path)

    def __call__(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit integers of the machine's byte order."""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self._odd.search(text):
            return array("I", self.encode(text)).tobytes()
        first, *chunks = text.split(" ")
        known = self.known
        if len(known) > CHUNK_CACHE:
            known.clear()
        for chunk in chunks:
            if chunk not in known:
                known[chunk] = array("I", self.encode(" " + chunk)).tobytes()
        return array("I", self.encode(first)).tobytes() + b"".join(map(known.__getitem__, chunks))


class Packer:
    """Packs documents as they come; ``add`` and ``finish`` yield pieces placed in windows."""

    def __init__(self, window: int, parts: int, piece: int, slack: int, first_sequence: int):
        self.window, self.parts, self.piece, self.slack = window, parts, piece, slack
        self.next_sequence = first_sequence
        self.waiting: list[tuple[object, np.ndarray, int, int]] = []  # (doc_id, ids, start, end)
        self.tokens = 0

    def _place(self, pieces: list[tuple[object, np.ndarray, int, int]]) -> Iterator[tuple]:
        at = 0
        for doc_id, ids, start, end in pieces:
            yield doc_id, start, end - start, ids[start:end].tobytes(), len(ids), self.next_sequence, at
            at += end - start
        self.next_sequence += 1

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield from self._place([(doc_id, ids, start, start + self.window)])
        if whole < len(ids):
            self.waiting.append((doc_id, ids, whole, len(ids)))
            self.tokens += len(ids) - whole
        goal = self.parts * (self.window - self.slack)
        while self.tokens >= goal:
            yield from self._batch(goal)

    def _take(self, tokens: int) -> list[tuple[object, np.ndarray, int, int]]:
        """The first ``tokens`` waiting ids, leaving the others."""
        taken, left = [], tokens
        for i, (doc_id, ids, start, end) in enumerate(self.waiting):
            stop = min(end, start + left)
            taken.append((doc_id, ids, start, stop))
            left -= stop - start
            if not left:
                self.waiting = ([(doc_id, ids, stop, end)] if stop < end else []) + self.waiting[i + 1 :]
                break
        self.tokens -= tokens
        return taken

    def _split(self, stretches: list[tuple[object, np.ndarray, int, int]], fine: int = 0) -> list[tuple[object, np.ndarray, int, int]]:
        """Pieces of at most ``piece`` ids; those of the last ``fine`` ids have ``small`` at most, which fill what the others leave uneven."""
        coarse = sum(end - start for _, _, start, end in stretches) - fine
        pieces = []
        for doc_id, ids, start, end in stretches:
            at = start
            while at < end:
                step = min(self.piece, coarse) if coarse > 0 else max(1, self.piece // 16)
                stop = min(end, at + step)
                pieces.append((doc_id, ids, at, stop))
                coarse -= stop - at
                at = stop
        return pieces

    def _spread(self, stretches: list, parts: int) -> tuple[list, list[int], list[list[int]]]:
        """(pieces, sums, groups): with whole documents as far as their windows hold them, else with more and more of the ids in small pieces."""
        tokens = sum(end - start for _, _, start, end in stretches)
        for share in (0, 8, 4, 2):
            pieces = self._split(stretches, tokens // share if share else 0)
            sums, groups = difference([e - s for _, _, s, e in pieces], parts)
            if sums[0] <= self.window:
                break
        return pieces, sums, groups

    def _batch(self, goal: int) -> Iterator[tuple]:
        stretches = self._take(goal)
        for _ in range(3):
            pieces = self._split(stretches)
            sums, groups = difference([e - s for _, _, s, e in pieces], self.parts)
            over = sums[0] - self.window
            if over <= 0:
                yield from self._windows(pieces, sums, groups)
                return
            if over > 2 * self.slack:  # too much to leave out
                break
            stretches = self._give_back(stretches, self.parts * (over + 1))
        # pieces are made anew: what was given back must not be in them
        yield from self._windows(*self._spread(stretches, self.parts))

    def _give_back(self, stretches: list, tokens: int) -> list:
        """Return the last ``tokens`` ids to the waiting ones."""
        back = []
        while tokens and stretches:
            doc_id, ids, start, end = stretches.pop()
            cut = max(start, end - tokens)
            back.append((doc_id, ids, cut, end))
            tokens -= end - cut
            self.tokens += end - cut
            if cut > start:
                stretches.append((doc_id, ids, start, cut))
        self.waiting = back[::-1] + self.waiting
        return stretches

    def _windows(self, pieces: list, sums: list[int], groups: list[list[int]]) -> Iterator[tuple]:
        parts = len(groups)
        while sums[0] > self.window:
            parts += 1
            sums, groups = difference([e - s for _, _, s, e in pieces], parts)
        for group in groups:
            if group:
                yield from self._place([pieces[i] for i in sorted(group)])

    def finish(self) -> Iterator[tuple]:
        if self.tokens:
            tokens = self.tokens
            yield from self._windows(*self._spread(self._take(tokens), -(-tokens // self.window)))


def pack_windows(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    window: int = 2048,
    end_id: int = 1,
    parts: int = 8,
    piece: int = 256,
    slack: int = 8,
) -> DataFrame:
    """Cut every document's ids, closed by ``end_id``, into windows of at most ``window``.

    ``docs`` needs doc_id and text; other columns are left out. Returns one row for each
    piece: doc_id, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the closing id), sequence_id, offset (in the
    sequence, gapless from 0). Each id is in one piece. A null or empty text is its
    closing id alone. Rows that repeat a doc_id are packed one by one; a null doc_id
    stays null. A task ends with at most one batch of its documents' remainders, so
    padding beyond about ``slack`` ids a window is less than one window a task.
    ``tokenizer_path`` and ``ranks_path`` are two files of the same vocabulary, which
    executors must be able to open.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        ids_of = text_ids(tokenizer_path, ranks_path, pattern)
        packer = Packer(window, parts, piece, slack, (context.partitionId() if context else 0) << 33)
        close = np.array([end_id], dtype="<u4")
        out: list[tuple] = []
        schema = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
                schema = pa.schema(list(zip(names, kinds, strict=True)))
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.frombuffer(ids_of(text.as_py() or ""), dtype=np.uint32).astype("<u4", copy=False)
                out.extend(packer.add(doc_id.as_py(), np.concatenate([ids, close])))
                if len(out) >= 2000:
                    yield flush()
        out.extend(packer.finish())
        if out:
            yield flush()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(pack, _SCHEMA.format(id_type=id_type))
