"""Phrases of words that stand together more often than chance, by multikey quicksort of suffix pointers.

1. Every word of a piece of text begins a suffix, of which its first five words count. A
   task sorts the suffixes of its texts, so equal ones become one pointer with a number.
2. Suffixes are routed by their leading word. A lead that a bounded sample of texts
   shows to hold much of all suffixes (at most ``2 / SHARE`` leads of each length) is
   lengthened by one word, again and again, so no lead of a few words holds a group of
   unbounded size. The sample decides only where suffixes go, never what is counted.
3. Where they arrive, a multikey three-way quicksort deals pointers into smaller, equal and
   larger by the word at the present depth. The size of an equal partition is the number of
   its phrase, and sorting goes on one word deeper; partitions below the least frequency are
   abandoned. Leads that were lengthened are counted in several places, and these numbers are added.
4. Frequent phrases are joined with the numbers of their parts for scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bound, join_hot
from .shingles import mix

#: Longest phrase, in words.
DEPTH = 5
#: A lead with this share of the sampled suffixes, or half of it as counted in parts, is lengthened.
SHARE = 1 / 4096
#: Texts of the sample that shows such leads.
SAMPLE_TEXTS = 5_000
#: Suffixes that a task sorts on average.
GROUP_SUFFIXES = 1_000_000
#: What a language column without a value stands for.
UNKNOWN = "und"

# Bytes that end a piece become line feeds; words are what bytes.split() then leaves.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_PAD = -1


def suffixes(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, windows, counts) of some texts: the distinct windows of up to ``DEPTH`` words, in order, as places in ``words``, and how often each occurs."""
    data = b"\n".join((t or "").encode("utf-8", "replace") for t in texts).lower().translate(_ENDS)
    pieces = [p.split() for p in data.split(b"\n")]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    coded = pa.array(chain.from_iterable(pieces), pa.binary(), size=int(lengths.sum())).dictionary_encode()
    if not len(coded):
        return coded.dictionary, np.empty((0, DEPTH), np.int32), np.empty(0, np.int64)
    ids = np.asarray(coded.indices).astype(np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))  # words to the end of the piece
    padded = np.concatenate([ids, np.full(DEPTH, _PAD)])
    columns = [np.where(left > d, padded[d : d + len(ids)], _PAD) for d in range(DEPTH)]
    bits = max(1, int(len(coded.dictionary)).bit_length())
    keys, at = [], 0
    while at < DEPTH:  # as many columns in a 64-bit key as fit
        key, used = np.zeros(len(ids), np.int64), 0
        while at < DEPTH and used + bits <= 63:
            key = (key << bits) | (columns[at] + 1)
            at, used = at + 1, used + bits
        keys.append((key, used))
    order, new = _sorted_runs(keys)
    first = np.flatnonzero(new)
    windows = np.stack([c[order[first]] for c in columns], axis=1).astype(np.int32)
    return coded.dictionary, windows, np.diff(np.append(first, len(ids)))


def _sorted_runs(keys: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(order, new) that sorts rows by keys of so many bits, the first one foremost, and where in that order a row differs from the one before."""
    order = np.argsort(keys[0][0])
    ranked = keys[0][0][order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    for key, bits in keys[1:]:
        run = np.cumsum(new) - 1
        tied = np.flatnonzero(~new | np.append(~new[1:], False))  # rows that have an equal one beside them
        if not len(tied):
            break
        if bits + int(run[-1]).bit_length() <= 63:
            both = (run[tied] << bits) | key[order[tied]]
            inner = np.argsort(both)
        else:
            inner = np.lexsort((key[order[tied]], run[tied]))
        order[tied] = order[tied][inner]
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, new


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, by its two CRCs; the same in every task."""
    low = np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words))
    high = np.fromiter((zlib.adler32(w) for w in words), np.uint64, len(words))
    return mix((high << np.uint64(32)) ^ low ^ np.uint64(0x5851F42D))


def _next_leads(leads: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(leads * np.uint64(0x9E3779B97F4A7C15) + words)


def lead_hashes(lang: str, words: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Hashes of each window's leads of 1 to ``DEPTH`` words, one column a length."""
    of = np.append(_word_hashes(words), np.uint64(0x1F83D9AB))  # the last stands for no word
    lead = np.full(len(windows), _word_hashes([lang.encode()])[0], np.uint64)
    out = []
    for d in range(windows.shape[1]):
        lead = _next_leads(lead, of[windows[:, d]])
        out.append(lead)
    return np.stack(out, axis=1) if out else np.empty((len(windows), 0), np.uint64)


def routes(lang: str, words: list[bytes], windows: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the lead that each window is routed by, its words): one word, and one more as long as the lead is among ``longer`` (sorted hashes)."""
    of = np.append(_word_hashes(words), np.uint64(0x1F83D9AB))
    lead = _next_leads(np.full(len(windows), _word_hashes([lang.encode()])[0], np.uint64), of[windows[:, 0]])
    depth = np.ones(len(windows), np.int64)
    live = np.arange(len(windows))
    for d in range(1, DEPTH):
        at = np.searchsorted(longer, lead[live])
        live = live[longer[np.minimum(at, len(longer) - 1)] == lead[live]] if len(longer) else live[:0]
        if not len(live):
            break
        lead[live] = _next_leads(lead[live], of[windows[live, d]])
        depth[live] = d + 1
    return lead, depth


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str | None]]]:
    texts: dict[str, list[str | None]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    yield from texts.items()


def _long_leads(docs: DataFrame, n: int, share: float, sample_texts: int) -> np.ndarray:
    """Sorted hashes of the leads to be lengthened; n: texts in all."""
    some = docs.where(F.xxhash64("text", F.lit(5)) <= hash_bound(sample_texts, n)) if n > sample_texts else docs

    def leads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, total = [], [], 0
            for lang, texts in _by_language(batch):
                words, windows, each = suffixes(texts)
                hashes = lead_hashes(lang, words.to_pylist(), windows[:, : DEPTH - 1])
                total += int(each.sum())
                for d in range(hashes.shape[1]):
                    there = windows[:, d] != _PAD
                    key, place = np.unique(hashes[there, d], return_inverse=True)
                    keys.append(key)
                    counts.append(np.bincount(place, weights=each[there], minlength=len(key)).astype(np.int64))
            key = np.concatenate([np.zeros(1, np.uint64), *keys])
            count = np.concatenate([[total], *counts]).astype(np.int64)
            most = (count >= total * share / 2) & ((key != 0) | (np.arange(len(key)) == 0))
            yield pa.RecordBatch.from_arrays([pa.array(key[most].astype(np.int64)), pa.array(count[most])], names=["lead", "n"])

    found = cut(some.mapInArrow(leads, "lead long, n long").groupBy("lead").agg(F.sum("n").alias("n")))
    total = found.where("lead = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # of suffixes with a lead of one length no more than 2 / share leads can have this many
    rows = found.where((F.col("lead") != 0) & (F.col("n") >= total * share / 2)).select("lead").collect()
    return np.sort(np.array([r["lead"] for r in rows], np.int64).astype(np.uint64))


def pack_windows_of(lang: str, words: list[bytes], windows: np.ndarray, counts: np.ndarray, depth: np.ndarray) -> bytes:
    """Windows, their numbers and depths, with the words they use; see ``unpack_windows``."""
    used = np.unique(windows) if windows.size < len(words) // 8 else np.flatnonzero(np.bincount(windows.ravel() + 1, minlength=len(words) + 1)) - 1
    used = used[used != _PAD]
    own = [words[i] for i in used.tolist()]
    if windows.size < len(words) // 8:
        places = np.where(windows == _PAD, _PAD, np.searchsorted(used, windows))
    else:
        place = np.full(len(words) + 1, _PAD, np.int32)  # the last is picked by -1
        place[used] = np.arange(len(used))
        places = place[windows]
    kind = np.dtype("<i2" if len(own) < 1 << 15 else "<i4")
    most = int(counts.max(initial=0))
    number = np.dtype("<u1" if most < 256 else "<i8")
    name = lang.encode()
    head = np.array([len(windows), kind.itemsize, number.itemsize, len(name)], "<i8").tobytes()
    body = head + np.ascontiguousarray(places.T).astype(kind).tobytes() + counts.astype(number).tobytes() + depth.astype("<u1").tobytes()
    return zlib.compress(body + name + b"\n".join(own), 1)


def unpack_windows(blob: bytes) -> tuple[bytes, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(blob)
    n, width, number, name = np.frombuffer(data, "<i8", 4).tolist()
    at = 32
    windows = np.frombuffer(data, f"<i{width}", n * DEPTH, at).reshape(DEPTH, n).T.astype(np.int32)
    at += n * DEPTH * width
    counts = np.frombuffer(data, "<u1" if number == 1 else "<i8", n, at).astype(np.int64)
    at += n * number
    depth = np.frombuffer(data, "<u1", n, at)
    at += n
    return data[at : at + name], data[at + name :].split(b"\n"), windows, counts, depth


def multikey_counts(columns: np.ndarray, counts: np.ndarray, least: int, depth: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(pointer, length, number) of the phrases that begin ``least`` suffixes or more, by multikey three-way quicksort.

    columns: one row a suffix, its words as numbers (-1: no further word), ``counts`` its occurrences. ``depth``: how many
    words each was routed by; phrases of fewer words are returned however few they are.
    """
    depth = np.ones(len(columns), np.int64) if depth is None else depth.astype(np.int64)
    found: list[tuple[int, int, int]] = []
    todo = [(np.arange(len(columns)), 0)] if len(columns) else []
    while todo:
        own, d = todo.pop()
        if d == columns.shape[1]:
            continue
        key, weight, routed = columns[own, d], counts[own], depth[own]
        pivot = key[len(key) // 2]
        equal = key == pivot
        n = int(weight[equal].sum())
        same = own[equal]
        if pivot != _PAD and (n >= least or routed[equal][0] > d + 1):
            found.append((int(same[0]), d + 1, n))
            todo.append((same, d + 1))
        if len(same) < len(own):
            for side in (key < pivot, key > pivot):
                if side.any() and (weight[side].sum() >= least or routed[side].max() > d + 1):
                    todo.append((own[side], d))
    return found


def phrase_counts(docs: DataFrame, least: int, share: float = SHARE, sample_texts: int = SAMPLE_TEXTS, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of 1 to 5 words with ``least`` occurrences or more, and one row a lang with an empty phrase: all its words.

    docs: lang, text. Overlapping occurrences count; a phrase lies within a piece of text between ``.,;:!?`` and line ends.
    """
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    found = _long_leads(docs, size["n"], share, sample_texts)
    groups = max(1, -(-int(size["bytes"]) // (6 * group_suffixes)))  # a word and its space are six bytes or so
    leads = docs.sparkSession.sparkContext.broadcast(found)  # 2 / share for each length at most

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, blobs = [], []
            for lang, texts in _by_language(batch):
                coded, windows, counts = suffixes(texts)
                if not len(windows):
                    continue
                words = coded.to_pylist()
                lead, depth = routes(lang, words, windows, leads.value)
                place = (lead % np.uint64(groups)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                starts = np.flatnonzero(np.diff(place[order], prepend=-1))
                for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
                    some = order[s:e]
                    places.append(int(place[some[0]]))
                    blobs.append(pack_windows_of(lang, words, windows[some], counts[some], depth[some]))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(blobs, pa.binary())], names=["place", "suffixes"])

    def sort(table: pa.Table) -> pa.Table:
        langs, words, windows, counts, depth = zip(*map(unpack_windows, table.column("suffixes").to_pylist()), strict=True)
        coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
        ids, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        known = sorted(set(langs))
        parts, at = [], 0
        for lang, own, w in zip(langs, words, windows, strict=True):
            there = np.append(ids[at : at + len(own)], _PAD)  # -1 picks the last
            parts.append(np.concatenate([np.full((len(w), 1), known.index(lang)), there[w]], axis=1).astype(np.int32))
            at += len(own)
        columns, counts = np.concatenate(parts), np.concatenate(counts)
        # the language is a word before the first; all of a language's suffixes are counted, however few
        found = multikey_counts(columns, counts, least, np.concatenate(depth) + 1)
        rows = [(known[columns[p, 0]].decode(), b" ".join(names[i] for i in columns[p, 1:length]).decode(), length - 1, n) for p, length, n in found]
        lang, phrase, length, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.string()), "words": pa.array(length, pa.int32()), "f": pa.array(n, pa.int64())})

    routed = docs.mapInArrow(route, "place int, suffixes binary")
    counted = routed.groupBy("place").applyInArrow(sort, "lang string, phrase string, words int, f long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


def phrase_scores(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer phrase of the same number holds; counts: see ``phrase_counts``."""
    parts = F.split("phrase", " ")
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    longer = phrases.where("words > 2")
    head, tail = F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "), F.array_join(F.slice(parts, 2, F.size(parts)), " ")
    # a phrase of the same number two words longer makes one of the same number one word longer
    covered = longer.select("lang", F.explode(F.array(head, tail)).alias("phrase"), "a").distinct()
    kept = phrases.join(covered, ["lang", "phrase", "a"], "left_anti")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    kept = join_hot(kept, totals, ["lang"], "n", words)
    cuts = kept.select("lang", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(parts, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), " ").alias("right"))
    f = counts.select("lang", "phrase", "f")
    cuts = cuts.join(f.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"]).join(f.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
    # a * n * 1000 has 38 digits at most
    score = F.expr("(CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    cuts = cuts.withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 5 words.

    ``docs`` needs lang and text; other columns are left out. A-Z are lower-cased; a null text has no words, a null lang is
    ``und``. A phrase has a = its occurrences, ``least`` at least; of its cuts into two parts with l and r occurrences the one with the
    lowest floor(1000 * a * n / (l * r)) counts, the shorter first part among ties, where n is the number of words of the language. Phrases
    inside a longer one (of five words at most) with as many occurrences are left out. Order: score and a downwards, then the phrase by its
    bytes. Rows that repeat are texts of their own; a table without rows gives none.
    """
    scored = phrase_scores(cut(phrase_counts(docs, least, **how)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
