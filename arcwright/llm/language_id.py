"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads lower-cased UTF-8 bytes in stretches of a fixed length, forwards
and backwards, and labels every byte with a distribution over languages. A
document's distribution is the mean over its letters. It is trained in numpy by
backpropagation through time on stretches of a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_bound, packed, unpacked

#: Bytes of text that a task labels at a time.
BLOCK = 1 << 19
UNDETERMINED = "und"
_letter = re.compile(r"[^\W\d_]")
_is_letter = np.zeros(256, bool)
_is_letter[ord("a") : ord("z") + 1] = True
_is_letter[128:] = True


@dataclass
class ByteGru:
    """tables: per direction (3H, 256) inputs of update gate, reset gate and candidate; loops: (3H, H); heads: (C, H)."""

    languages: list[str]
    stretch: int
    tables: list[np.ndarray]
    loops: list[np.ndarray]
    heads: list[np.ndarray]
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, *self.heads, self.bias]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, stretch: int, seed: int) -> "ByteGru":
        rng = np.random.RandomState(seed)
        draw = lambda rows, cols, by: (rng.randn(rows, cols) * by).astype(np.float32)
        return cls(
            languages,
            stretch,
            [draw(3 * hidden, 256, 0.5) for _ in range(2)],
            [draw(3 * hidden, hidden, hidden**-0.5) for _ in range(2)],
            [draw(len(languages), hidden, hidden**-0.5) for _ in range(2)],
            np.zeros((len(languages), 1), np.float32),
        )

    def _run(self, way: int, steps: np.ndarray, keep: list | None) -> Iterator[tuple[int, np.ndarray]]:
        """Yield (position, state) along a direction; steps: (L, N) bytes."""
        table, loop = self.tables[way], self.loops[way]
        h = len(table) // 3
        state = np.zeros((h, steps.shape[1]), np.float32)
        order = range(len(steps)) if way == 0 else range(len(steps) - 1, -1, -1)
        for t in order:
            seen = table.take(steps[t], axis=1)
            back = loop @ state
            gates = seen[: 2 * h] + back[: 2 * h]
            gates *= 0.2
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            update, reset = gates[:h], gates[h:]
            new = np.tanh(seen[2 * h :] + reset * back[2 * h :])
            before, state = state, new + update * (state - new)
            if keep is not None:
                keep.append((t, before, update, reset, new, back[2 * h :]))
            yield t, state

    def label(self, stretches: np.ndarray) -> np.ndarray:
        """(C, L, N) probabilities for the (N, L) bytes."""
        steps = np.ascontiguousarray(stretches.T)
        out = np.empty((len(steps), len(self.languages), steps.shape[1]), np.float32)
        for t, state in self._run(0, steps, None):
            np.matmul(self.heads[0], state, out=out[t])
        for t, state in self._run(1, steps, None):
            out[t] += self.heads[1] @ state
        out += self.bias
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out.transpose(1, 0, 2)

    def gradients(self, stretches: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the masked positions, and the gradient of each parameter, through time."""
        steps = np.ascontiguousarray(stretches.T)
        states: list[dict[int, np.ndarray]] = [{}, {}]
        kept: list[list] = [[], []]
        for way in (0, 1):
            for t, state in self._run(way, steps, kept[way]):
                states[way][t] = state
        logits = np.stack([self.heads[0] @ states[0][t] + self.heads[1] @ states[1][t] + self.bias for t in range(len(steps))])
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        weight = mask.T[:, None, :].astype(np.float32) / max(1, int(mask.sum()))
        rows = np.arange(steps.shape[1])
        loss = -float((np.log(p[:, gold, rows] + 1e-9) * weight[:, 0]).sum())
        p[:, gold, rows] -= 1
        p *= weight
        tables, loops, heads = [], [], []
        for way in (0, 1):
            table, loop = self.tables[way], self.loops[way]
            h = len(table) // 3
            d_loop, d_head = np.zeros_like(loop), np.zeros_like(self.heads[way])
            inputs = np.zeros((len(steps), 3 * h, steps.shape[1]), np.float32)
            d_state = np.zeros((h, steps.shape[1]), np.float32)
            for t, before, update, reset, new, back in reversed(kept[way]):
                d_head += p[t] @ states[way][t].T
                d = d_state + self.heads[way].T @ p[t]
                d_new = d * (1 - update) * (1 - new * new)
                d_update = d * (before - new) * 0.2 * ((update > 0) & (update < 1))
                d_reset = d_new * back * 0.2 * ((reset > 0) & (reset < 1))
                inputs[t] = np.concatenate([d_update, d_reset, d_new])
                through = np.concatenate([d_update, d_reset, d_new * reset])
                d_loop += through @ before.T
                d_state = d * update + loop.T @ through
            flat = steps.ravel()
            by_unit = inputs.transpose(1, 0, 2).reshape(3 * h, -1)
            tables.append(np.stack([np.bincount(flat, unit, 256) for unit in by_unit]).astype(np.float32))
            loops.append(d_loop)
            heads.append(d_head)
        return loss, [*tables, *loops, *heads, p.sum(axis=(0, 2))[:, None]]

    def train(self, stretches: np.ndarray, mask: np.ndarray, gold: np.ndarray, steps: int, batch: int, rate: float, good: float, seed: int) -> float:
        """Adam on shuffled batches until the running loss is below ``good`` or ``steps`` are done."""
        rng = np.random.RandomState(seed)
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        running = None
        for step in range(1, steps + 1):
            pick = rng.randint(0, len(stretches), batch)
            loss, grads = self.gradients(stretches[pick], mask[pick], gold[pick])
            running = loss if running is None else 0.9 * running + 0.1 * loss
            if step > 20 and running < good:
                break
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return float(running or 0.0)

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability for each whole text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        raw = [(t or "").lower().encode("utf-8", "replace") if _letter.search(t or "") else b"" for t in texts]
        sums = np.zeros((len(self.languages), len(texts)))
        letters = np.zeros(len(texts))
        for owners, block in _blocks(raw, self.stretch):
            mask = _is_letter[block]
            p = (self.label(block) * mask.T).sum(axis=1)
            for c in range(len(self.languages)):
                sums[c] += np.bincount(owners, p[c], len(texts))
            letters += np.bincount(owners, mask.sum(axis=1), len(texts))
        pooled = sums / np.maximum(letters, 1)
        best = pooled.argmax(axis=0)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, letters, strict=True)]
        scores = [float(min(1.0, pooled[b, i])) if n else 0.0 for i, (b, n) in enumerate(zip(best, letters, strict=True))]
        return names, scores


def _stretches(raw: bytes, length: int) -> np.ndarray:
    n = -(-len(raw) // length)
    return np.frombuffer(raw.ljust(n * length), np.uint8).reshape(n, length)


def _blocks(raw: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner of each stretch, stretches), about BLOCK bytes at a time; a long text spans several."""
    owners: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    held = 0
    for i, data in enumerate(raw):
        for at in range(0, len(data), BLOCK):
            part = _stretches(data[at : at + BLOCK], length)
            owners.append(np.full(len(part), i))
            rows.append(part)
            held += part.size
            if held >= BLOCK:
                yield np.concatenate(owners), np.concatenate(rows)
                owners, rows, held = [], [], 0
    if rows:
        yield np.concatenate(owners), np.concatenate(rows)


def train_byte_gru(
    docs: DataFrame,
    usable: Column,
    sample_per_language: int = 300,
    sample_rows: int = 20_000,
    stretches_per_doc: int = 8,
    hidden: int = 8,
    stretch: int = 64,
    steps: int = 250,
    batch: int = 128,
    good: float = 0.02,
    seed: int = 5,
) -> ByteGru:
    """Fit the network on a bounded sample: of each language the ``sample_per_language`` documents with the
    smallest id hashes (fewer where all languages together would pass ``sample_rows``, but one at least), and of each
    document ``stretches_per_doc`` stretches spread over its whole text. Every language with a labelled text
    is learned. Reads text, lang and doc_id of rows where ``usable`` holds; null languages are left out. No such
    rows: a model that knows no language. Languages equally likely for a text: the first by name."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(common)
    each = max(1, min(sample_per_language, sample_rows // max(1, len(languages))))
    by_hash = Window.partitionBy("lang").orderBy("place", "doc_id")
    places = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("place"))
    # the smallest hashes lie in the lowest part of their range: some twice the sample, whatever the size of a language
    low = F.lit(False)
    if common:
        bounds = F.create_map(*[F.lit(x) for lang, n in common.items() for x in (lang, hash_bound(each, n))])
        low = F.col("place") <= F.element_at(bounds, F.col("lang"))
    chosen = places.where(low).withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= each)
    ids = F.broadcast(chosen.select("lang", "doc_id"))  # sample_rows, or one a language

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            langs, parts = [], []
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                data = text.lower().encode("utf-8", "replace")
                every = _stretches(data, stretch)
                for k in np.unique(np.linspace(0, len(every) - 1, stretches_per_doc).astype(int)) if len(every) else ():
                    langs.append(lang)
                    parts.append(every[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    sample = labelled.join(ids, ["lang", "doc_id"], "left_semi").select("lang", "text").mapInArrow(cut_out, "lang string, part binary")
    got = sorted((r["lang"], bytes(r["part"])) for r in sample.collect())
    model = ByteGru.fresh(languages, hidden, stretch, seed)
    if got and len(languages) > 1:
        data = np.frombuffer(b"".join(p for _, p in got), np.uint8).reshape(len(got), stretch)
        gold = np.array([languages.index(lang) for lang, _ in got])
        model.train(data, _is_letter[data], gold, steps, batch, 0.02, good, seed)
    return model


def identify_languages(docs: DataFrame, model: ByteGru) -> DataFrame:
    """Add lang_pred and score to ``docs`` (its own columns of these names are replaced).

    Every byte of every whole text is labelled. Texts that are null or have no letter get
    ``und`` and 0, as all texts do under a model that knows no language. Nothing is shuffled.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 10,000 numbers

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            names, scores = shared.value.documents([t if isinstance(t, str) else None for t in series])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    # a deterministic function would run again in any filter on its results, beside the first run and in a Python worker of its own
    found = packed(docs).withColumn("found", predict.asNondeterministic()(F.col("row")["text"]))
    return found.select(*unpacked(columns), "found.lang_pred", "found.score")


def least_sure_score(docs: DataFrame, model: ByteGru, steps: int = 1000) -> float:
    """The largest score below which the model is clearly wrong more often than right, on labelled documents that it hasn't learned from.

    Clearly: by more than twice the root of their number, so that a few wrong ones among the least sure reject nothing.

    ``docs``: those documents, with doc_id, text and lang; every one of them is labelled. 0 where the model is right at every score, or nothing is labelled.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").alias("true_lang"))
    said = identify_languages(labelled, model).where(F.col("lang_pred") != UNDETERMINED)
    step = F.least(F.floor(F.col("score") * steps), F.lit(steps - 1)).alias("step")
    wrong = F.sum(F.when(F.col("lang_pred") == F.col("true_lang"), -1).otherwise(1)).alias("more_wrong")
    limit, balance, n = 0.0, 0, 0
    for r in said.groupBy(step).agg(wrong, F.count(F.lit(1)).alias("n")).orderBy("step").collect():  # at most ``steps`` rows
        balance, n = balance + r["more_wrong"], n + r["n"]
        if balance > 2 * n**0.5:
            limit = (r["step"] + 1) / steps
    return limit
