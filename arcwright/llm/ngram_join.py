"""N-gram Jaccard join by MinHash banding.

1. Each text's set of word n-grams gets a 128-bit key and a MinHash signature in
   bands. Texts with the same set are one node.
2. Nodes meet on band hashes. A bucket's smallest node is its lead, and the buckets
   of one lead make a candidate group, so any two nodes that share a band meet in
   a group, and a bucket of any size gives as many rows as it has nodes. Two
   nodes may share several groups: their pair belongs to that of the smallest lead they share.
   A group whose nodes all have the same smaller lead has no pair of its own and goes.
3. A group's pairs are verified on full n-gram sets, in blocks of a bounded size: a
   large group is cut into chunks of bounded numbers of sets and of n-grams, and every two chunks meet in one task. A block
   returns its nodes' link counts and a spanning forest of its links, not the pairs.
4. The forests' connected components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, packed, unpacked
from ..operators.components import star_components
from .shingles import mix, shingle_sets

#: Nodes of a candidate group that are compared with each other, or with those of another chunk, in one task.
CHUNK = 512
#: n-grams that a chunk's sets hold on average at most (8 bytes each), beyond one set.
CHUNK_GRAMS = 500_000
#: Texts are hashed in slices of about this many characters.
SLICE = 500_000


def bands_for(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with the given probability.

    More rows a band make fewer false candidates; the most rows whose bands fit into
    ``most_hashes`` hash functions are taken.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _set_key(grams: np.ndarray) -> bytes:
    spread = mix(grams)
    a = np.add.reduce(spread, dtype=np.uint64)
    b = np.add.reduce(mix(spread ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(grams))], dtype=">u8").tobytes()


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(11)
    draw = lambda: rng.randint(0, 1 << 62, count, dtype=np.int64).astype(np.uint64)
    return (draw() << np.uint64(1)) | np.uint64(1), draw() * np.uint64(2) + np.uint64(1)


def _band_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(grams), 4096):
        values = grams[s : s + 4096, None] * a
        values += b
        np.minimum(low, values.min(axis=0), out=low)
    weights = a[:rows] ^ np.uint64(0x2545F4914F6CDD1D)
    joined = (mix(low).reshape(bands, rows) * (weights | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    return mix(joined + np.arange(bands, dtype=np.uint64)).astype(np.int64)


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_id, node, size, bands): node and bands are null for texts without words; size: n-grams of the set."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(bands * rows)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            nodes, sizes, hashes = [], [], []
            for s, e in _slices(texts):
                for grams in shingle_sets(texts[s:e], n):
                    nodes.append(_set_key(grams) if len(grams) else None)
                    sizes.append(len(grams))
                    hashes.append(_band_hashes(grams, a, b, bands, rows) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "text_id", "node", "size", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_in = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return rows_in.mapInArrow(sign, f"doc_id {kind}, text_id long, node binary, size long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, n_docs, grams) for the nodes in ``wanted`` (doc_id, text_id, node, n_docs), from the whole texts."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            grams = [g.astype("<u8").tobytes() for s, e in _slices(texts) for g in shingle_sets(texts[s:e], n)]
            kept = [batch.column("node"), batch.column("n_docs"), pa.array(grams, pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(kept, names=["node", "n_docs", "grams"])

    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_id"), "text")
    found = texts.join(wanted, texts["_id"].eqNullSafe(wanted["doc_id"]) & (texts["_text_id"] == wanted["text_id"]))
    made = found.select("node", "n_docs", "text").mapInArrow(sets, "node binary, n_docs long, grams binary")
    return made.dropDuplicates(["node"])  # rows that repeat an id and its text


class Block:
    """Two chunks of a candidate group (or one with itself): nodes, their numbers of documents, sets and leads."""

    def __init__(self, table: pa.Table):
        self.nodes = table.column("node").to_pylist()
        self.n_docs = table.column("n_docs").to_numpy()
        self.sets = [np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()]
        self.lead = table.column("lead")[0].as_py()
        self.leads = table.column("leads").to_pylist()  # in order
        self.first_is_lead = np.array([x[0] == self.lead for x in self.leads])
        part = table.column("part").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        self.left, self.right, self.same = np.flatnonzero(part == i), np.flatnonzero(part == j), i == j

    def own_pairs(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether this group's lead is the smallest one that row i shares with each of the others."""
        if self.first_is_lead[i]:
            return np.ones(len(others), bool)  # a shared lead is never smaller than a row's first
        own = set(self.leads[i])
        return np.array([self.first_is_lead[k] or min(own.intersection(self.leads[k])) == self.lead for k in others], bool)


def _linked(block: Block, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left row of a block, the right rows (row numbers) at or over the threshold whose pair with it is this group's own, and their similarities."""
    sets, right = block.sets, block.right
    if not len(block.left) or not len(right):
        return
    right = right[np.argsort([len(sets[i]) for i in right], kind="stable")]
    sizes = np.array([len(sets[i]) for i in right])
    known, codes = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(len(known) + 1, bool)
    for i in block.left:
        own = sets[i]
        lo, hi = np.searchsorted(sizes, [len(own) * threshold * (1 - 1e-9), len(own) / threshold * (1 + 1e-9)])
        if lo == hi:
            continue
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = at[known[at] == own]
        flags[at] = True
        part = flags[codes[begins[lo] : begins[hi]]]
        shared = np.add.reduceat(part, begins[lo:hi] - begins[lo], dtype=np.int64)
        flags[at] = False
        likeness = shared / (len(own) + sizes[lo:hi] - shared)
        near = np.flatnonzero(likeness >= threshold - 1e-12)
        near = near[block.own_pairs(i, right[lo + near])]
        yield i, right[lo + near], likeness[near]


def _groups(nodes: DataFrame) -> DataFrame:
    """(lead, node, leads, group_size, group_grams) of the candidate groups that have pairs of their own; nodes: (node, size, bands)."""
    placed = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    buckets = cut(placed.groupBy("band", "bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    n_placed = buckets.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()["n"]
    met = join_hot(placed, buckets, ["band", "bucket"], "k", n_placed).select("node", "size", "lead").distinct()
    members = cut(met.groupBy("node", "size").agg(F.array_sort(F.collect_set("lead")).alias("leads")))  # no more leads than bands
    each = members.select("node", "size", "leads", F.explode("leads").alias("lead"))
    first = F.col("leads")[0]
    groups = each.groupBy("lead").agg(F.count(F.lit(1)).alias("group_size"), F.sum("size").alias("group_grams"), F.min(first).alias("lo"), F.max(first).alias("hi"))
    groups = cut(groups.where("group_size > 1 AND (lo <> hi OR lo = lead)").drop("lo", "hi"))
    n_each = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    return join_hot(each.drop("size"), groups, ["lead"], "group_size", n_each)


def _blocks(docs: DataFrame, n: int, threshold: float, recall: float, most_hashes: int, chunk: int, chunk_grams: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, nodes with their number of documents, block rows: lead, i, j, node, part, leads, n_docs, grams)."""
    bands, rows = bands_for(threshold, recall, most_hashes)
    signed = cut(_signatures(docs, n, bands, rows))
    nodes = cut(
        signed.where("node IS NOT NULL").groupBy("node").agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id")).alias("first"),
            F.first("size").alias("size"),
            F.first("bands").alias("bands"),
        )
    )
    groups = cut(_groups(nodes.select("node", "size", "bands")))
    wanted = groups.select("node").distinct().join(nodes, "node").select("first.doc_id", "first.text_id", "node", "n_docs")
    parts = F.greatest(F.ceil(F.col("group_size") / F.lit(chunk)), F.ceil(F.col("group_grams") / F.lit(chunk_grams))).cast("int")
    members = groups.select("lead", "node", "leads", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = (
        members.join(_sets(docs, wanted, n), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("lead", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "part", "leads", "n_docs", "grams")
    )
    return signed, nodes.drop("bands", "size"), spread


def jaccard_pairs(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, most_hashes: int = 96, chunk: int = CHUNK, chunk_grams: int = CHUNK_GRAMS
) -> DataFrame:
    """The join itself between distinct n-gram sets: (node_a, node_b, jaccard), node_a < node_b.

    Its size is the number of links, which grows with the square of a group of near
    copies; ``near_classes`` returns classes and link counts without listing them.
    """
    _, _, blocks = _blocks(docs, n, threshold, recall, most_hashes, chunk, chunk_grams)

    def pairs(table: pa.Table) -> pa.Table:
        block = Block(table)
        nodes, out = block.nodes, []
        for a, near, likeness in _linked(block, threshold):
            out += [
                (min(nodes[a], nodes[b]), max(nodes[a], nodes[b]), float(s))
                for b, s in zip(near, likeness, strict=True)
                if (nodes[a] < nodes[b] if block.same else a != b)
            ]
        a, b, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"node_a": pa.array(a, pa.binary()), "node_b": pa.array(b, pa.binary()), "jaccard": pa.array(s, pa.float64())})

    return blocks.groupBy("lead", "i", "j").applyInArrow(pairs, "node_a binary, node_b binary, jaccard double")


def near_classes(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, most_hashes: int = 96, chunk: int = CHUNK, chunk_grams: int = CHUNK_GRAMS
) -> DataFrame:
    """Each document's class of near copies and its number of links.

    ``docs`` needs doc_id and text; other columns are left out. Texts are compared by
    the Jaccard similarity of their sets of lower-cased word n-grams; ``threshold`` and
    over is a link. Returns doc_id, text_id (a hash of the text), class_id (the smallest
    doc_id that links connect to the document), n_links (other documents linked to it,
    copies included), n_copies (documents with the same set, itself included), class_key.
    A text of fewer than n words is one n-gram; texts without words (null, empty, white
    space) have no links, and each doc_id of theirs is a class. Rows that repeat a
    doc_id are documents of their own. Pairs with no band in common are missed: at the
    threshold with probability ``1 - recall`` at most, above it less.
    """
    signed, nodes, blocks = _blocks(docs, n, threshold, recall, most_hashes, chunk, chunk_grams)

    def count(table: pa.Table) -> pa.Table:
        block = Block(table)
        nodes, n_docs = block.nodes, block.n_docs
        links = np.zeros(len(nodes), np.int64)
        lead = list(range(len(nodes)))

        def top(x: int) -> int:
            while lead[x] != x:
                lead[x] = lead[lead[x]]
                x = lead[x]
            return x

        for a, near, _ in _linked(block, threshold):
            near = near[near != a]
            links[a] += n_docs[near].sum()
            if not block.same:
                links[near] += n_docs[a]
            for b in near:
                x, y = top(a), top(int(b))
                if x != y:
                    lead[max(x, y)] = min(x, y)
        rows = [k for k in range(len(nodes)) if links[k]]
        return pa.table(
            {
                "node": pa.array([nodes[k] for k in rows], pa.binary()),
                "lead": pa.array([nodes[top(k)] for k in rows], pa.binary()),
                "links": pa.array(links[rows], pa.int64()),
            }
        )

    counted = cut(blocks.groupBy("lead", "i", "j").applyInArrow(count, "node binary, lead binary, links long"))
    classes = star_components(counted.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    info = (
        nodes.join(links, "node", "left")
        .join(classes, "node", "left")
        .select("node", "n_docs", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    smallest = info.groupBy("root").agg(F.min("first.doc_id").alias("class_id"))
    info = info.join(smallest, "root").select("node", "n_docs", "links", "class_id", F.col("root").alias("class_key"))
    return signed.select("doc_id", "text_id", "node").join(info, "node", "left").select(
        "doc_id",
        "text_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("n_docs") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_docs", F.lit(1)).cast("long").alias("n_copies"),
        "class_key",
    )


def one_of_each_class(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay when each class of near copies keeps its smallest doc_id; columns as in ``docs``.

    Of several rows with that id in one class one stays. Texts without words stay, one row for each doc_id.
    """
    near = near_classes(docs, **how).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    near = near.groupBy("doc_id", "class_key").agg(F.min("text_id").alias("text_id"))
    # keys without nulls: the join's partitions then serve the last step too, and texts move once
    key = lambda doc_id: F.coalesce(doc_id.cast("string"), F.lit("\0none"))
    near = near.select(F.col("text_id").alias("of_text"), key(F.col("doc_id")).alias("of_id"))
    rows = packed(docs).withColumns({"of_text": F.xxhash64(F.col("row")["text"]), "of_id": key(F.col("row")["doc_id"])})
    kept = rows.join(near, ["of_text", "of_id"]).dropDuplicates(["of_text", "of_id"])
    return kept.select(*unpacked(docs.columns))
