"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from arcwright.llm import queries as Q
from arcwright.llm.collision_ann import nearest_vectors
from arcwright.llm import language_id
from arcwright.llm.language_id import identify_languages, train_byte_gru
from arcwright.llm.line_runs import dedup_lines
from arcwright.llm.metric_tree import top_inner_products
from arcwright.llm.ngram_join import near_classes, one_of_each_class
from arcwright.llm.page_content import extract_content, train_page_content
from arcwright.llm.shard_tree import HashTree, shard_of, shard_rows, slots
from arcwright.llm.source_mix import mix_sources, mixed_documents
from arcwright.llm.toxicity import score_toxicity, train_toxicity
from arcwright.llm.window_pack import pack_windows
from pyspark.sql import functions as F

CLASHES = "row string, hash string, size string, score string, key string, node string, id string, text_id string, found string, toxic string, taken string, lines string, `drop` string, words string, own string, _id string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def rows():
    texts = [
        (1, "der Hund und die Katze liegen auf dem Sofa", "de", "a"),
        (1, "der Hund und die Katze liegen auf dem Sofa", "de", "a"),
        (2, "", "de", None),
        (3, None, None, "b"),
        (4, "1234 !! ??", "en", "b"),
        (5, "the dog and the cat are lying on the sofa", "en", "c"),
        (6, "the dog and the cat are lying on the sofa", "en", "c"),
        (7, LONG, "en", "c"),
        (None, "a text of a row without an id", "en", "a"),
        (None, None, None, None),
        (8, "  \n\n  the dog and the cat are lying on the sofa \n x", "en", "c"),
        (8, "another text under the same id, with other words in it", "en", "d"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, *["x"] * len(CLASHES.split(","))) for i, t, lang, s in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def pack(df):
    return pack_windows(df, public_tokenizers.path(Q.TOKENIZER), public_tokenizers.path(Q.RANKS), Q.PATTERN)


def test_shards(docs, none):
    tree = HashTree.even(40)
    out = shard_rows(docs, tree, tree.with_region("5", {40: 1.0})).collect()
    assert len(out) == len(rows())
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    nulls = [r for r in out if r["doc_id"] is None]
    assert {r["size"] for r in nulls} == {16, 16 + len("a text of a row without an id")} and len({r["shard"] for r in nulls}) == 1
    assert {r["text_crc32"] for r in out if r["doc_id"] in (2, 3)} == {0}
    assert next(r for r in out if r["doc_id"] == 5)["text_crc32"] == zlib.crc32(b"the dog and the cat are lying on the sofa")
    assert shard_rows(none, tree).count() == 0


def test_slots_do_not_depend_on_the_layout(spark):
    ids = spark.range(1000).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") / 400).cast("int")).alias("text"))
    tree = HashTree.even(4, regions=1, racks=1)
    placed = shard_of(ids, F.col("doc_id").cast("string"), tree, "shard")
    want = None
    for rows in (placed, placed.repartition(3), placed.orderBy(F.desc("doc_id")).coalesce(1)):
        got = sorted(map(tuple, slots(rows, "shard", ["doc_id", "text"], 50).collect()), key=repr)
        assert want in (None, got)
        want = got
    by = {}
    for *_, shard, slot in want:
        by.setdefault(shard, []).append(slot)
    assert len(want) == 1000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_line_dedup_takes_ids_that_are_no_numbers(spark):
    line = "a line of forty characters or more, which is in all of them"
    rows = [(f"d{i:04d}", f"{line}\nown {i}") for i in range(300)] + [(None, line)]
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out["d0299"] == (f"{line}\nown 299", 0) and all(out[f"d{i:04d}"] == (f"own {i}", 1) for i in range(299)) and out[None] == ("", 1)


def test_weight_changes_stay_in_their_subtree(spark):
    regions = {str(r): {str(k): {(r * 2 + k) * 4 + s: 1.0 for s in range(4)} for k in range(2)} for r in range(3)}
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = {r["doc_id"]: r["shard"] for r in shard_rows(ids, HashTree.of(regions)).collect()}
    regions["1"]["0"][9] = 3.0
    after = {r["doc_id"]: r["shard"] for r in shard_rows(ids, HashTree.of(regions)).collect()}
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(b // 8 == 1 for _, b in moved), "rows only move into the region that gained weight"
    assert all(b // 4 == 2 for a, b in moved if a // 8 == 1), "and within it only into the rack that did"
    share = sum(s == 9 for s in after.values()) / len(after)
    assert abs(share - 3 / 26) < 0.02


def test_languages(docs, none):
    model = train_byte_gru(docs, F.lit(True), steps=30)
    out = identify_languages(docs, model)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in out.collect()}
    for k in ((2, ""), (3, None), (4, "1234 !! ??"), (None, None)):
        assert got[k] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values()) and got[7, LONG][0] in ("de", "en")
    assert identify_languages(none, model).count() == 0
    nothing = train_byte_gru(none, F.lit(True))
    assert {r["lang_pred"] for r in identify_languages(docs, nothing).collect()} == {"und"}


def test_lines(docs, none, spark):
    out = dedup_lines(docs)
    assert out.count() == len(rows()) and set(docs.columns) < set(out.columns)
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert got[2, ""] == (1, 0) and got[3, None] == (1, 0)
    assert dedup_lines(none).count() == 0
    long = "  A line that is long enough to count as repeated text \t"
    many = spark.createDataFrame([(i, f"{long}\nown {i}\n{long.lower()}") for i in range(6)] + [(0, f"{long}\nown 0\n{long.lower()}")], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"], r["n_dropped"]) for r in dedup_lines(many, batches=3).collect()}
    assert kept == {(i, f"own {i}", 2) for i in range(5)} | {(5, f"{long}\nown 5\n{long.lower()}", 0)}


def test_near_copies(docs, none):
    out = near_classes(docs).collect()
    assert len(out) == len(rows())
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["n_links"], r["class_id"]), 0)
    assert (5, 2, 5) in by and (6, 2, 5) in by and (8, 2, 5) in by and (1, 1, 1) in by and (2, 0, 2) in by and (3, 0, 3) in by
    assert near_classes(none).count() == 0
    kept = one_of_each_class(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert sum(i[1] == 1 for i in ids) == 1 and not any(i[1] == 6 for i in ids) and sum(i[1] == 8 for i in ids) >= 1
    assert one_of_each_class(none).count() == 0


def test_mixture(docs, none):
    out = mix_sources(docs).collect()
    assert len(out) == len(rows())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by = {}
    for r in out:
        s = by.setdefault(r["source"], [r["target"], 0, 0])
        s[1] += r["taken"]
        s[2] += 1
    assert all(t - n <= taken <= t for t, taken, n in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - sum(r["size"] for r in out)) < 1e-6
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in out)
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    out = pack(docs).collect()
    whole = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    wanted = sorted(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t, *_ in rows())
    pieces, windows = {}, {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(len(b) for ps in pieces.values() for _, b in ps) == sum(map(len, wanted))
    assert b"".join(b for _, b in sorted(pieces[7, len(whole.encode(LONG).ids) + 1])) in wanted
    assert pack(none).count() == 0


@pytest.mark.parametrize("sizes", [[n] for n in (2, 3, 64, 129, 205, 206, 228, 229, 230, 231, 232, 256, 257, 342, 410, 512, 513, 683, 1023, 1025, 1366, 2047, 2049, 2100)] + [[2030, 30], [700, 1], [1500, 600, 3]])
def test_runs_of_alike_documents_are_packed_once(sizes):
    from arcwright.llm.window_pack import Packer

    packer = Packer(window=2048, parts=8, piece=256, slack=8, first_sequence=0)
    n = max(200, 80_000 // sum(sizes))
    docs = {i: np.arange(sizes[i % len(sizes)], dtype="<u4") + 7 * i for i in range(n)}
    out = [p for i, ids in docs.items() for p in packer.add(i, ids)] + list(packer.finish())
    got = {}
    for doc_id, start, length, data, total, *_ in sorted(out, key=lambda p: (p[0], p[1])):
        assert start == len(got.setdefault(doc_id, b"")) // 4 and len(data) == 4 * length and total == len(docs[doc_id])
        got[doc_id] += data
    assert got == {i: ids.tobytes() for i, ids in docs.items()}, "each id is in one piece"
    filled = {}
    for _, _, length, _, _, sequence, offset in out:
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + length
    assert max(filled.values()) <= 2048
    tokens = sum(map(len, docs.values()))
    assert len(filled) * 2048 - tokens < 0.02 * tokens + 2048, "little padding but for the last window"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_documents_come_back_from_their_pieces(spark, sf):
    from tokenizers import Tokenizer

    folder = f"/root/testdata/{sf}"
    whole = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    pieces = {}
    for r in pack(spark.read.parquet(f"{folder}/documents.parquet")).orderBy("doc_id", "start").collect():
        ids = pieces.setdefault(r["doc_id"], [])
        assert r["start"] == len(ids) and len(r["ids"]) == 4 * r["length"]
        ids += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert pieces == {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs}


def test_ids_are_those_of_the_tokenizer():
    from arcwright.llm.window_pack import TextIds
    from tokenizers import Tokenizer

    ids = TextIds(public_tokenizers.path(Q.TOKENIZER), public_tokenizers.path(Q.RANKS), Q.PATTERN)
    whole = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    for t in ("a  b", " a", "a ", "a\n b", "a \nb", "it's we'll <|endoftext|> x", "ä ö ü  z", "1 22 333.4 !?", "\t", "x" * 3000, "日本 語 😀 ok"):
        assert np.frombuffer(ids(t), np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = train_toxicity(docs, labels, F.lit(True))
    out = score_toxicity(docs, model).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert score_toxicity(none, model).count() == 0
    empty = train_toxicity(docs, labels.where("false"), F.lit(True))
    assert {r["predicted"] for r in score_toxicity(docs, empty).collect()} == {0}


@pytest.mark.parametrize("long_chars", [60_000, 1_500_000])
def test_a_long_text_leaves_the_others_in_the_sample(spark, long_chars):
    rng = np.random.RandomState(3)
    prose = lambda i: " ".join(f"w{k}" for k in rng.randint(0, 400, 120)) + (" vilwort badwurd" if i % 2 else "")
    first = {r["t"]: r["i"] for r in spark.range(160).select(F.col("id").alias("i"), (F.col("id") % 2).alias("t")).groupBy("t").agg(F.min_by("i", F.xxhash64("i")).alias("i")).collect()}
    texts = [(i, (f"long{i} words{i} " * (long_chars // 11 + 1) if i in first.values() else "") + prose(i)) for i in range(160)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.range(160).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    model = train_toxicity(df, labels, F.lit(True), sample_chars=1_000_000)
    short = score_toxicity(df.where(F.length("text") < 10_000), model).collect()
    assert len(short) == 158 and all(r["predicted"] == r["doc_id"] % 2 for r in short)
    alone = train_toxicity(df.where(F.col("doc_id").isin(*first.values()) | (F.col("doc_id") % 2 == 0)), labels, F.lit(True), sample_chars=50_000)
    assert alone.weights[-1] > -30, "a class of one long text has a sample all the same"


VECTORS = "vec_id long, embedding array<float>, label int, v string, dim string, block string"


def vectors():
    rng = np.random.RandomState(1)
    good = [(i, [float(x) for x in rng.randn(8)]) for i in range(0, 300)]
    copies = [(i, good[7][1]) for i in range(300, 400)]
    odd = [(400, None), (500, []), (600, [0.0] * 8), (700, [1.0, None] + [0.0] * 6), (800, [float("nan")] * 8), (900, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (7, good[7][1]), (1000, [1.0, 2.0])]
    return [(i, v, 0, "x", "x", "x") for i, v in good + copies + odd]


@pytest.mark.parametrize("block", [64, 4096])
def test_vector_searches(spark, block):
    df = spark.createDataFrame(vectors(), VECTORS)
    found = nearest_vectors(df, F.col("vec_id") % 100 == 0, k=10, block_rows=block, query_rows=50).collect()
    tops = top_inner_products(df, F.col("vec_id") % 50 == 0, k=5, page=4, block_rows=block, query_rows=50).collect()
    clean = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in vectors()[:400]]
    clean.append(clean[7])  # its id and vector twice: two rows
    hits = total = 0
    for q in range(0, 400, 100):
        d = sorted((float(np.sqrt(((clean[q][1] - v) ** 2).sum())), i) for at, (i, v) in enumerate(clean) if at != q)[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((clean[q][1] - clean[i][1]) ** 2).sum())) < 1e-12 for _, i, s in got)
        hits += len({i for _, i in d} & {i for _, i, _ in got})
        total += len({i for _, i in d})
    assert hits / total >= 0.9
    clean.append((600, np.zeros(8)))
    f = [(i, np.floor(256 * v).astype(int)) for i, v in clean]
    for q in [*range(0, 400, 50), len(f) - 1]:
        want = sorted((-int(f[q][1] @ v), i) for at, (i, v) in enumerate(f) if at != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(tops, key=lambda r: r["rank"]) if r["query_id"] == f[q][0]] == want
    assert not [r for r in tops if r["query_id"] == 1000], "no other vector of its dimension"
    empty = df.where("false")
    assert nearest_vectors(empty, F.col("vec_id") % 100 == 0).count() == 0 and top_inner_products(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_rows_that_repeat_an_id_are_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    top = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_inner_products(df, F.col("vec_id") == 0).collect())
    assert top == [(0, 1, 1, 65536)] * 2 + [(0, 2, 0, 0)] * 2
    near = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest_vectors(df, F.col("vec_id") == 0).collect())
    assert near == [(0, 1, 1, 1.0)] * 2 + [(0, 2, 0, 2**0.5)] * 2


@pytest.mark.parametrize("spread,most", [(1.0, 1.0), (0.05, 0.2)])
def test_tree_of_many_levels_is_exact_and_prunes(spread, most):
    from arcwright.llm.metric_tree import MTree

    rng = np.random.RandomState(5)
    whole = np.floor(256 * (rng.randn(20, 12)[rng.randint(0, 20, 3000)] + spread * rng.randn(3000, 12)))
    scale = 2.0 ** np.ceil(np.log2(np.abs(whole).max()))
    square = ((whole / scale) ** 2).sum(axis=1)
    points = np.c_[whole / scale, np.sqrt(square.max() - square)]
    tree = MTree(8, 3, scale, square.max())
    index = tree.build(points, 5)
    depth = {0: 0}
    for page in range(len(index["leaf"])):
        begin, end = index["spans"][page]
        inside = index["entries"][begin:end]
        held = index["points"][inside] if index["leaf"][page] else index["centers"][inside]
        away = np.sqrt(((held - index["centers"][page]) ** 2).sum(axis=1))
        assert np.allclose(away, index["to_center"][begin:end]), "entries keep their distance to the page's center"
        if not index["leaf"][page]:
            depth |= {int(p): depth[page] + 1 for p in inside}
    assert max(depth.values()) >= 3
    asked = np.arange(0, 3000, 60)
    rows, numbers, scores, scored = tree.search_counted(index, tree.as_queries(points[asked]), asked, 5, np.full(len(asked), np.nan))
    for i, q in enumerate(asked):
        want = sorted((-int(whole[q] @ whole[j]), j) for j in range(3000) if j != q)[:5]
        assert [(-s, n) for s, n in zip(scores[rows == i], numbers[rows == i])] == want
    assert scored <= most * len(asked) * 3000
    late = tree.search(index, tree.as_queries(points[asked]), asked, 5, scores.reshape(-1, 5)[:, -1].astype(float))
    assert (late[2] == scores).all(), "a bound that others reached loses nothing as good"


def test_huge_components_are_exact(spark):
    df = spark.createDataFrame([(0, [1e9, -3e9]), (1, [2e9, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in top_inner_products(df, F.col("vec_id") == 0).collect()}
    assert got == {1: min(2**63 - 1, 256 * 10**9 * 512 * 10**9 - 256 * 3 * 10**9 * 256), 2: 256 * 10**9 * 256 - 256 * 3 * 10**9 * 256}


def test_pages(spark):
    html = "<body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One  two.<br>three <b>fo</b>ur.</p><script>x</script></article><footer>&copy; us</footer></body>"
    df = spark.createDataFrame([(1, "u", html, "x"), (1, "u", html, "x"), (2, None, None, None), (None, "", "", None), (3, "v", "plain < text", "")], "page_id long, url string, html string, row string")
    model = train_page_content(df)
    out = extract_content(df, model).collect()
    assert len(out) == 5
    by = [(r["page_id"], r["text"], r["n_chars"]) for r in out]
    want = "A & B One two. three four."
    assert by.count((1, want, len(want))) == 2 and (2, "", 0) in by and (None, "", 0) in by
    assert extract_content(df.where("false"), model).count() == 0


@pytest.mark.parametrize(
    "odd,said",
    [
        ("<p>One two <svg class='i' viewBox='0 0 1 1'/>three.</p>", "One two three."),
        ("<p>One <math/>two three.</p>", "One two three."),
        ("<p>One two <svg><g><path d='M0'/></g></svg>three.<svg><style/></svg></p>", "One two three."),
        ("<p>Let (<math><mi>x</mi><mo>=</mo><mn>2</mn></math>) be.</p>", "Let (x=2) be."),
        ("<noscript><p>One two three.</p></noscript>", "One two three."),
        *[(f"<p>One {tag}two three.</p>", "One two three.") for tag in ("<svg>", "<math>", "<noscript>", "<template>", "<select>", "<iframe src='x'>", "<textarea>")],
        ("<p>One <b><svg><g></b>two three.</p>", "One two three."),
        ("<script>x = '<p>'</script><style>p {}</style><p>One two three.</p>", "One two three."),
    ],
)
def test_odd_elements_lose_no_text(odd, said):
    from arcwright.llm.dom import parse

    tail = "<p>Four five, six.</p></article><footer>the end</footer></body>"
    dom = parse(f"<body><article><h1>Head</h1>{odd}{tail}")
    at = {}
    for i, tag in enumerate(dom.tags):
        if tag == "#text":
            up, p = [], dom.parents[i]
            while p >= 0:
                up.append(dom.tags[p])
                p = dom.parents[p]
            part = "article" if "article" in up else "footer"
            at.setdefault((part, dom.blocks[i]), []).append((dom.texts[i], up))
    blocks = {k: "".join(t for t, _ in v) for k, v in at.items()}
    assert [t for (part, _), t in blocks.items() if part == "article"] == ["Head", said, "Four five, six."]
    assert [t for (part, _), t in blocks.items() if part == "footer"] == ["the end"]
    last = next(up for v in at.values() for t, up in v if t == "Four five, six.")
    assert last == ["p", "article", "body", "#root"], "what has no end tag ends with its parent"


@pytest.mark.parametrize(
    "page,said",
    [
        ("<p>One <a title=\"it's>link</a> two.</p>", "One link two."),
        ("<p>One <a title=\"it's>link</a> two <b class=\"x\">three</b>.</p>", "One link two three."),
        ("<p>One <a title='a > b' data-x=\"1 < 2\">link</a>.</p>", "One link."),
        ("<p>One <a ' href=x>link</a>.</p>", "One link."),
        ("<p>1 < 2 and a <- b <", "1 < 2 and a <- b <"),
        ("<p>One <!-- not > this --> two <!DOCTYPE x> three <?php x ?>.</p>", "One  two  three ."),
        ("<p>One</b></i></div></x> two.</p>", "One two."),
        ("<select><div>x</select>y", "xy"),
        ("<script>if (a</b) '</scripts>'</SCRIPT >after", "after"),
        ("<script>never closed <p>x", ""),
    ],
)
def test_broken_markup(page, said):
    from arcwright.llm.dom import parse

    dom = parse(page)
    assert "".join(dom.texts) == said


@pytest.mark.parametrize(
    "page",
    [
        "<" + "a" * 400_000 + " '",
        "<a title='" * 40_000,
        '<a title="x>' * 40_000,
        "<a b='c\"" * 40_000,
        "<b>" * 40_000 + "</i>" * 40_000,
        "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000 + "<p>" * 40_000,
        "<div>" * 20_000 + "x" + "</div>" * 20_000,
        "<script>" + "</" * 100_000,
        "<" * 200_000,
        "<!--" * 100_000,
        "<a " + "class=\"" * 50_001 + ">x",
    ],
)
def test_huge_broken_markup_takes_no_long(page):
    import time

    from arcwright.llm.dom import parse
    from arcwright.llm.page_content import features

    start = time.process_time()
    features(parse(page))
    assert time.process_time() - start < 10


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(name, stage, spark, docs, none):
    out = stage(spark, docs, "")
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns
    out.collect()
    assert stage(spark, none, "").count() == 0


def test_a_shard_of_equal_rows_is_dealt_to_buckets(spark):
    from arcwright.llm.shard_tree import slots

    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(16).alias("size"), (F.col("id") % 2).alias("shard")).repartition(3)
    out = slots(rows, "shard", ["doc_id", "size"], bucket_rows=100)
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(s, i) for s in (0, 1) for i in range(1500)]


def test_a_filter_on_the_language_does_not_run_the_network_again(spark):
    docs = spark.range(8).selectExpr("id AS doc_id", "'ein Text' AS text", "'de' AS lang")
    said = identify_languages(docs, language_id.ByteGru.fresh(["de", "en"], 8, 64, 5)).where("lang_pred <> 'und'").groupBy("lang_pred").agg(F.sum("score"))
    assert said._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
