"""Each operator against a brute-force version, held-out labels or its own bounds, on the smallest tables."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from arcwright.llm import queries as Q
from arcwright.llm.language_id import ByteGru
from arcwright.llm.line_runs import dedup_lines
from arcwright.llm.ngram_join import _blocks, bands_for, jaccard_pairs, near_classes
from arcwright.llm.shingles import shingle_sets, word_hashes
from arcwright.llm.window_pack import difference
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()


def test_banding_reaches_its_recall():
    bands, rows = bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 96


def test_hashes_do_not_depend_on_the_batch():
    texts = ["a b c d e f g", "", "x", None, "ä ö ü ß é", "a b c d e f g", "w" * 3_000_000 + " b c d e f"]
    alone = [shingle_sets([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets(texts)] == alone
    assert list(map(len, alone)) == [3, 0, 1, 0, 1, 3, 2]
    assert len(word_hashes(b" a\t\nb ")[0]) == 2


@pytest.mark.parametrize(("chunk", "chunk_grams"), [(4, 10**6), (512, 10**6), (512, 300)])
def test_near_copies_match_brute_force(spark, chunk, chunk_grams):
    rng = np.random.RandomState(4)
    base = [f"w{i}" for i in rng.randint(0, 5000, 120)]
    texts = []
    for i in range(60):
        words = list(base) if i < 45 else [f"v{i}x{j}" for j in range(50)]
        for at in rng.randint(0, len(words), rng.randint(0, 5)):
            words[at] = f"z{rng.randint(10**6)}"
        texts.append(" ".join(words))
    texts += texts[:5]
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts]
    links, lead = [0] * len(texts), list(range(len(texts)))

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    pairs = set()
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 - 1e-12:
                links[i] += 1
                links[j] += 1
                pairs.add(frozenset((sets[i], sets[j])))
                a, b = top(i), top(j)
                lead[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_classes(df, chunk=chunk, chunk_grams=chunk_grams).collect()}
    assert got == {i: (top(i), links[i]) for i in range(len(texts))}
    assert jaccard_pairs(df, chunk=chunk, chunk_grams=chunk_grams).count() == len([p for p in pairs if len(p) == 2])


def _tree_shard(key, regions):
    def draw(child, weight):
        bits = int(hashlib.md5(f"{key}|{child}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / weight

    r = min(range(regions), key=lambda r: draw(f"region:{r}", 8.0 if r < 5 else 1.0))
    if r == 5:
        return 40
    k = min(range(2), key=lambda k: draw(f"rack:{r}/{k}", 4.0))
    return min(range((r * 2 + k) * 4, (r * 2 + k) * 4 + 4), key=lambda s: draw(f"shard:{s}", 1.0))


def test_shards_match_the_rule(spark, documents):
    out = {r["doc_id"]: r for r in Q.op2_hash_tree_shards(spark, SF).collect()}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        r = out[i]
        assert (r["shard"], r["grown_shard"]) == (_tree_shard(str(i), 5), _tree_shard(str(i), 6))
        assert r["grown_shard"] in (r["shard"], 40)
        assert (r["size"], r["text_crc32"]) == (len((text or "").encode()) + 16, zlib.crc32((text or "").encode()))


def test_gradients_by_differences():
    model = ByteGru.fresh(["a", "b", "c"], 3, 5, 1)
    for group in (model.tables, model.loops, model.heads):
        group[:] = [g.astype(float) for g in group]
    model.bias = model.bias.astype(float)
    x = np.random.RandomState(0).randint(97, 101, (4, 5)).astype(np.uint8)
    mask, gold = np.ones((4, 5), bool), np.array([0, 1, 2, 1])
    mask[0, 3:] = False
    for p, g in zip(model.parameters(), model.gradients(x, mask, gold)[1], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = p[at]
        p[at] = kept + 1e-4
        up = model.gradients(x, mask, gold)[0]
        p[at] = kept - 1e-4
        down = model.gradients(x, mask, gold)[0]
        p[at] = kept
        assert abs((up - down) / 2e-4 - g[at]) < 1e-3 * max(1, abs(g[at])) + 1e-4


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op3_byte_gru(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95


def test_lines_match_the_plain_rule(spark, documents):
    holders = defaultdict(set)
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= 3}
    want = {}
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        want[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    df = spark.createDataFrame(documents)
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(df, min_docs=3, batches=batches, fanout=fanout).collect()}
        assert got == want


def test_differencing_is_nearly_equal():
    rng = np.random.RandomState(2)
    sizes = rng.randint(1, 257, 80).tolist()
    sums, groups = difference(sizes, 8)
    assert sorted(i for g in groups for i in g) == list(range(80)) and sums == [sum(sizes[i] for i in g) for g in groups]
    assert sums[0] - sums[-1] < 40
    assert difference([], 3) == ([0, 0, 0], [[], [], []]) and difference([5], 2)[0] == [5, 0]


def test_padding_is_little(spark):
    out = Q.op6_window_pack(spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    sums = [r["n"] for r in out]
    assert max(sums) <= 2048 and sum(2048 - n for n in sums if n & (n - 1)) / sum(sums) < 0.02


def test_neighbours_are_found(spark):
    v = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hits = total = 0
    got = defaultdict(set)
    for r in Q.op7_collision_ann(spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert abs(r["score"] - np.sqrt(((v[r["query_id"]] - v[r["vec_id"]]) ** 2).sum())) < 1e-12
    for q in (i for i in v if i % 100 == 0):
        d = sorted((np.sqrt(((v[q] - v[i]) ** 2).sum()), i) for i in v if i != q)[:10]
        hits += len(got[q] & {i for _, i in d})
        total += 10
    assert hits / total >= 0.9


def test_articles_are_exact(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op8_dom_model(spark, SF).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.DOTALL).group(1)
        blocks = [re.sub(r"[ \t\n\x0b\x0c\r]+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip(" ") for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_other_layouts_are_read():
    from arcwright.llm.dom import parse
    from arcwright.llm.page_content import Forest, _in_main, example_pages, fit_content_model

    learned = fit_content_model([(d := parse(p), _in_main(d, True)) for p, _ in example_pages(200, 17)])
    wrong = total = 0
    for page, _ in example_pages(100, 4321):
        dom = parse(page)
        y = _in_main(dom, True)
        said = learned.marginals(Forest.of([dom], learned.index))[0] >= 0.5
        texts = [i for i, t in enumerate(dom.tags) if t == "#text" and dom.texts[i].strip()]
        total += len(texts)
        wrong += sum(said[i] != y[i] for i in texts)
    assert wrong / total < 0.03


def test_marginals_match_enumeration():
    from arcwright.llm.dom import parse
    from arcwright.llm.page_content import ContentModel, Forest, _edge_kind, features

    dom = parse("<div><p>a b</p><b>c</b></div>")
    names = sorted({f for own in features(dom) for f in own})
    rng = np.random.RandomState(0)
    model = ContentModel({f: i for i, f in enumerate(names)}, rng.randn(len(names)), rng.randn(4, 2, 2))
    n = len(dom.tags)
    own = [sum(model.weights[model.index[f]] for f in fs) for fs in features(dom)]
    total, ones = 0.0, np.zeros(n)
    for state in range(2**n):
        s = [(state >> i) & 1 for i in range(n)]
        w = math.exp(sum(own[i] * s[i] for i in range(n)) + sum(model.pair[_edge_kind(dom, i), s[dom.parents[i]], s[i]] for i in range(1, n)))
        total += w
        ones += w * np.array(s)
    assert np.allclose(model.marginals(Forest.of([dom], model.index))[0], ones / total)


@pytest.mark.parametrize("least_g", [0.0, 1.5])
def test_kneser_ney_by_hand(least_g):
    """Against the formulas written out, and every history's probabilities sum to 1 over all words and the unseen one."""
    from collections import Counter

    from arcwright.llm.toxicity import KneserNey

    docs = [("a b c a", 0), ("a b d", 0), ("b b a", 0), ("c d e f", 0), ("x a x b", 1), ("x a b", 1), ("e x x", 1)]
    pairs, words, sizes = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for text, c in docs:
        ws = text.split()
        pairs[c].update(set(zip(["", *ws], ws)))
        words[c].update(set(ws))
        sizes[c] += 1
    model = KneserNey(pairs, words, tuple(sizes), least_g)
    vocabulary = sorted(set(words[0]) | set(words[1]))
    for c in (0, 1):
        for h in ["", *vocabulary, "never"]:
            assert abs(sum(model.probability(c, h, w) for w in [*vocabulary, "never"]) - 1) < 1e-9
    if least_g:
        assert 0 < len(model.told) < len(vocabulary)
    else:
        after = [Counter(w for _, w in pairs[c]) for c in (0, 1)]
        rate = lambda k: list(k.values()).count(1) / (list(k.values()).count(1) + 2 * list(k.values()).count(2)) if 1 in k.values() else 0.5
        for c in (0, 1):
            d1, n1 = rate(after[c]), sum(after[c].values())
            word = {w: max(after[c][w] - d1, 0) / n1 + d1 * len(after[c]) / n1 * (after[0][w] + after[1][w]) / (sum(after[0].values()) + sum(after[1].values()) + 1) for w in vocabulary}
            d2 = rate(pairs[c])
            for h in ["", *vocabulary]:
                own = {w: n for (g, w), n in pairs[c].items() if g == h}
                for w in {w for k in (0, 1) for (g, w) in pairs[k] if g == h}:
                    want = max(own.get(w, 0) - d2, 0) / sum(own.values()) + d2 * len(own) / sum(own.values()) * word[w] if own else word[w]
                    assert abs(model.probability(c, h, w) - want) < 1e-12
    for text, _ in docs:
        ws = text.split()
        want = sum(math.log(model.probability(1, h, w)) - math.log(model.probability(0, h, w)) for h, w in zip(["", *ws], ws))
        assert abs(model.compare(ws) - want) < 1e-9


def test_toxicity_of_held_out_documents(spark):
    """The query itself, on the middle tables: few clean documents are marked, most toxic ones are."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op9_kneser_ney(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p for p, y in held if y == 0) <= 1 and sum(p for p, y in held if y == 1) >= 0.6 * sum(y for _, y in held)


def test_toxic_documents_are_caught():
    from arcwright.llm.toxicity import fit_models

    rng = np.random.RandomState(6)
    word = lambda: "".join(rng.choice(list("aeioklmnrst"), rng.randint(2, 7)))

    def doc(toxic):
        words = [word() for _ in range(rng.randint(60, 400))]
        for i in range(len(words)):
            if toxic and rng.rand() < 0.02:
                words[i] = rng.choice(["vilwort", "badwurd", "nastix"])
        return " ".join(words)

    train = [(doc(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    test = [(doc(i % 2 == 0), i % 2 == 0) for i in range(200)]
    model = fit_models(train, 0.2)
    scores = model.scores([t for t, _ in test])
    said = scores >= 0.7
    truth = np.array([any(w in t for w in ("vilwort", "badwurd", "nastix")) for t, _ in test])
    assert (said[~truth]).sum() == 0 and said[truth].mean() > 0.9


def test_a_group_of_long_texts_is_cut_by_its_grams(spark):
    rng = np.random.RandomState(8)
    base = [f"w{i}" for i in rng.randint(0, 10**6, 20_000)]
    rows = [(i, " ".join([*base[:at], f"z{i}", *base[at + 1 :]])) for i, at in enumerate(rng.randint(0, 20_000, 24).tolist())]
    rows += [(100 + i, " ".join(f"v{i}x{j}" for j in range(50))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, _, blocks = _blocks(df, 5, 0.8, 0.999, 96, 512, 100_000)
    most = blocks.groupBy("lead", "i", "j").agg(F.sum(F.octet_length("grams") / 8).alias("n"), F.count(F.lit(1)).alias("k")).agg(F.max("n").alias("n"), F.max("k").alias("k")).first()
    assert most["k"] < 24 and most["n"] < 400_000  # all 24 hold 480,000
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_classes(df, chunk_grams=100_000).collect()}
    assert got == {i: (0, 23) for i in range(24)} | {100 + i: (100 + i, 0) for i in range(5)}


def test_mix_and_top_k_match_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in Q.ORACLES.items():
        got = Q.QUERIES[name](spark, SF).toPandas()
        want = c.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        plain = lambda x: None if x is None or x != x else x
        a, b = (sorted((tuple(map(plain, r)) for r in d[cols].to_numpy(object).tolist()), key=repr) for d in (got, want))
        assert a == b, name
