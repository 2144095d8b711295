"""Each stage of the pipeline against a plain version, one after the other, and the whole of it."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from arcwright.llm.language_id import least_sure_score, train_byte_gru
from arcwright.llm.queries import ORACLES, TOKENIZER
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="the tables are not here")
WHITE = " \t\n\x0b\x0c\r"


def plain(df):
    return [r.asDict() for r in df.collect()]


def same(a, b):
    order = lambda rows: sorted((tuple(sorted(r.items())) for r in rows), key=repr)
    return order(a) == order(b)


def language(docs, model, limit):
    out = []
    for d in docs:
        (name,), (score,) = model.documents([d["text"]])
        if name != "und" and score >= limit:
            out.append(d)
    return out


def lines(docs):
    key = lambda line: line.strip(WHITE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for d in docs:
        for line in d["text"].split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d["doc_id"])
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    out = []
    for d in docs:
        kept = [x for x in d["text"].split("\n") if keeper.get(key(x), d["doc_id"]) == d["doc_id"]]
        text = "\n".join(kept)
        if text == d["text"]:
            out.append(d)
        elif text:
            out.append({**d, "text": text, "n_chars": len(text)})
    return out


def near_copies(docs):
    def grams(text):
        words = "".join(c if c not in WHITE else " " for c in text.lower()).split(" ")
        words = [w for w in words if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {(d,)}

    sets = []
    for d in docs:
        sets.append(grams(d["text"]))
    lead = list(range(len(docs)))

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared / (len(sets[i]) + len(sets[j]) - shared) >= 0.8 - 1e-12:
                a, b = sorted((top(i), top(j)), key=lambda k: docs[k]["doc_id"])
                lead[b] = a
    return [d for i, d in enumerate(docs) if top(i) == i]


def mixture(docs):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    documents = pd.DataFrame(docs)  # noqa: F841
    taken = {r[0]: (r[1], r[4]) for r in c.execute(ORACLES["op5_source_mix"]).fetchall()}
    out = []
    for d in docs:
        size, words = taken[d["doc_id"]]
        while words > 0:
            if words >= size:
                out.append(d)
            else:
                text, left, inside = "", words, False
                for ch in d["text"]:
                    if ch not in WHITE and not inside:
                        left -= 1
                        if left < 0:
                            break
                    inside = ch not in WHITE
                    text += ch
                text = text.rstrip(WHITE)
                out.append({**d, "text": text, "n_chars": len(text)})
            words -= size
    return out


def pieces_by_document(rows):
    out = Counter()
    for r in rows:
        out[r["doc_id"], r["doc_tokens"]] += r["length"]
    return out


def test_stages_match_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("mine"), "n_lines": F.lit("mine"), "lang_pred": F.col("lang"), "rest": F.lit(7)})
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train_byte_gru(start, ~held)
    limit = least_sure_score(start.where(held), model)
    docs = plain(start)
    assert {zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d in docs} == {True, False}
    table = start
    for name, want in (("language", lambda d: language(d, model, limit)), ("lines", lines), ("near copies", near_copies), ("mixture", mixture)):
        got = stages[name](spark, table, SF)
        assert got.columns == start.columns
        rows = plain(got)
        docs = want(docs)
        assert same(rows, docs), name
        got.write.parquet(str(tmp_path / name.replace(" ", "-")))
        table = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    packed = plain(stages["packing"](spark, table, SF))
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = Counter()
    for d in docs:
        n = len(whole.encode(d["text"], add_special_tokens=False).ids) + 1
        want[d["doc_id"], n] += n
    assert pieces_by_document(packed) == want
    assert pieces_by_document(plain(corpus_pipeline.run(spark, SF))) == want, "the whole of it gives what its stages give"


def test_a_score_limit_needs_more_wrong_than_right(spark, monkeypatch):
    from arcwright.llm import language_id

    said = lambda df, model: df.withColumns({"lang_pred": F.lit("en"), "score": F.col("text").cast("double")})
    monkeypatch.setattr(language_id, "identify_languages", said)
    texts = [("0.30", "de")] * 8 + [("0.35", "en"), ("0.40", "de"), ("0.41", "de")] + [("0.8", "en")] * 40 + [("0.95", "de")] * 3 + [("0.2", None), (None, "en")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert least_sure_score(df, None) == pytest.approx(0.411), "below it ten of eleven are wrong"
    assert least_sure_score(df.where("lang = 'en'"), None) == 0.0 and least_sure_score(df.where("false"), None) == 0.0
    assert least_sure_score(df.where("doc_id in (0, 1, 2) or lang = 'en'"), None) == 0.0, "three wrong ones are no evidence"
