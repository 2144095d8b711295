"""The corpus operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collision_ann import nearest_vectors
from .collocations import collocations
from .common import bound_batches, table
from .language_id import identify_languages, train_byte_gru
from .line_runs import dedup_lines
from .metric_tree import top_inner_products
from .ngram_join import near_classes
from .page_content import extract_content, train_page_content
from .progressive_centroids import cluster_vectors
from .shard_tree import HashTree, shard_rows
from .source_mix import mix_sources
from .toxicity import score_toxicity, train_toxicity
from .url_rules import ListRule, judge_urls, label_urls, train_url_rules
from .window_pack import pack_windows

#: Two files of one vocabulary, and the pattern that splits text before its merges (fixed values).
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = HashTree.even(40, regions=5, racks=2)
    return shard_rows(table(spark, sf_dir, "documents"), tree, tree.with_region("5", {40: 1.0}))


def _fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op3_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    found = identify_languages(docs.select("doc_id", "text"), train_byte_gru(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_window_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_windows(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), PATTERN)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_content(pages.select("page_id", "url", "html"), train_page_content(pages))
    return found.select("page_id", "url", "text", "n_chars")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"))


def op10_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_hadamard_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


#: The list of the URL query (fixed values).
URL_LIST = [ListRule("allow", "org", "/"), ListRule("block", "example.org", "/es/"), ListRule("block", "example.org", "/en/1"), ListRule("allow", "com", "/fr/"), ListRule("block", "com", "/de/")]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_LIST, train_url_rules(label_urls(pages, URL_LIST))).select("page_id", "host", "path", "rule", "verdict")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _program(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": _program(op1_ngram_join),
    "op2_hash_tree_shards": op2_hash_tree_shards,
    "op3_byte_gru": _program(op3_byte_gru),
    "op4_line_runs": op4_line_runs,
    "op5_source_mix": op5_source_mix,
    "op6_window_pack": _program(op6_window_pack),
    "op7_collision_ann": op7_collision_ann,
    "op8_dom_model": _program(op8_dom_model),
    "op9_kneser_ney": _program(op9_kneser_ney),
    "op10_metric_tree": op10_metric_tree,
    "op11_hadamard_centroids": op11_hadamard_centroids,
    "op12_url_rules": op12_url_rules,
    "op13_collocations": _program(op13_collocations),
}

_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

def _centroid_sql() -> str:
    """The query of operator 11 as SQL: three rounds and a last assignment, spelt out."""
    out = """
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rn, vec_id, embedding AS e, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        c0 AS MATERIALIZED (SELECT k, v AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS k, v FROM kept) WHERE k < 16)"""
    for i in range(4):
        out += f""",
        a{i} AS MATERIALIZED (
            SELECT rn, arg_min(k, (d, k)) AS k, min(d) AS d
            FROM (SELECT rn, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, c{i}) GROUP BY rn
        )"""
        if i < 3:
            out += f""",
        m{i + 1} AS (
            SELECT k, list(m ORDER BY i) AS c FROM (
                SELECT k, i, (s - (((s % n) + n) % n)) // n AS m
                FROM (SELECT a.k, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM kept JOIN a{i} a USING (rn), (SELECT unnest(range(1, 65)) AS i) GROUP BY a.k, i)
            ) GROUP BY k
        ),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i + 1}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i + 1} ON c{i}.k = m{i + 1}.k)"""
    return out + """
        SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a3 a JOIN kept USING (rn) JOIN c3 ON c3.k = a.k
    """


ORACLES: dict[str, str] = {
    "op10_metric_tree": """
        WITH ok AS (
            SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.rn, q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM ok q JOIN ok c ON q.rn <> c.rn AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op4_line_runs": f"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs
        ),
        keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ),
        heavy AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5
        ),
        marked AS (
            SELECT keyed.*, heavy.k IS NOT NULL AND keyed.doc_id <> heavy.keeper AS gone
            FROM keyed LEFT JOIN heavy ON keyed.k = heavy.k
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op5_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
            FROM documents
        ),
        totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight,
                   3.0::DOUBLE * source_size AS most
            FROM totals
        ),
        filled AS (
            SELECT *, row_number() OVER w AS nth,
                   coalesce((sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0)::BIGINT AS full_before,
                   (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_after,
                   (sum(source_size) OVER ())::BIGINT AS all_words
            FROM ranked WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST)
        ),
        levels AS (SELECT *, (all_words - 3.0::DOUBLE * full_before) / weight_after AS level FROM filled),
        settled AS (SELECT nth AS first_nth, level AS at_level FROM levels WHERE level * weight <= most ORDER BY nth LIMIT 1),
        targets AS (
            SELECT source, source_size,
                   (CASE WHEN nth >= first_nth THEN at_level * weight ELSE most END)::DOUBLE AS target
            FROM levels, settled
        ),
        budgets AS (
            SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS times,
                   floor(target)::BIGINT % greatest(source_size, 1) AS rest
            FROM targets
        ),
        placed AS (
            SELECT s.*, (sum(size) OVER (PARTITION BY source ORDER BY hash RANGE UNBOUNDED PRECEDING))::BIGINT AS upto,
                   (sum(size) OVER (PARTITION BY source, hash))::BIGINT AS share
            FROM sized s
        )
        SELECT doc_id, size, source_size, target,
               (times * size + CASE WHEN upto <= rest THEN size
                    WHEN upto - share < rest THEN ((rest - upto + share) * size) // share ELSE 0 END)::BIGINT AS taken
        FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
    """,
    "op11_hadamard_centroids": _centroid_sql(),
    "op12_url_rules": r"""
        WITH cutup AS (
            SELECT row_number() OVER () AS rn, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        parted AS (
            SELECT rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(rest, '(?s)^[^#]*#(.*)', 1) AS fragment
            FROM cutup
        ),
        rules(verdict, h, p) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ),
        fitting AS (
            SELECT rn, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS listed
            FROM parted JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY rn
        ),
        urls AS MATERIALIZED (
            SELECT a.*, f.rule, f.listed, list_distinct(list_concat(
                list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
                list_transform(list_filter(string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'p:' || x),
                list_transform(list_filter(string_split_regex(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'q:' || x),
                list_transform(list_filter(string_split_regex(translate(fragment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'f:' || x)
            )) AS tokens
            FROM parted a LEFT JOIN fitting f USING (rn)
        ),
        totals AS (
            SELECT count(*) AS n, count(*) FILTER (WHERE listed = 'allow') AS na, count(*) FILTER (WHERE listed = 'block') AS nb, greatest(5, ceil(0.002::DOUBLE * count(*)))::BIGINT AS least
            FROM urls WHERE listed IS NOT NULL
        ),
        each AS (SELECT rn, listed, unnest(tokens) AS token FROM urls WHERE listed IS NOT NULL),
        known AS (SELECT token, count(*) AS k, count(*) FILTER (WHERE listed = 'block') AS b FROM each GROUP BY token HAVING count(*) >= (SELECT least FROM totals)),
        chosen AS (
            SELECT rn, any_value(listed) AS listed, list(token ORDER BY apart DESC, token)[1:10] AS ts
            FROM (SELECT e.*, abs(b * na - (k - b) * nb) AS apart FROM each e JOIN known USING (token), totals) GROUP BY rn
        ),
        places AS (SELECT rn, listed, list_sort(ts) AS ts FROM chosen),
        combos AS (
            SELECT listed, [x.t] AS c FROM (SELECT listed, unnest(ts) AS t FROM places) x
            UNION ALL SELECT listed, [ts[i], ts[j]] FROM places, range(1, 11) a(i), range(1, 11) b(j) WHERE i < j AND j <= len(ts)
            UNION ALL SELECT listed, [ts[i], ts[j], ts[k]] FROM places, range(1, 11) a(i), range(1, 11) b(j), range(1, 11) c(k) WHERE i < j AND j < k AND k <= len(ts)
        ),
        mined AS (
            SELECT c, verdict, freq, base, row_number() OVER (ORDER BY freq::DOUBLE / base DESC, freq DESC, len(c), array_to_string(c, ' '), verdict) AS nth
            FROM (SELECT c, count(*) AS base FROM combos GROUP BY c)
            JOIN (SELECT c, listed AS verdict, count(*) AS freq FROM combos GROUP BY c, listed) USING (c), totals
            WHERE freq >= least AND base >= least AND freq::DOUBLE / base >= 0.8
        ),
        matched AS (SELECT rn, arg_min(m.verdict, nth) AS verdict FROM urls JOIN mined m ON list_has_all(tokens, c) WHERE listed IS NULL GROUP BY rn)
        SELECT page_id, host, path, rule, coalesce(listed, m.verdict, CASE WHEN nb > na THEN 'block' ELSE 'allow' END) AS verdict
        FROM urls LEFT JOIN matched m USING (rn), totals
    """,
    "op13_collocations": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ),
        pieces AS (SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p, generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS i FROM docs),
        words AS (SELECT d, i, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
        spans AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS s FROM words WHERE len(ws) > 0),
        totals AS (SELECT lang, count(*)::BIGINT AS n FROM spans GROUP BY lang),
        grams AS (SELECT lang, m, array_to_string(ws[s : s + m - 1], ' ') AS phrase FROM spans, (SELECT unnest(range(1, 6)) AS m) WHERE s + m - 1 <= len(ws)),
        f AS (SELECT lang, m, phrase, count(*)::BIGINT AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
        cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS parts FROM f WHERE m >= 2),
        covered AS (
            SELECT lang, array_to_string(parts[1 : m - 1], ' ') AS phrase, a FROM cand WHERE m > 2
            UNION SELECT lang, array_to_string(parts[2 : m], ' '), a FROM cand WHERE m > 2
        ),
        kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = c.lang AND v.phrase = c.phrase AND v.a = c.a)),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
        scored AS (
            SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, k, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(parts[1 : k], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(parts[k + 1 : c.m], ' ') JOIN totals t ON t.lang = c.lang
        ),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
}
