"""Verdicts on URLs: lists of rules first, then association rules mined from what the lists say.

1. A list has rules of a host and a path. A rule fits its host, all subdomains and every path
   that starts with its own; the longest that fits decides, and is the URL's label.
2. Spark's FP-growth mines the token combinations of labelled URLs with their label. A
   combination and its label are a rule where enough URLs hold both (support) and
   enough of the combination's URLs have the label (confidence).
3. URLs that no list rule fits are matched by an inverted index: each mined rule stands under the rarest of
   its tokens. The rule with the highest confidence decides, the commonest label where none fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash60, join_hot, packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class ListRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlRules:
    """Mined rules, best first: (tokens, rarest token, verdict, URLs with both, URLs with the tokens); and the verdict where none fits."""

    rules: list[tuple[frozenset[str], str, str, int, int]] = field(default_factory=list)
    otherwise: str = ALLOW


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> dict[str, Column]:
    """host (A-Z in lower case), path, query and fragment; all empty for null and where there is no ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*+", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*+([^?#]*+)", 1)
    query = F.regexp_extract(rest, r"\A[^?#]*+\?([^#]*+)", 1)
    fragment = F.regexp_extract(rest, r"(?s)\A[^#]*+#(.*+)", 1)
    return {"host": _lower(host), "path": path, "query": query, "fragment": fragment}


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, with the part they stand in: labels of the host, runs of letters and digits elsewhere."""
    parts = url_parts(url)

    def named(kind: str, pieces: Column) -> Column:
        return F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))

    runs = lambda kind, part: named(kind, F.split(_lower(parts[part]), "[^a-z0-9]+"))
    return F.array_distinct(F.concat(named("h", F.split(parts["host"], r"\.")), runs("p", "path"), runs("q", "query"), runs("f", "fragment")))


def listed_rule(host: Column, path: Column, rules: list[ListRule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null if none does; of equally long ones the one with the longer host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def train_url_rules(
    labelled: DataFrame, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.8,
    most_urls: int = 500_000, most_tokens: int = 10, most_items: int = 3, most_rules: int = 50_000,
) -> UrlRules:
    """Association rules from (url, verdict) rows; other rows of the table may have a null verdict.

    Bounds of the model: about ``most_urls`` labelled rows by a hash of the URL are learnt from; of each, FP-growth sees the ``most_tokens`` frequent
    tokens that most tell the labels apart; a rule has ``most_items`` tokens at most; the ``most_rules`` best rules are kept. A
    rule needs ``min_support`` of the rows (``min_count`` at least) and ``min_confidence``. Best: higher confidence, more rows, fewer tokens, then by name.
    """
    rows = labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select("url", "verdict")
    n = rows.count()
    if n > most_urls:
        rows = rows.where(hash60(F.coalesce("url", F.lit(""))) < F.lit(int(2**60 * most_urls / n)))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "verdict", url_tokens(F.col("url")).alias("tokens")))
    said = {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}
    allowed, blocked = said.get(ALLOW, 0), said.get(BLOCK, 0)
    otherwise = BLOCK if blocked > allowed else ALLOW
    n = allowed + blocked
    least = max(min_count, -int(-(min_support * n) // 1))
    each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    known = each.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("verdict") == BLOCK).alias("b")).where(F.col("k") >= least)
    apart = F.abs(F.col("b") * F.lit(allowed) - (F.col("k") - F.col("b")) * F.lit(blocked))
    known = cut(known.select("token", "k", apart.alias("apart")))
    total = known.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return UrlRules([], otherwise)
    kept = join_hot(each, known, ["token"], "k", total).groupBy("row", "verdict").agg(F.array_sort(F.collect_list(F.struct((-F.col("apart")).alias("x"), "token"))).alias("best"))
    items = kept.select(F.concat(F.transform(F.slice("best", 1, most_tokens), lambda x: x["token"]), F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(items).freqItemsets
    is_label = lambda x: x.startswith("=")
    found = found.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"), F.get(F.filter("items", is_label), F.lit(0)).alias("label"), "freq")
    found = cut(found.where(F.size("tokens").between(1, most_items)))
    bases = found.where("label IS NULL").select("tokens", F.col("freq").alias("base"))
    mined = found.where("label IS NOT NULL").join(bases, "tokens").where(F.col("freq") / F.col("base") >= min_confidence)
    order = [F.desc(F.col("freq") / F.col("base")), F.desc("freq"), F.size("tokens"), F.concat_ws(" ", "tokens"), F.col("label")]
    got = mined.orderBy(*order).limit(most_rules).collect()
    named = {t for r in got for t in r["tokens"]}
    support = {r["token"]: r["k"] for r in known.collect() if r["token"] in named}  # tokens of min_support of the rows
    return UrlRules([(frozenset(r["tokens"]), min(r["tokens"], key=lambda t: (support[t], t)), r["label"][1:], r["freq"], r["base"]) for r in got], otherwise)


def judge_urls(df: DataFrame, rules: list[ListRule], mined: UrlRules) -> DataFrame:
    """``df``, which needs url, with host, path, rule and verdict.

    rule: the list rule that fits (host and path), else null. verdict: its verdict, else that of the best mined rule whose tokens the URL all has, else
    the model's commonest label. Null URLs and those without ``://`` have an empty host, path and no tokens. Columns of ``df`` with the new names are replaced; rows that repeat are judged alike.
    """
    index: dict[str, list[tuple[int, frozenset[str], str]]] = {}
    for i, (tokens, rarest, verdict, _, _) in enumerate(mined.rules):
        index.setdefault(rarest, []).append((i, tokens, verdict))
    shared = df.sparkSession.sparkContext.broadcast(index)  # most_rules of the model
    new = ("host", "path", "rule", "verdict")
    columns = [c for c in df.columns if c not in new]
    rows = packed(df)
    parts = url_parts(F.col("row")["url"])
    name, said = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("row", parts["host"].alias("host"), parts["path"].alias("path")).withColumns({"rule": name, "listed": said})
    tokens = F.when(F.col("rule").isNull(), url_tokens(F.col("row")["url"]))
    otherwise, n_rules = mined.otherwise, len(mined.rules)

    @F.pandas_udf("string")
    def by_index(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for own in batch:
                best, verdict = n_rules, otherwise
                have = frozenset(own) if own is not None else frozenset()
                for t in have:
                    for i, needs, says in shared.value.get(t, ()):
                        if i >= best:
                            break
                        if needs <= have:
                            best, verdict = i, says
                            break
                out.append(verdict)
            yield pd.Series(out)

    rows = rows.withColumn("mined", by_index(tokens))
    return rows.select(*unpacked(columns), "host", "path", "rule", F.coalesce("listed", "mined").alias("verdict"))


def label_urls(df: DataFrame, rules: list[ListRule]) -> DataFrame:
    """(url, verdict) of every row: what the list says, null where no rule fits."""
    parts = url_parts(F.col("url"))
    rows = df.select("url", parts["host"].alias("host"), parts["path"].alias("path"))
    return rows.select("url", listed_rule(F.col("host"), F.col("path"), rules)[1].alias("verdict"))
