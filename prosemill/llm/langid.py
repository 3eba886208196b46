"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: how likely each language makes the text (byte trigrams), the language that
the markup declares, the suffix of the address, and a prior for the host. All but the first are learnt from the corpus by
grouped sums of the text's own verdicts. The host's prior is smoothed towards its domain's and that towards the whole
corpus's, so a host with few pages leans on what is around it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import workers, written

#: Most texts that the text model is learnt from; bins of trigrams; trigrams that a text's evidence counts as at most.
ROWS, BINS, WEIGHT = 8_000, 1 << 15, 60
#: Weights of the level above in a smoothed prior, and of one in a likelihood.
DOMAIN_PRIOR, HOST_PRIOR, ONE = 20.0, 20.0, 1.0
#: Least trigrams of letters for a verdict.
LEAST = 1
#: Most hosts whose priors are broadcast; more are joined.
HOSTS = 20_000

HIDDEN = re.compile(r"<(?:(script|style|head|template|noscript)\b|!--)", re.I)
TAGS = re.compile(r"<[^>]*>")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def visible(page: str) -> str:
    """The text of a page without hidden elements and tags. What is opened and never closed hides nothing; that a closing mark
    doesn't come any more is remembered, so a page is read once for each kind of mark."""
    parts, at, gone = [], 0, set()
    while m := HIDDEN.search(page, at):
        mark = (m[1] or "!--").lower()
        end = None if mark in gone else re.compile("-->" if mark == "!--" else rf"</{mark}\s*>", re.I).search(page, m.end())
        if end is None:
            gone.add(mark)
        parts += [page[at : m.start() if end else m.end()], " " if end else ""]
        at = end.end() if end else m.end()
    rest = "".join([*parts, page[at:]])
    last = rest.rfind(">") + 1
    return entities.unescape(TAGS.sub(" ", rest[:last]) + rest[last:])


def trigrams(text: str) -> np.ndarray:
    """Bins of a text's byte trigrams, lower case, of which at least two bytes belong to letters."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    ok = _LETTER[raw]
    few = ok.astype(np.uint8)
    keep = (few[:-2] + few[1:-1] + few[2:]) >= 2
    x = np.where(ok, raw, 32).astype(np.uint32)
    found = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    return ((found * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15)).astype(np.int64)[keep]


class TextModel:
    """Log probabilities of trigram bins by language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def evidence(self, text: str) -> tuple[int, list[float]]:
        """The number of trigrams, and each language's log likelihood, as if of at most WEIGHT of them."""
        found = trigrams(text)
        if not len(found):
            return 0, [0.0] * len(self.languages)
        return len(found), (self.table[:, found].mean(1, dtype=np.float64) * min(len(found), WEIGHT)).tolist()


def learn_text(docs: DataFrame, rows: int = ROWS) -> TextModel:
    """A text model of docs (doc_id, text, lang), from at most rows labelled rows, those of the least id hashes."""
    spark = workers(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("l")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("i"), "l")
    # A repeated id gives one text, the least, so that the bound holds.
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l"))).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if lang not in sums:
                    sums[lang] = np.zeros(BINS, np.int64)
                # A text counts by the square root of what it has, so that long ones don't rule.
                sums[lang] += np.ceil(np.sqrt(np.bincount(trigrams(text or ""), minlength=BINS))).astype(np.int64)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": s[at]})

    # Languages x bins sums at most.
    got = sample.mapInPandas(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    table = np.full((len(languages), BINS), 0.5)
    for i, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        table[i, own["bin"].to_numpy()] += own["n"].to_numpy()
    return TextModel(languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def with_evidence(rows: DataFrame, model: TextModel, text: str, page: str | None = None) -> DataFrame:
    """rows with n_trigrams and loglik, read from the column text, or from the visible text of the column page where text is
    null."""
    workers(rows.sparkSession)

    @F.pandas_udf("n int, loglik array<double>")
    def made(texts: pd.Series, pages: pd.Series) -> pd.DataFrame:
        got = [model.evidence(t if t is not None else visible(p) if p is not None else "") for t, p in zip(texts, pages)]
        return pd.DataFrame({"n": [g[0] for g in got], "loglik": [g[1] for g in got]})

    out = rows.withColumn("__e", made(F.col(text), F.col(page) if page else F.lit(None).cast("string")))
    return out.withColumn("n_trigrams", F.col("__e.n")).withColumn("loglik", F.col("__e.loglik")).drop("__e")


def url_parts(url: Column) -> dict[str, Column]:
    """host, domain (its last two labels) and suffix (its last) of an address; null where it has no host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(F.length(host) > 0, host)
    labels = F.split(host, r"\.")
    last, before = F.element_at(labels, -1), F.get(labels, F.size(labels) - 2)
    domain = F.when(F.size(labels) == 1, host).when((last != "") & (before != ""), F.concat_ws(".", before, last)).otherwise("")
    return {"host": host, "domain": F.when(host.isNotNull(), domain), "suffix": last}


def declared_language(page: Column) -> Column:
    """The primary language that a page's first html tag declares, in lower case; null without one."""
    tag = F.regexp_extract(page, r"(?is)<html\b[^>]*+", 0)
    found = F.lower(F.regexp_extract(tag, r"""(?is)\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    return F.when(F.length(found) > 0, found)


def _shares(sums: DataFrame, name: str, n: int) -> DataFrame:
    return sums.groupBy(name).agg(*[F.sum(F.col(f"v{i}")).alias(f"s{i}") for i in range(n)])


def _array(prefix: str, n: int) -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(n)])


def fused(rows: DataFrame, evidence: DataFrame, languages: list[str]) -> DataFrame:
    """rows with posterior array and n_trigrams from their own evidence columns (n_trigrams, loglik, host, domain, suffix,
    declared), the weights of the other kinds being learnt from evidence, a table of the same columns.

    Nulls of host, suffix or declared are no evidence. Host priors are broadcast if there are at most HOSTS, else joined.
    """
    n = len(languages)
    best = F.when(F.col("n_trigrams") >= LEAST, F.array_position("loglik", F.array_max("loglik")) - 1)
    votes = evidence.withColumn("v", best).filter("v is not null").select("host", "domain", "suffix", "declared", *[F.when(F.col("v") == i, 1.0).otherwise(0.0).alias(f"v{i}") for i in range(n)])
    votes = written(votes.groupBy("host", "domain", "suffix", "declared").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(n)]), "votes")
    whole = votes.agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0.0)).alias(f"v{i}") for i in range(n)]).first()
    total = sum(whole) + n
    base = [(whole[i] + 1) / total for i in range(n)]
    log_base = F.array(*[F.lit(float(np.log(b))) for b in base])

    def likelihood(name: str) -> DataFrame:
        """log P(value | language), smoothed by the value's share of all."""
        s = _shares(votes.filter(F.col(name).isNotNull()), name, n)
        every = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
        return s.select(F.col(name).alias(f"k_{name}"), F.array(*[F.log((F.col(f"s{i}") + ONE * every / (sum(whole) + 1.0)) / F.lit(whole[i] + ONE)) for i in range(n)]).alias(f"l_{name}"))

    domains = _shares(votes.filter("domain is not null"), "domain", n).withColumnRenamed("domain", "d_domain")
    d_total = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    domains = domains.select("d_domain", *[((F.col(f"s{i}") + DOMAIN_PRIOR * base[i]) / (d_total + DOMAIN_PRIOR)).alias(f"d{i}") for i in range(n)])
    hosts = votes.filter("host is not null").groupBy("host").agg(F.min("domain").alias("h_domain"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(n)])
    hosts = hosts.join(domains, F.col("h_domain") == F.col("d_domain"), "left")
    hosts = hosts.select(F.col("host").alias("h_host"), F.array(*[F.log((F.col(f"s{i}") + HOST_PRIOR * F.coalesce(F.col(f"d{i}"), F.lit(base[i]))) / (d_total + HOST_PRIOR)) for i in range(n)]).alias("l_host"))
    out, sizes = rows, votes.agg(*[F.count_distinct(k).alias(k) for k in ("host", "suffix", "declared")]).first()
    for name, part in (("host", hosts), *((k, likelihood(k)) for k in ("suffix", "declared"))):
        part = written(part, f"by-{name}", sizes[name])
        key = part.columns[0]
        out = out.join(F.broadcast(part) if sizes[name] <= HOSTS else part, F.col(name) == F.col(key), "left").drop(key)
    none = F.array(*[F.lit(0.0)] * n)
    terms = [F.col("loglik"), F.coalesce("l_host", log_base), F.coalesce("l_suffix", none), F.coalesce("l_declared", none)]
    score = F.array(*[sum((t[i] for t in terms), F.lit(0.0)) for i in range(n)])
    out = out.withColumn("score", score).withColumn("score", F.transform("score", lambda s: F.exp(s - F.array_max("score"))))
    whole_score = F.aggregate("score", F.lit(0.0), lambda a, s: a + s)
    return out.withColumn("posterior", F.transform("score", lambda s: s / whole_score)).drop("score", "l_host", "l_suffix", "l_declared")


def verdict(rows: DataFrame, languages: list[str], least: float) -> DataFrame:
    """rows of fused with lang (null where fewer than LEAST trigrams speak), confidence and accepted."""
    top = F.array_max("posterior")
    lang = F.element_at(F.array(*map(F.lit, languages)), F.array_position("posterior", top).cast("int"))
    spoken = F.col("n_trigrams") >= LEAST
    return rows.withColumn("guess", F.when(spoken, lang)).withColumn("confidence", F.when(spoken, top).otherwise(0.0)).withColumn("accepted", F.col("confidence") >= least)


def identify(docs: DataFrame, pages: DataFrame, least: float = 0.6, rows: int = ROWS) -> DataFrame:
    """Rows (doc_id, page_id, host, declared, lang, confidence, accepted) for docs (doc_id, text, lang, source) and pages
    (page_id, url, html) together; the id of the other table is null.

    A document's host is its source; it has no markup and no suffix. Its lang column serves to learn the text model, on a
    bounded sample, and is no evidence. lang is null and accepted false where a text has next to no letters. Null texts and
    pages count as empty, null sources and addresses give no host, repeated rows stay. Without labelled documents nothing can
    be named. An empty table gives an empty result; other columns are ignored.
    """
    model = learn_text(docs, rows)
    url = url_parts(F.col("url"))
    nothing = F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("source").alias("host"), F.col("source").alias("domain"), nothing.alias("suffix"), nothing.alias("declared"), F.coalesce("text", F.lit("")).alias("text"), nothing.alias("html"))
    p = pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), *[c.alias(k) for k, c in url.items()], declared_language(F.col("html")).alias("declared"), nothing.alias("text"), F.col("html"))
    if not model.languages:
        return d.unionByName(p).select("doc_id", "page_id", "host", "declared", nothing.alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    made = written(with_evidence(d.unionByName(p), model, "text", "html").drop("text", "html"), "evidence")
    out = verdict(fused(made, made, model.languages), model.languages, least)
    return out.select("doc_id", "page_id", "host", "declared", F.col("guess").alias("lang"), "confidence", "accepted")


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None, least: float = 0.6, rows: int = ROWS) -> DataFrame:
    """docs whose language is found with a posterior of at least least and is one of languages (default: any that the labels
    know), with their own columns. docs: doc_id, text, lang, source."""
    model = learn_text(docs, rows)
    if not model.languages:
        return docs.limit(0)
    nothing = F.lit(None).cast("string")
    names = {"host": F.col("source"), "domain": F.col("source"), "suffix": nothing, "declared": nothing}
    learnt = written(with_evidence(docs.select(F.coalesce("text", F.lit("")).alias("text"), *[c.alias(k) for k, c in names.items()]), model, "text").drop("text"), "evidence")
    # The documents' own columns travel in one, so that no name clashes.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(k) for k, c in names.items()])
    out = verdict(fused(with_evidence(own, model, "text").drop("text"), learnt, model.languages), model.languages, least)
    return out.filter(F.col("accepted") & F.col("guess").isin(*(languages or model.languages))).select("__row.*")
