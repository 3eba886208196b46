"""Vocabulary of changed prose against a base corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators.rules import Context, finding, quoted, rule


def term_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): tokens of all texts, lower case; partial sums are made before the shuffle."""
    return texts.select(F.explode(T.tokens(F.col(text), T.CORPUS_TOKEN)).alias("t")).groupBy(F.lower("t").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def phrase_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): phrases of two and three words of all texts."""
    return texts.select(F.explode(T.phrases(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def base_counts(prose: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of a snapshot: of the prose of each document, its segments joined by spaces."""
    joined = prose.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", "text"))).alias("s")).select(F.array_join("s.text", " ").alias("text"))
    return term_counts(joined), phrase_counts(joined)


def novel(changed: DataFrame, base: DataFrame, least: int = 2) -> DataFrame:
    """Terms of at least least uses in changed (term, n) that base (term, n) doesn't have."""
    return changed.filter(F.col("n") >= least).join(base.filter("n > 0"), "term", "left_anti")


def excluded(raw: Column, stopwords: list[str], known: list[str]) -> Column:
    """Tokens that are never novel: identifiers, addresses, the profile's and project's terms, stopwords, short ones."""
    low = F.lower(raw)
    return T.is_identifier(raw) | T.is_url_or_path(raw) | low.isin(stopwords + known) | (F.length(low) < 3)


@rule("CORPUS_NOVELTY")
def corpus_novelty(ctx: Context) -> DataFrame:
    """A document's first use of each novel term and phrase; nothing without a comparison.

    ctx.comparison: revision, and tables base_terms, base_phrases, change_terms, change_phrases (term, n).
    """
    c, p = ctx.comparison, ctx.profile
    rule_id = "CORE.CORPUS_NOVELTY"
    stop = p.words("corpus_novelty_stopword")
    known = sorted({t for e in [*p.dictionary["entries"], *p.terms] if p.resolve_term(t := e["term"].lower())})
    prose = ctx.prose if c else ctx.prose.limit(0)
    tokens = prose.select("doc_id", "source", "seg_no", *[F.col(x) for x in ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")], F.posexplode(T.tokens(F.col("text"), T.CORPUS_TOKEN)).alias("pos", "raw"))
    tokens = tokens.filter(~excluded(F.col("raw"), stop, known)).withColumn("term", F.lower("raw")).withColumn("what", F.lit("term")).drop("raw")
    phrases = prose.select("doc_id", "source", "seg_no", *[F.col(x) for x in ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")], F.posexplode(T.phrases(F.col("text"))).alias("pos", "term"))
    phrases = phrases.filter(~F.exists(F.split("term", " "), lambda w: excluded(w, stop, known))).withColumn("what", F.lit("phrase"))
    if not c:
        return finding(tokens.withColumn("n", F.lit(0)), ctx, rule_id, F.lit(""), "")
    least = p.parameter(rule_id, "min_repetition", 2)
    new = [novel(c[f"change_{k}"], c[f"base_{k}"], least) for k in ("terms", "phrases")]
    rows = tokens.join(new[0], "term").unionByName(phrases.join(new[1], "term"))
    once = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "term").orderBy("seg_no", F.when(F.col("what") == "term", 0).otherwise(1), "pos"))).filter("at = 1")
    revision = c["revision"]
    evidence = F.concat(F.lit("corpus-novelty: "), F.col("what"), F.lit(" "), quoted(F.col("term")), F.lit(" git_compare_count=0 change_count="), F.col("n").cast("string"), F.lit(f" git_compare_rev={revision}"))
    message = F.concat(F.initcap("what"), F.lit(" "), quoted(F.col("term")), F.lit(" is new: the change has it "), F.col("n").cast("string"), F.lit(f" times, the compared revision ({revision[:8]}) nowhere. Document it if it is a term of the project, else use known words."))
    return finding(once, ctx, rule_id, evidence, message)
