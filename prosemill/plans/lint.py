"""The lint plan: enabled rules over documents, as one union, with coverage and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import comparison, rules, structure
from prosemill.operators.rules import RULES, Context
from prosemill.plans.profile import Profile


def compared(changed: DataFrame, base: DataFrame, revision: str) -> dict:
    """What CORPUS_NOVELTY needs: counts of the changed documents' whole contents and of the base documents' prose."""
    terms, phrases = comparison.base_counts(structure.prose(base))
    whole = structure.visible_text(changed.filter("format = 'html'")).unionByName(changed.filter("format <> 'html'").select("doc_id", F.col("content").alias("text")))
    return {"revision": revision, "base_terms": terms, "base_phrases": phrases, "change_terms": comparison.term_counts(whole), "change_phrases": comparison.phrase_counts(whole)}


def chosen(profile: Profile, with_comparison: bool = False) -> list[str]:
    """The rules that run, in order; a comparison brings in its rule."""
    ids = profile.enabled()
    return ids + ["CORE.CORPUS_NOVELTY"] if with_comparison and "CORE.CORPUS_NOVELTY" not in ids else ids


_KEPT: list[DataFrame] = []


def release() -> None:
    """Lets go of the parsed tables that lint has kept so far."""
    while _KEPT:
        _KEPT.pop().unpersist()


def lint(docs: DataFrame, profile: Profile, base: DataFrame | None = None, revision: str = "", only: list[str] | None = None, keep: bool = True) -> DataFrame:
    """The findings of the enabled rules. With keep the parsed tables that several of them read are persisted on disk until release;
    one that is lost with its executor is parsed again."""
    ids = only if only is not None else chosen(profile, base is not None)
    comparison_tables = compared(docs, base, revision) if base is not None and "CORE.CORPUS_NOVELTY" in ids else None
    ctx = Context(docs, profile, comparison_tables)
    if keep and len(ids) > 1:
        from pyspark import StorageLevel

        ctx.tables = {n: getattr(structure, n)(docs).persist(StorageLevel.DISK_ONLY) for n in ("prose", "blocks", "sentences")}
        _KEPT.extend(ctx.tables.values())
    found = [RULES[i](ctx) for i in ids]
    return reduce(DataFrame.unionByName, found) if found else rules.RULES["CORE.EXCLAMATION"](ctx).limit(0)


def coverage(spark: SparkSession, profile: Profile) -> DataFrame:
    """(ord, rule_id, state): the profile's rules in order, then the others by name: their enforcement, disabled, or
    not-implemented."""
    listed = profile.rules["rules"]
    rows = [(r["id"], (r["enforcement"] if r.get("enabled") else "disabled") if r["id"] in RULES else "not-implemented") for r in listed]
    rows += [(i, "disabled") for i in sorted(set(RULES) - {r["id"] for r in listed})]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "ord int, rule_id string, state string")


def failed(findings: DataFrame, fail_on: str = "error") -> DataFrame:
    """(failed): whether any finding is an error, or with fail_on warning also a warning; never with none."""
    levels = {"error": ["error"], "warning": ["warning", "error"], "none": []}[fail_on]
    return findings.agg(F.coalesce(F.bool_or(F.col("severity").isin(levels) if levels else F.lit(False)), F.lit(False)).alias("failed"))


def summary(findings: DataFrame) -> DataFrame:
    """(rule_id, severity, enforcement, n, docs) of findings."""
    return findings.groupBy("rule_id", "severity", "enforcement").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))
