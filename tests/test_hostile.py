"""Texts made to be slow or to exhaust a stack: each takes time in proportion to its length."""

import time

import pytest
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import evaluation, htmltext, revision, rules, structure
from prosemill.plans import profile

MB = 1_000_000
PARSED = ["](" * (MB // 2), "`<" * (MB // 2), "<div>\n\n" * (MB // 7), "etc. " * (MB // 5), "<" * MB, "```\n" * (MB // 4), "- " * (MB // 2), "a\n" * (MB // 2)]
PAGES = ["<script " * (MB // 8), "&" * MB, "&;" * (MB // 2), "<!--" * (MB // 4), "<p>" * (MB // 3), "<code>x" * (MB // 7)]


@pytest.mark.parametrize("text", PARSED, ids=lambda t: repr(t[:4]))
def test_markdown(text):
    began = time.perf_counter()
    for b in structure.blocks_of(text):
        structure.sentences_of(b.text)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("text", PAGES, ids=lambda t: repr(t[:8]))
def test_pages(text):
    began = time.perf_counter()
    htmltext.project(text)
    assert time.perf_counter() - began < 20


def test_parentheses():
    began = time.perf_counter()
    for text in ("AB (a " * (MB // 6) + ")", "(" * MB + ")", "-" * MB + "("):
        rules.expanded(text, frozenset(["of"]))
    assert time.perf_counter() - began < 20


def one(spark, text):
    return spark.createDataFrame([(1, text)], "i long, t string")


@pytest.mark.parametrize("text", ["a-" * MB + "a", "a.1" * MB, "a" * MB, " " * MB, "\n" * MB, "'" * MB], ids=lambda t: repr(t[:4]))
def test_tokens(spark, text):
    began = time.perf_counter()
    row = one(spark, text).select(F.size(T.tokens(F.col("t"))), F.size(rules.stack_runs(F.col("t"), ["of"])), F.size(T.tokens(F.col("t"), T.CORPUS_TOKEN))).first()
    assert row[0] == (1 if text[0] == "a" else 0) and row[1] >= row[0] and time.perf_counter() - began < 30


@pytest.mark.parametrize("text", ["1." * (MB // 2) + "a", "a" * MB, "a_" * (MB // 2) + "-", "-" * MB, "a@" * (MB // 2)], ids=lambda t: repr(t[:4]))
def test_protected(spark, text):
    began = time.perf_counter()
    one(spark, text).select(F.size(revision.protected_tokens(F.col("t"))), F.size(revision.injected_tokens(F.col("t"), F.col("t")))).first()
    assert time.perf_counter() - began < 20


def test_many_matches(spark):
    """100,000 marks in one line, each where it should be."""
    n = 100_000
    docs = structure.as_documents(one(spark, "é!a" * n), "i", "t", fmt="markdown")
    began = time.perf_counter()
    found = rules.RULES["CORE.EXCLAMATION"](rules.Context(docs, profile.resolve()))
    got = found.agg(F.count(F.lit(1)), F.sum(F.col("start_byte").cast("long")), F.sum(F.col("start_column").cast("long")), F.max("end_byte")).first()
    assert tuple(got) == (n, sum(4 * k + 2 for k in range(n)), sum(3 * k + 2 for k in range(n)), 4 * n - 1)
    assert time.perf_counter() - began < 60


def test_many_lines(spark):
    n = 100_000
    docs = structure.as_documents(one(spark, "é\n\n" * n), "i", "t", fmt="markdown")
    began = time.perf_counter()
    got = structure.segments(docs).agg(F.count(F.lit(1)), F.max("seg_no"), F.max("start_line"), F.max("start_byte")).first()
    assert tuple(got) == (n, n - 1, 2 * n - 1, 4 * (n - 1)) and time.perf_counter() - began < 60


def test_quoted_text_in_a_long_source(spark):
    """A text that stands on every line, asked for near a line deep inside."""
    n = 100_000
    began = time.perf_counter()
    at = one(spark, "éb\n" * n).select(evaluation.resolved(F.col("t"), F.lit("\né"), F.lit(70_000)).alias("at")).first()["at"]
    assert tuple(at) == (4 * 69_998 + 3, 4 * 69_998 + 6, 69_999) and time.perf_counter() - began < 20
