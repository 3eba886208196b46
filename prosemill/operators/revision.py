"""Model-proposed revisions: what must survive a rewrite, and whether a response keeps the contract.

No model is called here: a client is any function from prompt to text, and responses are rows. A response either keeps the
whole contract or is rejected whole; comment findings are judged one by one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import ascii_boundary
from prosemill.operators.rules import RULES
from prosemill.operators.structure import ready

#: Protected tokens, addresses that must not appear anew, limits, principles, and those that rules stand for.
PROTECTED = (
    r"https?://[^\s<>\"']+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b"
    r"|(?:\.\.?/|/)[A-Za-z0-9._~!$&()*+,;=:@%/-]+|--[A-Za-z0-9][A-Za-z0-9_-]*|\bv?\d+(?:\.\d+)*(?:[-+][A-Za-z0-9.-]+)?\b|\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b"
    r"|\b[A-Za-z0-9]*[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b|\b[A-Z]{2,}[A-Za-z0-9]*\b"
)
#: Parts of these patterns that take time by the square of a long run of their characters, and the same for Java without that:
#: an address begins where its run does or where another one ends (whose domain has at most 255 characters, as names have),
#: a version's parts end before a letter, and the first small letter and then the first capital are found without going back.
_LINEAR = [
    (r"[A-Za-z0-9._%+-]+@", r"(?:(?<![A-Za-z0-9._%+-])|\G(?<=@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,63}))[A-Za-z0-9._%+-]++@"), (r"\bv?\d+(?:\.\d+)*(?:[-+]", r"\bv?\d++(?:\.\d++(?![A-Za-z_]))*+(?:[-+]"),
    (r"\b[A-Za-z0-9]*[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b", r"\b[A-Z0-9]*+[a-z][a-z0-9]*+[A-Z][A-Za-z0-9]*+\b"),
]
INJECTED = r"https?://[^\s<>\"']+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b(?:\d{1,3}\.){3}\d{1,3}\b"
TRAILING = ".,;:!?)]}"
MOST_ITEMS, MOST_BYTES, MOST_COMMENT_FINDINGS, LEAST_CONFIDENCE = 20, 10_000, 5, 0.8
PRINCIPLES = ["CORE." + p for p in "APPROVED_WORDS ONE_TERM_IDEA SHORT_SENTENCE ACTIVE_DIRECT_VOICE ONE_TOPIC_PARAGRAPH EXPLICIT_RELATIONSHIPS CAUSAL_ORDER PLAIN_MECHANISM RELEVANT_DETAIL TIMELESS_PROSE".split()]
STANDS_FOR = {"CORE." + k: "CORE." + v for k, v in (
    ("SENTENCE_LENGTH", "SHORT_SENTENCE"), ("DENSE_PARAGRAPH", "ONE_TOPIC_PARAGRAPH"), ("NOUN_STACK", "EXPLICIT_RELATIONSHIPS"), ("GERUND_OPENER", "ACTIVE_DIRECT_VOICE"),
    ("TERM_DISCOURAGED", "APPROVED_WORDS"), ("TERM_CASE", "ONE_TERM_IDEA"), ("TERM_CONSISTENCY", "ONE_TERM_IDEA"), ("TERM_UNKNOWN", "APPROVED_WORDS"), ("LATIN_ABBREV", "EXPLICIT_RELATIONSHIPS"),
    ("UNEXPANDED_ABBREV", "EXPLICIT_RELATIONSHIPS"), ("CORPUS_NOVELTY", "APPROVED_WORDS"), ("PROCEDURE_MULTI_ACTION", "EXPLICIT_RELATIONSHIPS"), ("TIME_ANCHOR", "TIMELESS_PROSE"),
    ("GERUND_HEADING", "ACTIVE_DIRECT_VOICE"), ("SEQUENTIAL_BULLET", "CAUSAL_ORDER"),
)}
CLAIMS = ("certif", "compliance", "guarantee")


def linear(pattern: str) -> str:
    """The same pattern for Java, which backtracks."""
    for plain, other in _LINEAR:
        pattern = pattern.replace(plain, other)
    return pattern


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_boundary(linear(pattern))), F.lit(0))


def protected_tokens(text: Column, terms: list[str] = ()) -> Column:
    """Tokens of a text that a rewrite must keep: addresses, paths, options, versions, identifiers, and the given terms."""
    found = F.filter(F.transform(_found(text, PROTECTED), lambda t: F.rtrim(t, F.lit(TRAILING))), lambda t: t != "")
    own = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)) if terms else F.array().cast("array<string>")
    return F.array_distinct(F.concat(found, own))


def preserves(source: Column, replacement: Column, terms: list[str] = ()) -> Column:
    """Whether a replacement has every protected token of its source."""
    return F.forall(protected_tokens(source, terms), lambda t: F.contains(replacement, t))


def injected_tokens(source: Column, rewrite: Column) -> Column:
    """Addresses of a rewrite that its source doesn't have."""
    trim = lambda a: F.transform(a, lambda t: F.rtrim(t, F.lit(TRAILING)))
    return F.array_except(trim(_found(rewrite, INJECTED)), trim(_found(source, INJECTED)))


def judged_rewrites(rows: DataFrame) -> DataFrame:
    """rows (source, rewrite, ...) with result and reason: the rewrite, or the source where that is empty, loses a protected
    token or brings in an address."""
    reason = F.when(F.trim(F.coalesce("rewrite", F.lit(""))) == "", "empty").when(~preserves(F.col("source"), F.col("rewrite")), "protected content lost").when(F.size(injected_tokens(F.col("source"), F.col("rewrite"))) > 0, "content injected")
    return rows.withColumn("reason", reason).withColumn("result", F.when(F.col("reason").isNull(), F.col("rewrite")).otherwise(F.col("source")))


def unfenced(raw: str) -> str:
    """The body of a text that is one fenced block of JSON; else the text."""
    m = re.fullmatch(r"```(?:json|JSON)?\n(.*)```", raw.strip(), re.S)
    return m[1].strip() if m and m[1].strip() else raw


def principles_of(ids: list[str]) -> list[str]:
    """The principles that a response names, rules replaced by what they stand for; ValueError on unknown or repeated ones."""
    if repeated := [i for i in ids if i in PRINCIPLES and ids.count(i) > 1]:
        raise ValueError(f"duplicate principle id: {repeated[0]}")
    if unknown := [i for i in ids if i not in PRINCIPLES and i not in RULES]:
        raise ValueError(f"unknown principle id: {unknown[0]}")
    return list(dict.fromkeys(p for i in ids if (p := i if i in PRINCIPLES else STANDS_FOR.get(i))))


def reported_error(raw: str) -> str | None:
    """The error that a model reports instead of an answer, without control characters and cut to 512 bytes."""
    try:
        value = json.loads(raw)["error"]
    except (ValueError, KeyError, TypeError):
        return None
    said = value if isinstance(value, str) else value.get("message") if isinstance(value, dict) else None
    said = said if isinstance(said, str) and said.strip() else "model returned an error object"
    said = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", said.strip())
    return said if len(said.encode()) <= 512 else said.encode()[:512].decode(errors="ignore") + "…"


def revisions(raw: str) -> tuple[list[dict], int]:
    """The items of a response and how many were discarded; ValueError if it breaks the contract anywhere."""
    raw = unfenced(raw)
    if len(raw.encode()) > MOST_BYTES:
        raise ValueError("response too large")
    body = json.loads(raw)
    items = (body.get("findings") or body.get("questions") or []) if isinstance(body, dict) else None
    if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
        raise ValueError("findings must be a list of objects")
    if len(items) > MOST_ITEMS:
        raise ValueError("too many items")
    out, discarded = [], 0
    for f in items:
        kind, text, span, ids = f.get("kind"), f.get("source_text"), f.get("source_range") or {}, f.get("principle_ids")
        replacement, question, reason, confidence = f.get("replacement"), f.get("question"), f.get("reason"), f.get("confidence", 0)
        if kind not in ("rewrite", "clarification"):
            raise ValueError("invalid kind")
        if not isinstance(text, str) or not text:
            raise ValueError("missing source_text")
        start, end = span.get("start", 0), span.get("end", 0)
        if not isinstance(start, int) or not isinstance(end, int) or start < 0 or end <= start:
            raise ValueError("invalid source range")
        if not isinstance(ids, list) or not ids:
            raise ValueError("missing principle_ids")
        if not (named := principles_of(ids)):
            discarded += 1
            continue
        if not isinstance(reason, str) or not reason.strip():
            raise ValueError("empty reason")
        wanted, other = (replacement, question) if kind == "rewrite" else (question, replacement)
        if other is not None or not isinstance(wanted, str) or not wanted.strip():
            raise ValueError("a rewrite needs a replacement alone, a clarification a question alone")
        if any(c in f"{reason} {wanted}".lower() for c in CLAIMS):
            raise ValueError("response changes claims")
        if not isinstance(confidence, (int, float)) or isinstance(confidence, bool) or not 0 <= confidence <= 1:
            raise ValueError("invalid confidence")
        out.append({"kind": kind, "source_text": text, "start": start, "end": end, "principle_ids": named, "reason": reason.strip(), "replacement": replacement and replacement.strip(), "question": question and question.strip(), "confidence": float(confidence)})
    return out, discarded


def located(text: bytes, wanted: bytes, near: int) -> tuple[int, int] | None:
    """Where a model's source text stands: its occurrence nearest to a place, none if two are as near; without an exact one,
    the only one that is equal but for white space."""
    starts = [m.start() for m in re.finditer(b"(?=" + re.escape(wanted) + b")", text)] if wanted else []
    spans = [(s, s + len(wanted)) for s in starts]
    if not spans and wanted.split():
        spans = [m.span() for m in re.finditer(rb"\s+".join(map(re.escape, wanted.split())), text)]
    spans.sort(key=lambda s: abs(s[0] - near))
    if not spans or (len(spans) > 1 and abs(spans[0][0] - near) == abs(spans[1][0] - near)):
        return None
    return spans[0]


ITEM = "response_id string, status string, error string, discarded int, kind string, start_byte int, end_byte int, source_text string, principle_ids array<string>, reason string, replacement string, question string, confidence double"


def validated(responses: DataFrame) -> DataFrame:
    """responses (response_id, chunk, chunk_start, raw) to ITEM rows: a row an item with its place repaired, or one row with
    the error that rejects the response. Rewrites that lose protected tokens and items that can't be placed are dropped and
    counted in discarded."""
    ready(responses.sparkSession)
    pattern = re.compile(PROTECTED, re.A)  # on parts of a response, which is bounded

    def keeps(source: str, replacement: str | None) -> bool:
        return replacement is None or all(t in replacement for m in pattern.finditer(source) if (t := m[0].rstrip(TRAILING)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rid, chunk, offset, raw in zip(batch["response_id"], batch["chunk"], batch["chunk_start"], batch["raw"]):
                blank, text = [None] * 9, (chunk or "").encode()
                try:
                    items, gone = revisions(raw or "")
                except (ValueError, TypeError, AttributeError) as e:
                    out.append((rid, "failed", reported_error(raw or "") or str(e), 0, *blank))
                    continue
                good = [(i, s) for i in items if (s := located(text, i["source_text"].encode(), i["start"] - int(offset))) and keeps(i["source_text"], i["replacement"])]
                gone += len(items) - len(good)
                out += [(rid, "ok", None, gone, i["kind"], s[0] + int(offset), s[1] + int(offset), i["source_text"], i["principle_ids"], i["reason"], i["replacement"], i["question"], i["confidence"]) for i, s in good] or [(rid, "ok", None, gone, *blank)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEM.split(", ")]).astype({"start_byte": "Int32", "end_byte": "Int32"})

    return responses.select("response_id", "chunk", "chunk_start", "raw").mapInPandas(read, ITEM)


def comment_findings(raw: str, known: dict[str, str]) -> tuple[list[dict], int]:
    """Findings of a response on a file's comments (id to text) and how many were discarded: those of unknown or repeated ids,
    with other keys, or below the least confidence. ValueError if the response isn't one list of at most five."""
    body = json.loads(unfenced(raw))
    if not isinstance(body, dict) or set(body) != {"findings"} or not isinstance(body["findings"], list) or len(body["findings"]) > MOST_COMMENT_FINDINGS:
        raise ValueError("one key findings with at most five items is expected")
    ids = [f.get("comment_id") if isinstance(f, dict) else None for f in body["findings"]]
    good = [f for f, i in zip(body["findings"], ids) if i in known and ids.count(i) == 1 and isinstance(f.get("reason"), str) and f["reason"].strip() and isinstance(f.get("confidence"), (int, float)) and LEAST_CONFIDENCE <= f["confidence"] <= 1]
    return good, len(ids) - len(good)


def revised(chunks: DataFrame, client: Callable[[str], str], prompt: Callable[[str], str]) -> DataFrame:
    """chunks (doc_id, chunk_no, start_byte, text) to responses, each by one call of a client that the caller brings."""
    ready(chunks.sparkSession)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"response_id": [f"{d}/{n}" for d, n in zip(b["doc_id"], b["chunk_no"])], "chunk": b["text"], "chunk_start": b["start_byte"], "raw": [client(prompt(t)) for t in b["text"]]})

    return chunks.select("doc_id", "chunk_no", "start_byte", "text").mapInPandas(call, "response_id string, chunk string, chunk_start int, raw string")


def token_estimate(text: Column) -> Column:
    """Tokens that a text takes at most four bytes each."""
    return F.ceil(F.octet_length(text) / 4).cast("long")
