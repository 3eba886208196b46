"""Revision runs as tables: requests, answers with one fallback, comment findings, coverage, status and reports.

A run has at most MOST_REQUESTS requests, so its answers, bounded each, are kept on the driver between the first try and the
fallback; nobody asks a model twice because a task was lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.operators import comments as source_comments
from prosemill.operators import prompts, reports, revision
from prosemill.operators.models import MOST_INPUT, ModelError
from prosemill.operators.structure import ready
from prosemill.plans.profile import ProfileError

#: Bytes of a request on a whole source file at most, and requests of a run by default.
MOST_SOURCE, REQUESTS = 1 << 20, 32

# --- comments ------------------------------------------------------------------------------------------------------


def comment_system() -> str:
    """What a request on a file's comments begins with, in this package's words."""
    return "\n".join([
        "A whole source file follows, and a list of its comments. Judge the comments; the code is there to read, not to change.",
        "Name a comment by its comment_id alone. Copy no source and give no places.",
        "Report a comment only if the code shows that it is wrong, stale or unclear in a way that matters. Leave good and merely plain ones alone.",
        "rewrite: give the whole new comment with its delimiters, and only what the code establishes. clarification: ask what only the author knows. Propose no deletion.",
        *reports.GUIDANCE[""], *reports.GUIDANCE["code-comment"], "Principles: " + ", ".join(revision.PRINCIPLES),
        f'Answer with one JSON object {{"findings": [...]}} of at most {revision.MOST_COMMENT_FINDINGS} items, each with comment_id, action, principle_ids, reason, replacement, question and confidence from 0 to 1; what doesn\'t apply is null.',
    ])


def comment_limit(message_bytes: Column, request_bytes: Column, context: int = 0, output: int = 0) -> tuple[Column, Column]:
    """(limit, error) of a request on a whole file: without a known context the general limit for messages, else what the context
    leaves beside the answer and a reserve, MOST_SOURCE at most."""
    if not context:
        return F.lit(MOST_INPUT), F.when(message_bytes > MOST_INPUT, F.format_string(f"%d bytes of messages; without a known context at most {MOST_INPUT}", message_bytes))
    output = output if output > 0 else prompts.OUTPUT
    room = context - output - prompts.SAFETY
    if room <= 0:
        return F.lit(0), F.lit(f"a context of {context} tokens has no room beside {output} for the answer and {prompts.SAFETY} in reserve")
    limit = min(MOST_SOURCE, room * prompts.BYTES)
    tokens = F.ceil(request_bytes / prompts.BYTES)
    wrong = F.when(message_bytes > limit, F.format_string(f"%d bytes of messages; the context has room for {limit}", message_bytes)).when(tokens > room, F.format_string(f"about %d tokens; the context has room for {room}", tokens.cast("long")))
    return F.lit(limit), wrong


def comment_requests(files: DataFrame, context: int = 0, output: int = 0) -> DataFrame:
    """files (path, content, optional language) to (path, content, system, user, limit, status, error), a request a file: status is
    ask, none (no comments) or failed (it can't be read or is too large, as error says). Each path is one file."""
    found = source_comments.comments(files)
    one = F.struct(F.col("comment_id").alias("id"), "form", "start_line", "end_line", "text")
    # A file's comments are no more than the file, which a request holds whole.
    lists = found.groupBy("path").agg(F.first("language", True).alias("language"), F.first("sha256").alias("sha256"), F.first("error", True).alias("error"), F.sort_array(F.collect_list(F.when(F.col("error").isNull(), one))).alias("comments"))
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(lists, "path", "left")
    catalog = F.to_json(F.struct(F.col("sha256").alias("source_sha256"), "comments"))
    source = F.concat(F.lit('<source-code file="'), F.col("path"), F.lit('" language="'), F.coalesce("language", F.lit("")), F.lit('">\n'), F.col("content"), F.lit("\n</source-code>\n\nIts comments:\n"), catalog)
    system = comment_system()
    rows = rows.withColumn("user", source).withColumn("system", F.lit(system))
    messages = F.octet_length("user") + len(system.encode())
    limit, wrong = comment_limit(messages, F.octet_length(F.to_json(F.struct("system", "user"))), context, output)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size("comments") > 0, wrong)
    status = F.when(error.isNotNull(), "failed").when(F.coalesce(F.size("comments"), F.lit(0)) <= 0, "none").otherwise("ask")
    return rows.select("path", "content", "system", "user", limit.alias("limit"), status.alias("status"), error.alias("error"))


COMMENT_FIELDS = {"comment_id", "action", "principle_ids", "reason", "replacement", "question", "confidence"}


def comment_finding(item: object) -> dict | None:
    """A finding of a response if it keeps the contract: all seven fields and no other, known principles named once, a reason, and a
    replacement or a question as its action wants."""
    if not isinstance(item, dict) or set(item) != COMMENT_FIELDS:
        return None
    text = lambda k: isinstance(item[k], str) and item[k].strip() != ""
    ids, sure = item["principle_ids"], item["confidence"]
    wanted, other = ("replacement", "question") if item["action"] == "rewrite" else ("question", "replacement")
    fine = (
        item["action"] in ("rewrite", "clarification") and text("comment_id") and text("reason") and text(wanted) and item[other] is None
        and isinstance(ids, list) and len(ids) > 0 and all(isinstance(i, str) and i in revision.PRINCIPLES for i in ids) and len(set(ids)) == len(ids)
        and isinstance(sure, (int, float)) and not isinstance(sure, bool) and 0 <= sure <= 1
    )
    return item if fine else None


def judged_comments(raw: str, path: str, content: str) -> tuple[list[dict], int, int]:
    """The findings of a response on a file that hold, how many were discarded, and how many of those are unsafe rewrites. ValueError
    if the response isn't one list of few findings."""
    raw = revision.unfenced(raw)
    if len(raw.encode()) > revision.MOST_BYTES:
        raise ValueError("response too large")
    if said := revision.reported_error(raw):
        raise ValueError(said)
    body = json.loads(raw)
    if not isinstance(body, dict) or set(body) != {"findings"} or not isinstance(body["findings"], list):
        raise ValueError("one key, findings, with a list is expected")
    if len(body["findings"]) > revision.MOST_COMMENT_FINDINGS:
        raise ValueError("too many findings")
    language = source_comments.detect_language(path)
    if language is None:
        raise ValueError("unsupported language")
    known = {c[0]: c for c in source_comments.catalog(path, language, content)}
    named = [i.get("comment_id") if isinstance(i, dict) else None for i in body["findings"]]
    out, unsafe = [], 0
    for item in body["findings"]:
        f = comment_finding(item)
        if f is None or f["comment_id"] not in known or named.count(f["comment_id"]) > 1 or f["confidence"] < revision.LEAST_CONFIDENCE:
            continue
        comment_id, form, start, end, text = known[f["comment_id"]]
        if f["action"] == "rewrite" and not source_comments.replacement_is_safe(language, content, start, form, f["replacement"], path):
            unsafe += 1
            continue
        out.append(f | {"start": start, "end": end, "source_text": text, "reason": f["reason"].strip()})
    return out, len(named) - len(out), unsafe


FOUND = "path string, status string, error string, discarded int, unsafe int, comment_id string, kind string, start_byte int, end_byte int, start_line int, start_column int, end_line int, end_column int, source_text string, principle_ids array<string>, reason string, replacement string, question string, confidence double"


def validated_comments(responses: DataFrame) -> DataFrame:
    """responses (path, content, raw) to FOUND rows: a row a finding with its comment's place, or one row with the error that rejects
    the response; a response without findings that hold has one row with its counts. Nulls count as empty."""
    ready(responses.sparkSession)
    names = [c.split()[0] for c in FOUND.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, raw in zip(batch["path"], batch["content"], batch["raw"]):
                blank = [None] * (len(names) - 5)
                try:
                    items, gone, unsafe = judged_comments(raw or "", path or "", content or "")
                except (ValueError, TypeError, RecursionError) as e:
                    out.append((path, "failed", str(e), 0, 0, *blank))
                    continue
                at = source_comments.Positions(content or "")
                out += [(path, "ok", None, gone, unsafe, i["comment_id"], i["action"], *at.span(i["start"], i["end"]), i["source_text"], i["principle_ids"], i["reason"], i["replacement"], i["question"], float(i["confidence"])) for i in items] or [(path, "ok", None, gone, unsafe, *blank)]
            made = pd.DataFrame(out, columns=names)
            yield made.astype({n: "Int32" for n in names[7:13]})

    return responses.select("path", "content", "raw").mapInPandas(read, FOUND)


# --- asking --------------------------------------------------------------------------------------------------------

ANSWER = "raw string, error string, requests int"


def _asked(rows: DataFrame, client: Callable[..., str], valid: Callable[[dict], None], mode: str) -> DataFrame:
    """rows with ANSWER: one request each. What the client or valid raises is the row's error, never the job's."""
    ready(rows.sparkSession)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, row in batch.iterrows():
                raw, error = None, None
                try:
                    raw = client(row["system"], row["user"], mode, int(row["limit"]))
                    valid(row.to_dict() | {"raw": raw})
                except ModelError as e:
                    error = f"request: {e}"
                except Exception as e:  # whatever a caller's client or judge raises fails this row alone
                    error = f"answer: {e}" if raw is not None else f"request: {type(e).__name__}: {e}"
                yield batch.loc[[i]].assign(raw=[raw], error=[error], requests=[1])

    return rows.mapInPandas(call, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + ANSWER)


def answered(requests: DataFrame, client: Callable[..., str], valid: Callable[[dict], None], most: int = REQUESTS, mode: str = "json_schema") -> DataFrame:
    """requests (path, start_byte, system, user, limit, ...) with ANSWER, in order of path and start_byte.

    client(system, user, mode, limit) gives an answer's text; valid raises on one that breaks its contract. Answers in a structured
    mode that do so are asked for once more with the prompt alone, the first by order, as long as the run has at most most
    requests. More requests than that are an error before any is sent.
    """
    if not 1 <= most <= prompts.MOST_REQUESTS:
        raise ProfileError(f"1 to {prompts.MOST_REQUESTS} requests can be allowed")
    spark, n = requests.sparkSession, requests.count()
    if n > most:
        raise ProfileError(f"{n} requests are over the limit of {most}")
    made = _asked(requests, client, valid, mode)
    schema, order = made.schema, lambda r: (r["path"] or "", r["start_byte"] or 0)
    rows = sorted(made.collect(), key=order)  # most answers of bounded size
    again = [r for r in rows if (r["error"] or "").startswith("answer: ")][: most - n] if mode in ("json_schema", "json_object") else []
    if again:
        second = {(r["path"], r["start_byte"]): r for r in _asked(spark.createDataFrame([tuple(r)[: len(requests.columns)] for r in again], requests.schema), client, valid, "prompt_json").collect()}
        rows = [
            type(r)(**r.asDict() | {"raw": s["raw"], "requests": 2, "error": s["error"] and f"{r['error']}; once more: {s['error']}"}) if r in again and (s := second[r["path"], r["start_byte"]]) else r for r in rows
        ]
    return spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)


def source_analysis(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """(path, input_bytes, analyzed_bytes, chunks, requests, complete) of documents (path, input_bytes, analysis_bytes) from answers
    (path, start_byte, end_byte, error, requests): what was answered counts as analysed. A document that needed no request is
    complete."""
    fine = F.col("error").isNull()
    sums = answers.groupBy("path").agg(F.sum(F.when(fine, F.col("end_byte") - F.col("start_byte")).otherwise(0)).alias("a"), F.count(F.lit(1)).alias("chunks"), F.sum("requests").alias("requests"))
    out = documents.join(sums, "path", "left")
    analyzed = F.when(F.col("chunks").isNull(), F.col("analysis_bytes")).otherwise(F.col("a")).cast("long")
    return out.select("path", F.col("input_bytes").cast("long").alias("input_bytes"), analyzed.alias("analyzed_bytes"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("requests", F.lit(0)).cast("long").alias("requests"), (analyzed == F.col("analysis_bytes")).alias("complete"))


def run_status(answers: DataFrame) -> DataFrame:
    """(status): ok without errors, failed if nothing succeeded, else partial."""
    bad, good = F.count_if(F.col("error").isNotNull()), F.count_if(F.col("error").isNull())
    return answers.agg(F.when(bad == 0, "ok").when(good == 0, "failed").otherwise("partial").alias("status"))


def discards(validated: DataFrame, key: str = "path") -> DataFrame:
    """(discarded_findings, discarded_rewrites) over responses: every row of a response has its counts, which count once."""
    unsafe = F.max("unsafe") if "unsafe" in validated.columns else F.lit(0)
    each = validated.groupBy(key).agg(F.max("discarded").alias("d"), unsafe.alias("u"))
    return each.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("discarded_findings"), F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("discarded_rewrites"))


def in_order(revisions: DataFrame) -> DataFrame:
    """Revisions by path and place; those of one place by kind and text."""
    return revisions.orderBy("path", "start_byte", "end_byte", "kind", "source_text")


# --- reports -------------------------------------------------------------------------------------------------------

PLACE = ["start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column"]


def revision_json(revisions: DataFrame) -> DataFrame:
    """(path, start_byte, value): each revision as JSON, its place nested, without the fields it doesn't have."""
    had = [c for c in PLACE if c in revisions.columns]
    value = F.to_json(F.struct("kind", F.col("path").alias("source_path"), "source_text", F.struct(*had).alias("range"), "principle_ids", "reason", "replacement", "question", "confidence"))
    return revisions.filter("kind is not null").select("path", "start_byte", value.alias("value"))


def revision_lines(revisions: DataFrame) -> DataFrame:
    """(path, start_byte, value): each revision as lines for people."""
    r = revisions.filter("kind is not null")
    place = F.format_string("bytes %d-%d", "start_byte", "end_byte")
    if "start_line" in revisions.columns:
        place = F.format_string("[%d:%d - %d:%d] bytes %d-%d", "start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte")
    lines = [F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("path: "), "path"), F.concat(F.lit("source: "), F.to_json(F.array("source_text")).substr(F.lit(2), F.length(F.to_json(F.array("source_text"))) - 2)), F.concat(F.lit("range: "), place), F.concat(F.lit("principles: "), F.array_join("principle_ids", ", ")),
             F.concat(F.lit("reason: "), "reason"), F.format_string("confidence: %.2f", "confidence"), F.when(F.col("kind") == "rewrite", F.concat(F.lit("replacement: "), "replacement")).otherwise(F.concat(F.lit("question: "), "question"))]
    return r.select("path", "start_byte", F.concat_ws("\n", *lines).alias("value"))


def revise_report(answers: DataFrame, analysis: DataFrame, validated: DataFrame, key: str = "path", **about: str) -> dict:
    """A run's report: status, coverage, errors, discard sums and revisions in order. A run has a bounded number of answers of
    bounded size, which is what the driver gets. about: profile, model and the like."""
    errors = [{"source_path": r["path"], "message": r["error"]} for r in answers.filter("error is not null").select("path", "error").orderBy("path", "error").collect()]
    found = in_order(validated.filter("kind is not null"))
    return {"schema_version": 1, "status": run_status(answers).first()["status"]} | about | discards(validated, key).first().asDict() | {
        "analysis": [r.asDict() for r in analysis.orderBy("path").collect()], "errors": errors,
        "revisions": [json.loads(r["value"]) for r in revision_json(found).orderBy("path", "start_byte").collect()], "lines": [r["value"] for r in revision_lines(found).orderBy("path", "start_byte").collect()],
    }


def revise_text(report: dict, style: str = "human") -> str:
    if style == "json":
        return json.dumps({k: v for k, v in report.items() if k != "lines"}, indent=2, ensure_ascii=False) + "\n"
    out = [f"{k}: {report[k]}" for k in ("status", "profile", "model") if report.get(k)]
    out += [f"analysis: {a['path']} chunks={a['chunks']} requests={a['requests']} bytes={a['analyzed_bytes']}/{a['input_bytes']} complete={str(a['complete']).lower()}" for a in report["analysis"]]
    out += [f"{said}: {report[k]}" for k, said in (("discarded_rewrites", "discarded unsafe rewrites"), ("discarded_findings", "discarded invalid findings")) if report[k]]
    out += [f"error: {e['source_path']}: {e['message']}" for e in report["errors"]]
    return "\n".join([*out, "\n---\n".join(report["lines"])] if report["lines"] else out) + "\n"


#: Why a rewrite is given up, as reports say it.
REASONS = {"content injected": "injected_content", "protected content lost": "protected_content", "empty": "empty"}


def rewrite_json(judged: DataFrame, **about: str) -> DataFrame:
    """(path, value): judged_rewrites rows (path, source, rewrite, reason, result) as JSON reports. about: profile, model and so on."""
    label = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("reason")]
    extra = [F.lit(v).alias(k) for k, v in about.items()]
    value = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("ok").alias("status"), *extra, F.col("path").alias("source_path"), F.octet_length("source").alias("input_bytes"), F.octet_length("result").alias("output_bytes"), F.col("result").alias("rewritten_text"), F.col("reason").isNotNull().alias("discarded"), label.alias("discard_reason")))
    return judged.select("path", value.alias("value"))


def rewrite_lines(judged: DataFrame) -> DataFrame:
    """(path, value): the same for people: what was done, a line, and the text."""
    why = F.when(F.col("reason").isNotNull(), F.concat(F.lit("discarded ("), F.col("reason"), F.lit("); the original follows\n"))).otherwise("")
    body = F.concat("result", F.when(F.endswith("result", F.lit("\n")), "").otherwise("\n"))
    return judged.select("path", F.concat(F.lit("status: ok\nsource: "), F.col("path"), F.format_string("\ninput: %d bytes, output: %d bytes\n", F.octet_length("source"), F.octet_length("result")), why, F.lit("---\n"), body).alias("value"))

