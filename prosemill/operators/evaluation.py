"""Measuring reviewers of comments: a scanner that never fails, pinned corpora, and recorded responses as judged findings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import reports
from prosemill.operators.structure import Positions, ready
from prosemill.plans.profile import ProfileError

#: Languages by extension, and folders and files that no corpus takes.
LANGUAGES = {"go": "go", "ts": "ts", "rs": "rust", "py": "py"}
EXCLUDED_FOLDERS = ".git node_modules .venv vendor target dist build bin obj __pycache__ .pytest_cache .mypy_cache .ruff_cache .next cache".split()
EXCLUDED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml uv.lock Cargo.lock go.sum".split()

# --- corpora -------------------------------------------------------------------------------------------------------


def language_of(path: Column) -> Column:
    """The language that a path's extension stands for; null for any other."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def excluded(path: Column, prefixes: list[str] = ()) -> Column:
    """Whether a path below a corpus is left out: for a folder or a name in it, or because it lies under one of prefixes."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED_FOLDERS))) | F.element_at(parts, -1).isin(EXCLUDED_FILES)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def corpus_files(files: DataFrame, prefixes: list[str] = ()) -> DataFrame:
    """files (path, ...) of a known language that aren't excluded, with language, by path."""
    return files.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~excluded(F.col("path"), prefixes)).orderBy("path")


def manifest(spec: dict) -> list[tuple[str, str, str]]:
    """(language, repository, path) of a manifest's pinned files, in order; ProfileError on a repository without an address or a whole
    revision. spec: repos, each id, url, revision, language, files and exclude_prefixes."""
    out = []
    for repo in spec.get("repos", []):
        if not re.match(r"https://[^/]+/.", str(repo.get("url", ""))):
            raise ProfileError(f"{repo.get('id')!r} needs a public address")
        if not re.fullmatch(r"[0-9a-fA-F]{40}", str(repo.get("revision", ""))):
            raise ProfileError(f"{repo.get('id')!r} needs a whole revision")
        for path in repo.get("files", []):
            parts, under = path.split("/"), [p.rstrip("/") for p in repo.get("exclude_prefixes", [])]
            if not set(parts) & set(EXCLUDED_FOLDERS) and parts[-1] not in EXCLUDED_FILES and not any(path == p or path.startswith(p + "/") for p in under):
                out.append((repo["language"], repo["id"], path))
    return sorted(out)


def locked(files: DataFrame) -> DataFrame:
    """files (path, content) to lock rows (path, sha256, size)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def lock_text(lock: DataFrame) -> str:
    """A lock of pinned files, which are few, as JSON."""
    return json.dumps({"schema_version": 1, "files": [r.asDict() for r in lock.orderBy("path").collect()]}, indent=2) + "\n"


def checked(lock: DataFrame, pinned: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): what of pinned (path) isn't as lock says: unlocked, missing or changed, by current (path, content)."""
    now = current.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    rows = pinned.select("path").join(lock.select("path", "sha256"), "path", "left").join(now, "path", "left")
    state = F.when(F.col("sha256").isNull(), "unlocked").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return rows.select("path", state.alias("state")).filter("state is not null")


# --- comments, failing open ----------------------------------------------------------------------------------------

_OPEN = {
    "go": re.compile(r"""(?P<line>//)|(?P<block>/\*)|(?P<raw>`)|(?P<quote>["'])"""), "ts": re.compile(r"""(?P<line>//)|(?P<block>/\*)|(?P<raw>`)|(?P<quote>["'])"""),
    "rust": re.compile(r"""(?P<line>//)|(?P<block>/\*)|(?P<hashes>b?r\#*")|(?P<name>'[A-Za-z_$](?!'))|(?P<quote>["'])"""), "py": re.compile(r"""(?P<line>\#)|(?P<triple>\"{3}|'{3})|(?P<quote>["'])"""),
}
_QUOTED = {q: re.compile(rf"(?:[^\\{q}]|\\.)*+(?:{q}|\\?\Z)", re.S) for q in "\"'"}
_EDGE = re.compile(r"/\*|\*/")


def scan(text: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of the comments of a text, in code points. What is opened and never closed goes to the end of the text, so a broken
    file has comments too; that is what sets this apart from the lexers of the catalog."""
    out, at = [], 0
    while m := _OPEN[language].search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "line":
            at = text.find("\n", at)
        elif kind == "block":
            depth = 1
            while depth and at >= 0:
                e = _EDGE.search(text, at) if language == "rust" else re.compile(r"\*/").search(text, at)
                at, depth = (e.end(), depth + (1 if e[0] == "/*" else -1)) if e else (-1, depth)
        elif kind in ("raw", "triple", "hashes"):
            close = '"' + "#" * m[0].count("#") if kind == "hashes" else m[0]
            end = text.find(close, at)
            at = end + len(close) if end >= 0 else -1
        elif kind == "quote":
            at = _QUOTED[m[0]].match(text, at).end()
        at = len(text) if at < 0 else at
        if kind in ("line", "block"):
            out.append((start, at))
    return out


def scanned(files: DataFrame) -> DataFrame:
    """files (path, content, language) to (path, start_byte, end_byte, start_line, end_line, text) of their comments. Files of other
    languages and null contents have none."""
    ready(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
                at = Positions(content)
                out += [(path, at.byte(a), at.byte(b), at.place(a)[0], at.place(max(a, b - 1))[0], content[a:b]) for a, b in scan(content, language)]
            yield pd.DataFrame(out, columns=["path", "start_byte", "end_byte", "start_line", "end_line", "text"])

    rows = files.filter(F.col("language").isin(list(_OPEN)) & F.col("content").isNotNull()).select("path", "content", "language")
    return rows.mapInPandas(read, "path string, start_byte long, end_byte long, start_line int, end_line int, text string")


# --- responses -----------------------------------------------------------------------------------------------------


def resolved(source: Column, text: Column, line: Column) -> Column:
    """Where a text that a reviewer quotes stands in a source: the occurrence that begins nearest to a line's start, the first of two as
    near, as a struct of start and end in bytes and its line; null where it doesn't occur."""
    n, lines = F.length(text), F.size(F.split(source, "\n", -1))
    line = F.coalesce(line, F.lit(0))
    # The line breaks before a line; substring_index counts in int.
    breaks = F.greatest(F.least(line, lines), F.lit(1)).cast("int") - 1
    near = F.when((line <= 1) | (line > lines), 0).otherwise(F.length(F.call_function("substring_index", source, F.lit("\n"), breaks)) + 1)

    def nearest(near: Column) -> Column:
        """The first occurrence that begins at near or later, or the last before it, which is the first of the mirrored text."""
        after = F.position(text, source, near + 1) - 1
        behind = F.substring(source, F.lit(1), near + n - 1)
        mirrored = F.position(F.reverse(text), F.reverse(behind))
        before = F.when((near > 0) & (mirrored > 0), F.length(behind) - mirrored + 1 - n)
        return T.bound(F.struct(F.when(after >= 0, after).alias("after"), before.alias("before")), lambda x: F.when((near - x["before"] <= x["after"] - near) | x["after"].isNull(), x["before"]).otherwise(x["after"]))

    def place(best: Column) -> Column:
        head = F.substring(source, F.lit(1), best)
        at = F.struct(F.octet_length(head).alias("start_byte"), (F.octet_length(head) + F.octet_length(text)).alias("end_byte"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line"))
        return F.when(best.isNotNull(), at)

    return F.when(n > 0, T.bound(T.bound(near, nearest), place))


def title(text: Column) -> Column:
    """A reason in one line of at most 120 characters."""
    line = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), " ")
    return F.when(line == "", "code-comment finding").otherwise(F.substring(line, 1, 120))


def judged(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings (file, id, source_text, line, reason) of recorded responses on files (path, content, language) with title, start_byte,
    end_byte, line, target_resolved and comment_target: whether at least half of it lies in comments. A text that can't be found
    targets no comment."""
    source = files.select(F.col("path").alias("s_path"), "content")
    at = findings.join(source, F.col("file") == F.col("s_path"), "left").withColumn("at", resolved(F.col("content"), F.col("source_text"), F.col("line")))
    rows = at.select("file", "id", title(F.col("reason")).alias("title"), F.coalesce("at.start_byte", F.lit(-1)).cast("long").alias("start_byte"), F.coalesce("at.end_byte", F.lit(-1)).cast("long").alias("end_byte"), F.coalesce("at.line", "line").cast("long").alias("line"), F.col("at").isNotNull().alias("target_resolved"))
    spans = scanned(files).select(F.col("path").alias("file"), "start_byte", "end_byte")
    out = reports.span_coverage(rows, spans)
    return out.withColumn("comment_target", F.col("targets_comment") & F.col("target_resolved")).drop("targets_comment", "coverage")


def review_summary(findings: DataFrame) -> DataFrame:
    """(findings, comment_targets, non_comment_targets, unresolved_targets) of judged findings."""
    return findings.agg(F.count(F.lit(1)).alias("findings"), F.count_if("comment_target").alias("comment_targets"), F.count_if(~F.col("comment_target")).alias("non_comment_targets"), F.count_if(~F.col("target_resolved")).alias("unresolved_targets"))


def usage(answers: DataFrame, column: str = "usage") -> DataFrame:
    """(name, tokens): the sums of the token counts that answers report, JSON objects whose other values don't count."""
    pairs = F.explode(F.from_json(F.col(column), "map<string,string>"))
    rows = answers.select(pairs.alias("name", "value")).filter(F.col("value").rlike("^[0-9]{1,18}$"))
    return rows.groupBy("name").agg(F.sum(F.col("value").cast("long")).alias("tokens"))
