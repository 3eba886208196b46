"""Comments of source files: one small lexer a language, a catalog with exact places, and rules over comments.

A lexer is a pattern of everything that matters (comments, strings, what opens them) plus the few steps that a pattern can't
express: nesting in Rust, heredocs in shell, templates, regular expressions and JSX in TypeScript. A file with an unclosed
string or comment has no comments and an error, so nothing inside a string is taken for a comment.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators.structure import SPAN, Positions, ready

#: Languages by extension and by name.
EXTENSIONS = {"go": "go", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "rs": "rust", "py": "py", "pyi": "py", "sh": "sh", "bash": "sh", "zsh": "sh", "ksh": "sh"}
NAMES = {"go": "go", "ts": "ts", "typescript": "ts", "js": "ts", "javascript": "ts", "rust": "rust", "rs": "rust", "py": "py", "python": "py", "sh": "sh", "bash": "sh", "shell": "sh", "zsh": "sh", "ksh": "sh"}

Token = tuple[int, int, str]


class LexError(ValueError):
    """The source can't be read to its end."""


def detect_language(path: str) -> str | None:
    return EXTENSIONS.get(path.rpartition(".")[2].lower()) if "." in path.rpartition("/")[2] else None


def parse_language(name: str) -> str:
    if name.lower() not in NAMES:
        raise ValueError(f"unsupported comment language {name!r}")
    return NAMES[name.lower()]


LINE_END = r"[^\r\n]*"


def _by_pattern(pattern: re.Pattern) -> Callable[[str, str], list[Token]]:
    """A lexer of a pattern with groups line, block, skip and bad."""

    def scan(source: str, path: str) -> list[Token]:
        out = []
        for m in pattern.finditer(source):
            if m.lastgroup == "bad":
                raise LexError(f"unclosed {m[0]!r} at {m.start()}")
            if m.lastgroup in ("line", "block"):
                out.append((m.start(), m.end(), m.lastgroup))
        return out

    return scan


_go = _by_pattern(re.compile(rf"""(?P<line>//{LINE_END})|(?P<block>/\*.*?\*/)|(?P<skip>"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.[^'\n]*|[^'\\\n])')|(?P<bad>/\*|["`'])""", re.S))
_python = _by_pattern(re.compile(rf'''(?P<line>\#{LINE_END})|(?P<skip>"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?!"")(?:\\.|[^"\\\n])*"|""(?!")|'(?!\'\')(?:\\.|[^'\\\n])*'|\'\'(?!'))|(?P<bad>["'])''', re.S))
_RUST = re.compile(rf"""(?P<line>//{LINE_END})|(?P<open>/\*)|(?P<skip>(?<![0-9A-Za-z_])b?r(?P<h>\#*)".*?"(?P=h)(?!\#)|b?"(?:\\.|[^"\\])*"|'(?:[A-Za-z0-9_](?!'))|b?'(?:\\.[^'\n]*|[^'\\\n])')|(?P<bad>["'])""", re.S)
_RUST_EDGE = re.compile(r"/\*|\*/")


def _rust(source: str, path: str) -> list[Token]:
    out, at = [], 0
    while m := _RUST.search(source, at):
        at = m.end()
        if m.lastgroup == "bad":
            raise LexError(f"unclosed {m[0]!r} at {m.start()}")
        if m["line"] is not None:
            out.append((m.start(), at, "line"))
        elif m["open"]:
            depth = 1
            while depth:
                if not (e := _RUST_EDGE.search(source, at)):
                    raise LexError("unclosed block comment")
                depth, at = depth + (1 if e[0] == "/*" else -1), e.end()
            out.append((m.start(), at, "block"))
    return out


_SHELL = re.compile(rf"""(?P<skip>\\.|'[^']*'|"(?:\\.|[^"\\])*"|<<<)|(?P<line>(?:(?<=[ \t\r\n;|&(){{}}])|\A)\#{LINE_END})|(?P<here><<-?[ \t]*(?:(?P<q>['"])(?P<quoted>.*?)(?P=q)|\\?(?P<plain>[A-Za-z0-9_.$-]*)))|(?P<bad>['"])""", re.S)


def _shell(source: str, path: str) -> list[Token]:
    out, at = [], 0
    while m := _SHELL.search(source, at):
        at = m.end()
        if m["bad"]:
            raise LexError(f"unclosed {m[0]!r} at {m.start()}")
        if m["line"] is not None:
            if not (m.start() == 0 and m[0].startswith("#!")):
                out.append((m.start(), at, "line"))
        elif m["here"]:
            word = m["quoted"] if m["q"] else m["plain"]
            end = re.compile(rf"(?:\r\n|\r|\n)[ \t]*{re.escape(word)}(?=[ \t]*(?:[\r\n]|\Z))").search(source, at) if word else None
            if end is None:
                raise LexError("unclosed heredoc")
            at = end.end()
    return out


_TS = re.compile(rf"""(?P<space>\s+)|(?P<line>//{LINE_END})|(?P<block>/\*.*?\*/)|(?P<string>"(?:\\(?:\r\n|.)|[^"\\\r\n])*"|'(?:\\(?:\r\n|.)|[^'\\\r\n])*')|(?P<bad>/\*|["'])|(?P<word>[A-Za-z0-9_$\u0080-\U0010ffff]+)|(?P<sign>.)""", re.S)
_REGEX = re.compile(r"/(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[A-Za-z]*")
#: Words after which an expression begins, and those whose parenthesis is followed by a statement.
_BEFORE_EXPRESSION = set("return throw case delete void typeof instanceof in of new await yield else do extends default".split())
_CONTROL = {"if", "while", "for", "with", "switch", "catch"}


class _TypeScript:
    def __init__(self, source: str, jsx: bool):
        self.source, self.jsx, self.tokens = source, jsx, []

    def code(self, at: int, until_brace: bool) -> int:
        """Reads code to the end, or past the brace that closes an inserted expression."""
        expression, control, parens, depth = True, False, [], 0
        while at < len(self.source):
            m = _TS.match(self.source, at)
            kind, text = m.lastgroup, m[0]
            if kind == "bad":
                raise LexError(f"unclosed {text!r} at {at}")
            if kind in ("line", "block"):
                self.tokens.append((at, m.end(), kind))
            elif kind == "string":
                expression = control = False
            elif kind == "word":
                control, expression = text in _CONTROL, text in _BEFORE_EXPRESSION
            elif kind == "sign":
                if text == "`":
                    at, expression, control = self.template(at + 1), False, False
                    continue
                if text == "/" and expression:
                    r = _REGEX.match(self.source, at)
                    if r is None:
                        raise LexError(f"unclosed regular expression at {at}")
                    at, expression, control = r.end(), False, False
                    continue
                if text == "<" and expression and self.jsx and re.match(r"<(?:[A-Za-z_$]|>)", self.source[at : at + 2]):
                    mark = len(self.tokens)
                    try:
                        at, expression = self.element(at), False
                        continue
                    except IndexError:  # never closed, so it was a comparison or a type
                        del self.tokens[mark:]
                if text == "(":
                    parens.append(control)
                if text == "}" and until_brace and not depth:
                    return at + 1
                depth += {"{": 1, "}": -1 if depth else 0}.get(text, 0)
                expression = (parens.pop() if parens else False) if text == ")" else text not in "]}."
                control = False
            at = m.end()
        if until_brace:
            raise LexError("unclosed insertion")
        return at

    def template(self, at: int) -> int:
        while m := re.compile(r"\\.|`|\$\{", re.S).search(self.source, at):
            at = m.end()
            if m[0] == "`":
                return at
            if m[0] == "${":
                at = self.code(at, True)
        raise LexError("unclosed template")

    def element(self, at: int) -> int:
        """Reads a JSX element; IndexError if it doesn't end."""
        depth, inside = 0, re.compile(r"""(?P<close></[^>]*>)|(?P<brace>\{)|(?P<open><(?=[A-Za-z_$>]))|(?P<end>\Z)""")
        while True:
            m = inside.search(self.source, at)
            if m["brace"]:
                at = self.code(m.end(), True)
            elif m["close"]:
                depth, at = depth - 1, m.end()
            elif m["open"]:
                at, alone = self.tag(m.end())
                depth += not alone
            else:
                raise IndexError
            if not depth:
                return at

    def tag(self, at: int) -> tuple[int, bool]:
        """Reads the rest of an opening tag: its end, and whether it closes itself."""
        parts = re.compile(r"""(?P<text>"[^"]*"|'[^']*')|(?P<brace>\{)|(?P<alone>/>)|(?P<done>>)""")
        while m := parts.search(self.source, at):
            at = m.end()
            if m["brace"]:
                at = self.code(at, True)
            elif not m["text"]:
                return at, bool(m["alone"])
        raise IndexError


def _typescript(source: str, path: str) -> list[Token]:
    reader = _TypeScript(source, path.lower().endswith((".tsx", ".jsx")))
    reader.code(0, False)
    return sorted(reader.tokens)


LEXERS: dict[str, Callable[[str, str], list[Token]]] = {"go": _go, "ts": _typescript, "rust": _rust, "py": _python, "sh": _shell}


REST, BREAK = re.compile(r"[ \t]*(?:[\r\n]|\Z)"), re.compile(r"(?:\r\n|\r|\n)[ \t]*")


def coalesced(source: str, tokens: list[Token]) -> list[Token]:
    """Comments of one form that fill lines of the same indent, one right after the other, as one."""
    out: list[tuple] = []
    lines = [0, *(m.end() for m in re.finditer(r"[\r\n]", source))]
    for start, end, form in tokens:
        line = source[lines[bisect_right(lines, start) - 1] : start]
        full = not line.strip(" \t") and REST.match(source, end) is not None
        if out and full and (last := out[-1])[2] == form and last[3] == line and BREAK.fullmatch(source, last[1], start):
            out[-1] = (last[0], end, form, line)
        else:
            out.append((start, end, form, line if full else None))
    return [t[:3] for t in out]


def catalog(path: str, language: str, source: str) -> list[tuple]:
    """(id, form, start, end, text) of a file's comments, in code points."""
    return [(f"c{i:04d}", form, a, b, source[a:b]) for i, (a, b, form) in enumerate(coalesced(source, LEXERS[language](source, path)), 1)]


def replacement_is_safe(language: str, source: str, start: int, form: str, replacement: str, path: str = "") -> bool:
    """Whether a replacement of the comment at start reads as one whole comment of that form."""
    line = re.split(r"[\r\n]", source[:start])[-1]
    prefix = line if not line.strip(" \t") else ""
    try:
        found = catalog(path, language, prefix + replacement)
    except LexError:
        return False
    return len(found) == 1 and found[0][1] == form and found[0][4] == replacement


COMMENT = f"path string, language string, sha256 string, comment_id string, form string, {SPAN}, text string, error string"


def comments(files: DataFrame) -> DataFrame:
    """files (path, content, optional language) to COMMENT rows. A file that can't be read has one row with its error, as has
    one of no known language; a file without comments has none. Null contents count as empty."""
    ready(files.sparkSession)
    given = F.col("language") if "language" in files.columns else F.lit(None).cast("string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, name in zip(batch["path"], batch["content"], batch["language"]):
                digest = hashlib.sha256(content.encode()).hexdigest()
                language = NAMES.get((name or "").lower()) or detect_language(path)
                if language is None:
                    out.append((path, None, digest, *[None] * 9, "unsupported language"))
                    continue
                try:
                    at = Positions(content)
                    out += [(path, language, digest, i, form, *at.span(a, b), text, None) for i, form, a, b, text in catalog(path, language, content)]
                except (LexError, RecursionError) as e:
                    out.append((path, language, digest, *[None] * 9, f"comment extraction: {e}"))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in COMMENT.split(", ")])
            yield made.astype({c.split()[0]: "Int32" for c in SPAN.split(", ")})

    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content"), given.alias("language"))
    return rows.mapInPandas(read, COMMENT)


def comment_documents(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The comments of each file as one text document, blank lines between, so that rules see a file as a whole, and where each
    comment begins in it: documents as structure has them, and (doc_id, comment_id, from_byte, to_byte, start_byte, start_line,
    start_column)."""
    rows = found.filter("error is null").select("path", F.struct("start_byte", "comment_id", "start_line", "start_column", "text").alias("c"))
    whole = rows.groupBy("path").agg(F.sort_array(F.collect_list("c")).alias("cs")).withColumn("doc_id", F.xxhash64("path"))
    docs = whole.select("doc_id", F.col("path").alias("source"), F.lit("code-comment").alias("kind"), F.lit("text").alias("format"), F.array_join("cs.text", "\n\n").alias("content"))
    kind = "array<struct<comment_id:string,from_byte:int,to_byte:int,start_byte:int,start_line:int,start_column:int>>"

    def add(acc, c):
        size = F.octet_length(c["text"])
        one = F.struct(c["comment_id"].alias("comment_id"), acc["at"].alias("from_byte"), (acc["at"] + size).alias("to_byte"), c["start_byte"].alias("start_byte"), c["start_line"].alias("start_line"), c["start_column"].alias("start_column"))
        return F.struct(F.concat(acc["out"], F.array(one)).alias("out"), (acc["at"] + size + 2).alias("at"))

    placed = F.aggregate("cs", F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at")), add, lambda acc: acc["out"])
    return docs, whole.select("doc_id", F.inline(placed))


def mapped_to_comments(findings: DataFrame, places: DataFrame) -> DataFrame:
    """Findings on comment documents with comment_id and their bytes in the source file; the others keep null places."""
    p = places.withColumnRenamed("doc_id", "p_doc").withColumnRenamed("start_byte", "p_start").select("p_doc", "comment_id", "from_byte", "to_byte", "p_start")
    out = findings.join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("start_byte") >= F.col("from_byte")) & (F.col("end_byte") <= F.col("to_byte")), "left")
    shift = F.col("p_start") - F.col("from_byte")
    return out.select("doc_id", "source", "rule_id", "comment_id", (F.col("start_byte") + shift).alias("source_start"), (F.col("end_byte") + shift).alias("source_end"), "evidence", "message")
