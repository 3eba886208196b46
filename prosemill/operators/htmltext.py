"""The visible text of HTML, and how it maps to the source."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements that aren't shown, those that begin and end lines, and those without content.
HIDDEN = {"head", "script", "style", "template", "noscript"}
BLOCKS = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
ENTITY = re.compile(r"&[^;]*;")


@dataclass
class Shown:
    """text, and its runs: start, end, start and end in the source, protected, atomic; all in code points."""

    text: str = ""
    runs: list[tuple[int, int, int, int, bool, bool]] = field(default_factory=list)


def project(source: str) -> Shown:
    """The visible text of an HTML source. Comments, hidden elements and tags are left out; block elements and br begin a line;
    code and preformatted text is one protected space; link labels are protected; a decoded entity can only be replaced whole."""
    parts: list[str] = []
    runs: list[list] = []
    size, open_tags, at, raw_until = 0, [], 0, None
    depth = Counter()  # of each open element

    def add(text: str, start: int, end: int, protected: bool, atomic: bool) -> None:
        nonlocal size
        if not text:
            return
        last = runs[-1] if runs else None
        if last and not atomic and not last[5] and last[1] == size and last[4] == protected and last[3] == start:
            last[1], last[3] = size + len(text), end
        else:
            runs.append([size, size + len(text), start, end, protected, atomic])
        parts.append(text)
        size += len(text)

    def line(start: int, end: int) -> None:
        if parts and parts[-1][-1] not in "\n \t":
            add("\n", start, end, False, True)

    def text(start: int, end: int) -> None:
        if start == end or any(depth[h] for h in HIDDEN):
            return
        if depth["code"] or depth["pre"]:
            # A separator keeps its neighbours apart; runs of it never join, as each stands for its own source.
            add(" ", start, end, True, False)
            return
        protected, last = depth["a"] > 0, start
        for m in ENTITY.finditer(source, start, source.rfind(";", start, end) + 1):
            decoded = html.unescape(m[0])
            if decoded != m[0]:
                add(source[last : m.start()], last, m.start(), protected, False)
                add(decoded, m.start(), m.end(), protected, True)
                last = m.end()
        add(source[last:end], last, end, protected, False)

    last_end = source.rfind(">")
    while at < len(source):
        if at > last_end:  # no tag ends any more; a remark or a broken tag hides the rest
            cut = None if raw_until else re.compile("<[!?/]").search(source, at)
            text(at, cut.start() if cut else len(source))
            break
        m = (re.compile(rf"</(?P<name>{raw_until})(?=[\s/>])(?P<rest>[^>]*)>", re.I) if raw_until else TOKEN).search(source, at)
        if m is None:
            text(at, len(source))
            break
        text(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if raw_until or m["end"]:
            raw_until = None
            if depth[name]:
                while (closed := open_tags.pop()) != name:
                    depth[closed] -= 1
                depth[name] -= 1
            if name in BLOCKS:
                line(m.start(), m.end())
            continue
        if name in BLOCKS or name == "br":
            line(m.start(), m.end())
        closed = m["rest"].endswith("/")
        if not closed and name not in VOID:
            open_tags.append(name)
            depth[name] += 1
        if name in RAW and not closed:
            raw_until = re.escape(name)
    return Shown("".join(parts), [tuple(r) for r in runs])
