"""Chat formatting: a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes Python
closures. Templates see only the values given to them: there are no calls but the filters named here, no attributes but the
keys of mappings, no imports and no loops but over sequences.

    {{ expression }}   {% for x in xs %} {% endfor %}   {% if a %} {% elif b %} {% else %} {% endif %}   {% set x = e %}
    {% generation %} {% endgeneration %}   {# remark #}      a - beside a tag's sign strips white space on that side

Expressions have literals, names, x.key, x[e], filters with |, not, and, or, comparisons, in, +, ~ (joins text).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers


class TemplateError(ValueError):
    """The template can't be parsed or goes beyond the sandbox."""


# --- syntax tree ---------------------------------------------------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: object
    key: object


@dataclass
class Apply:
    """An operator or filter on operands."""

    op: str
    args: list


@dataclass
class Text:
    """Output of an expression."""

    value: object


@dataclass
class For:
    name: str
    of: object
    body: list = field(default_factory=list)


@dataclass
class If:
    arms: list  # (condition, body)
    other: list = field(default_factory=list)


@dataclass
class Let:
    name: str
    value: object


@dataclass
class Generation:
    body: list = field(default_factory=list)


# --- filters and operators -----------------------------------------------------------------------------------------


def escape(text: str) -> str:
    """Text in which no control string <|...|> can be read; unescape undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """The same for what must stay on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "escape": escape, "escape_line": escape_line, "string": str}
BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: show(a) + show(b),
}


def show(value: object) -> str:
    return "" if value is None else str(value)


# --- parser --------------------------------------------------------------------------------------------------------

TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+~|.()\[\]]))""", re.S)


class Expression:
    """Recursive descent over one tag's tokens: or, and, not, comparison, sum, filters, items, atoms."""

    def __init__(self, source: str):
        self.tokens, at, self.at = [], 0, 0
        source = source.strip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> object:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> object:
        out = self.both()
        while self.next("or"):
            out = Apply("or", [out, self.both()])
        return out

    def both(self) -> object:
        out = self.negated()
        while self.next("and"):
            out = Apply("and", [out, self.negated()])
        return out

    def negated(self) -> object:
        return Apply("not", [self.negated()]) if self.next("not") else self.compared()

    def compared(self) -> object:
        out = self.joined()
        while op := self.next("==", "!=", "<", ">", "<=", ">=", "in"):
            out = Apply(op, [out, self.joined()])
        return out

    def joined(self) -> object:
        out = self.filtered()
        while op := self.next("+", "~"):
            out = Apply(op, [out, self.filtered()])
        return out

    def filtered(self) -> object:
        out = self.item()
        while self.next("|"):
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Apply("|" + name, [out])
        return out

    def item(self) -> object:
        out = self.atom()
        while sign := self.next(".", "["):
            out = Item(out, Const(self.take("name")) if sign == "." else self.either())
            if sign == "[" and not self.next("]"):
                raise TemplateError("] expected")
        return out

    def take(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> object:
        if self.next("("):
            out = self.either()
            if not self.next(")"):
                raise TemplateError(") expected")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("value expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            return Const(known[value]) if value in known else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """Template text to a list of nodes."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    at, strip = 0, False
    for m in TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if (m[1] or m[4]) else text
        if text:
            stack[-1][2].append(Text(Const(text)))
        at, strip = m.end(), bool(m[3] or m[6])
        if m[2] is not None:
            stack[-1][2].append(Text(Expression(m[2]).whole()))
        elif m[5] is not None:
            statement(m[5].strip(), stack)
    text = source[at:].lstrip() if strip else source[at:]
    if text:
        stack[-1][2].append(Text(Const(text)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return root


def statement(body: str, stack: list) -> None:
    word, _, rest = body.partition(" ")
    kind, node, _ = stack[-1]
    if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
        new = For(m[1], Expression(m[2]).whole())
        stack[-1][2].append(new)
        stack.append(("for", new, new.body))
    elif word == "if":
        new = If([(Expression(rest).whole(), [])])
        stack[-1][2].append(new)
        stack.append(("if", new, new.arms[-1][1]))
    elif word == "elif" and kind == "if":
        node.arms.append((Expression(rest).whole(), []))
        stack[-1] = ("if", node, node.arms[-1][1])
    elif word == "else" and kind == "if":
        stack[-1] = ("else", node, node.other)
    elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest.strip(), re.S)):
        stack[-1][2].append(Let(m[1], Expression(m[2]).whole()))
    elif word == "generation":
        new = Generation()
        stack[-1][2].append(new)
        stack.append(("generation", new, new.body))
    elif word in ("endfor", "endif", "endgeneration") and len(stack) > 1 and kind.replace("else", "if") == word[3:]:
        stack.pop()
    else:
        raise TemplateError(f"unexpected {{% {body} %}}")


# --- folding -------------------------------------------------------------------------------------------------------


def fold(node: object) -> object:
    """An expression with its constant parts computed."""
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if not isinstance(node, Apply):
        return node
    args = [fold(a) for a in node.args]
    if all(isinstance(a, Const) for a in args):
        return Const(expression(Apply(node.op, args))({}))
    if node.op in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
    return Apply(node.op, args)


def fold_body(body: list) -> list:
    """A body with constants folded, arms that can't be reached removed and neighbouring texts joined."""
    out: list = []

    def add(node: Text) -> None:
        value = node.value
        if isinstance(value, Const):
            value = Const(show(value.value))
            if out and isinstance(out[-1], Text) and isinstance(out[-1].value, Const):
                value = Const(out.pop().value.value + value.value)
            if not value.value:
                return
        out.append(Text(value))

    for node in body:
        if isinstance(node, Text):
            add(Text(fold(node.value)))
        elif isinstance(node, For):
            out.append(For(node.name, fold(node.of), fold_body(node.body)))
        elif isinstance(node, Let):
            out.append(Let(node.name, fold(node.value)))
        elif isinstance(node, Generation):
            out.append(Generation(fold_body(node.body)))
        else:
            arms, other = [], fold_body(node.other)
            for condition, inner in node.arms:
                condition = fold(condition)
                if not isinstance(condition, Const):
                    arms.append((condition, fold_body(inner)))
                elif condition.value:
                    other = fold_body(inner)
                    break
            if arms:
                out.append(If(arms, other))
            else:
                for n in other:
                    add(n) if isinstance(n, Text) else out.append(n)
    return out


# --- closures ------------------------------------------------------------------------------------------------------


def expression(node: object) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda names, value=node.value: value
    if isinstance(node, Name):
        return lambda names, name=node.name: names.get(name)
    if isinstance(node, Item):
        of, key = expression(node.of), expression(node.key)

        def item(names: dict) -> object:
            value, k = of(names), key(names)
            if isinstance(value, dict):
                return value.get(k)
            if isinstance(value, (list, tuple, str)) and isinstance(k, int):
                return value[k] if -len(value) <= k < len(value) else None
            raise TemplateError(f"no {k!r} in {type(value).__name__}")

        return item
    args = [expression(a) for a in node.args]
    if node.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.op == "or":
        return lambda names: args[0](names) or args[1](names)
    if node.op == "not":
        return lambda names: not args[0](names)
    call = FILTERS[node.op[1:]] if node.op[0] == "|" else BINARY[node.op]
    if len(args) == 1:
        return lambda names, a=args[0]: call(a(names))
    return lambda names, a=args[0], b=args[1]: call(a(names), b(names))


class Output:
    """Rendered text and the spans of generation blocks in it, in code points."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def writer(body: list) -> Callable[[dict, Output], None]:
    steps = [step(node) for node in body]

    def run(names: dict, out: Output) -> None:
        for s in steps:
            s(names, out)

    return run


def step(node: object) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        if isinstance(node.value, Const):
            return lambda names, out, text=node.value.value: out.add(text)
        value = expression(node.value)
        return lambda names, out: out.add(show(value(names)))
    if isinstance(node, Let):
        value = expression(node.value)
        return lambda names, out, name=node.name: names.__setitem__(name, value(names))
    if isinstance(node, Generation):
        body = writer(node.body)

        def generation(names: dict, out: Output) -> None:
            start = out.size
            body(names, out)
            out.spans.append((start, out.size))

        return generation
    if isinstance(node, For):
        of, body = expression(node.of), writer(node.body)

        def loop(names: dict, out: Output) -> None:
            values = of(names) or ()
            if not isinstance(values, (list, tuple)):
                raise TemplateError("for needs a sequence")
            inner = dict(names)
            for i, value in enumerate(values):
                inner[node.name] = value
                inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(values) - 1}
                body(inner, out)

        return loop
    arms, other = [(expression(c), writer(b)) for c, b in node.arms], writer(node.other)

    def choose(names: dict, out: Output) -> None:
        for condition, body in arms:
            if condition(names):
                return body(names, out)
        return other(names, out)

    return choose


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's values that returns the text and the spans under the loss mask."""
    run = writer(fold_body(parse(source)))

    def render(**values: object) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(values), out)
        return "".join(out.parts), out.spans

    return render


# --- over DataFrames -----------------------------------------------------------------------------------------------

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = """{%- for m in messages -%}
<|im_start|>{{ m.role | escape_line }}{{ '\\n' }}
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
<|im_end|>{{ '\\n' }}
{%- endfor -%}
{%- if add_generation_prompt -%}<|im_start|>assistant{{ '\\n' }}{%- endif -%}"""


def by_message(template: str) -> bool:
    """Whether a template provably gives a conversation's text message by message: it is one loop over messages, and then at most
    a generation prompt, and nothing in the loop looks at the loop, at other messages or at what another round has set."""
    body = fold_body(parse(template))
    if not body or not isinstance(body[0], For) or body[0].of != Name("messages"):
        return False
    rest = body[1:]
    if rest and not (len(rest) == 1 and isinstance(rest[0], If) and not rest[0].other and [c for c, _ in rest[0].arms] == [Name("add_generation_prompt")]):
        return False

    def alone(node: object) -> bool:
        if isinstance(node, Let) or node in (Name("loop"), Name("messages")):
            return False
        inner = node if isinstance(node, (list, tuple)) else [getattr(node, f) for f in getattr(node, "__dataclass_fields__", ())]
        return all(alone(n) for n in inner if isinstance(n, (list, tuple)) or hasattr(n, "__dataclass_fields__"))

    return alone(body[0].body)


def _turns(conversations: DataFrame, key: str) -> DataFrame:
    return conversations.select(F.col(key).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def render_conversations(conversations: DataFrame, template: str = TEMPLATE, key: str = "conv_id") -> DataFrame:
    """Rows (conv_id, turn, role, segment, spans); a conversation's formatted text is its segments in order of turn, role and
    segment, and spans say what of each is under the loss mask. conversations: (conv_id, turn, role, text).

    A template that works message by message gives a segment for each turn, so a conversation of any length needs no memory.
    Any other is rendered on the whole list of a conversation's messages, which a task then holds, as one segment with turn 0
    and an empty role. Messages go by turn, role, then escaped text; null turns come last, null roles and texts count as
    empty, repeated rows are each a turn. An empty table gives an empty result; other columns are ignored.
    """
    if by_message(template):
        return render_turns(conversations, template, key)
    workers(conversations.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))]
    rows = _turns(conversations, key).repartition("conv_id").sortWithinPartitions(*order)

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = compile_template(template)
        turns = ((None if c is pd.NA else int(c), r, t) for b in batches for c, r, t in zip(b["conv_id"].astype("Int64"), b["role"], b["text"]))
        for conv, group in groupby(turns, itemgetter(0)):
            text, spans = run(messages=[{"role": r, "text": t} for _, r, t in group], add_generation_prompt=False)
            yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "turn": [0], "role": [""], "segment": [text], "spans": [[list(s) for s in spans]]})

    return rows.mapInPandas(render, "conv_id long, turn long, role string, segment string, spans array<array<int>>")


def render_turns(conversations: DataFrame, template: str = TEMPLATE, key: str = "conv_id") -> DataFrame:
    """render_conversations for a template that works message by message; TemplateError for any other."""
    if not by_message(template):
        raise TemplateError("the template doesn't work message by message")
    workers(conversations.sparkSession)

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = compile_template(template)
        for batch in batches:
            made = [run(messages=[{"role": r, "text": t}], add_generation_prompt=False) for r, t in zip(batch["role"], batch["text"])]
            yield pd.DataFrame({"conv_id": batch["conv_id"].astype("Int64"), "turn": batch["turn"].astype("Int64"), "role": batch["role"], "segment": [m[0] for m in made], "spans": [[list(s) for s in m[1]] for m in made]})

    return _turns(conversations, key).mapInPandas(render, "conv_id long, turn long, role string, segment string, spans array<array<int>>")


def read_turns(segment: str) -> list[tuple[str, str]]:
    """Role and text of each turn in formatted text."""
    out = []
    for part in segment.split(START)[1:]:
        head, _, rest = part.partition("\n")
        body, found, _ = rest.rpartition(END)
        if not found:
            raise ValueError("a turn has no end")
        out.append((unescape(head), unescape(body)))
    return out


def conversation_report(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from render_conversations' output: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Segments stream by in order, so the hashes need no memory however long a conversation is."""
    workers(turns.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "segment"]
    rows = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segment", "spans")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list = []

        def done() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        for batch in batches:
            out = []
            for conv, segment, spans in zip(batch["conv_id"].astype("Int64"), batch["segment"], batch["spans"]):
                if not now or not (now[0] is conv or (now[0] is not pd.NA and conv is not pd.NA and now[0] == conv)):
                    if now:
                        out.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for start, end in spans:
                    learnt = unescape(segment[start:end])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(segment)
            yield frame(out)
        if now:
            yield frame([done()])

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return rows.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same in DuckDB for the template above.
CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as text_out, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') as role_out from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text_out)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text_out) filter (role = 'assistant'), '')) as loss_sha256,
       sum(24 + length(role_out) + length(text_out))::bigint as formatted_chars
from e group by conv_id
"""
