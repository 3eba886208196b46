"""Patterns and column functions on text. All of them are built-in expressions; nothing here runs Python on rows.

Patterns are written for RE2's rules, where word boundaries, digits and white space are ASCII, and turned into Java's with
ascii_boundary, so that a result doesn't depend on the engine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens of prose, of noun stacks (with the marks that end a clause) and of corpus counts.
LEX_TOKEN = r"[\p{L}\p{Nd}]+(?:(?:['’-][\p{L}\p{Nd}]|\.\p{Nd})[\p{L}\p{Nd}]*)*"
STACK_SCAN = r"[—–;:]|[\p{L}\p{Nd}]+(?:['’-][\p{L}\p{Nd}]+)*"
CORPUS_TOKEN = r"[\p{L}\p{Nd}](?:[\p{L}\p{Nd}'’-]*[\p{L}\p{Nd}])?"
#: The first two for engines that backtrack: nothing is ever given back, so matches are the same, and Java needs no stack for
#: each part of a token, however long it is.
POSSESSIVE = {LEX_TOKEN: r"[\p{L}\p{Nd}]++(?:(?:['’-][\p{L}\p{Nd}]|\.\p{Nd})[\p{L}\p{Nd}]*+)*+", STACK_SCAN: r"[—–;:]|[\p{L}\p{Nd}]++(?:['’-][\p{L}\p{Nd}]++)*+"}
#: What stands before a word's first letter or digit and after its last; the latter is tried once for each run of such characters.
EDGE_BEFORE, EDGE_AFTER = r"^[^\p{L}\p{Nd}]+", r"(?<![^\p{L}\p{Nd}])[^\p{L}\p{Nd}]++$"
IDENTIFIER = r"(?s).\p{Lu}|\p{Nd}"
_WORD = "[0-9A-Za-z_]"
ASCII_B = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
SPACES = r"[\t\n\f\r ]"
#: Characters that are trimmed from the ends of spelled terms and of heading words.
TERM_EDGES, HEADING_EDGES = "()[]{}.,;:!?'\"", ",.;:!?\"'`()[]{}\t "


def ascii_boundary(pattern: str) -> str:
    r"""A pattern of RE2 for Java: \b, \w, \d and \s mean ASCII."""
    return pattern.replace(r"\b", ASCII_B).replace(r"\w", _WORD).replace(r"\d", "[0-9]").replace(r"\s", SPACES)


def tokens(text: Column, pattern: str = LEX_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(POSSESSIVE.get(pattern, pattern)), F.lit(0))


def lower(text: Column) -> Column:
    """Lower case, one letter for each: a capital I with a dot gives i, where Java gives i and a combining dot."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def literal(text: str) -> str:
    """A string as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, *fields: str) -> str:
    """SQL for the sums of the int fields of an array of structs up to each element, itself included, as an array of structs of
    those. values is the name of a lambda's variable.

    Each round adds to every sum the one that lies twice as far back as in the round before, so n elements take n log n steps
    and arrays are never grown one by one.
    """
    steps = f"filter(array({', '.join(str(1 << k) for k in range(31))}), d -> d < size({values}))"
    first = ", ".join(f"'{f}', x.{f}" for f in fields)
    added = ", ".join(f"'{f}', x.{f} + get(acc, i - d).{f}" for f in fields)
    return f"aggregate({steps}, transform({values}, x -> named_struct({first})), (acc, d) -> transform(acc, (x, i) -> if(i < d, x, named_struct({added}))))"


def bound_sql(value: str, name: str, body: str) -> str:
    """bound in SQL: body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def positions(text: str, pattern: str) -> Column:
    """positions_sql as a column."""
    return F.expr(positions_sql(text, pattern))


def positions_sql(text: str, pattern: str) -> str:
    """Matches in the column text of a pattern that never matches the empty string, in order, as an array of structs: match, start
    and end in bytes, col: the code points before it, prev: the character before it ('' at the start).

    The pieces between matches come from split, so running sums over both give every offset. As SQL the expression is handed to
    the JVM in one call; rules name hundreds of them.
    """
    p = literal(pattern)
    pairs = bound_sql(f"regexp_extract_all(`{text}`, {p}, 0)", "f", f"zip_with(f, slice(split(`{text}`, {p}, -1), 1, size(f)), (m, s) -> named_struct('m', m, 's', s, 'byte', octet_length(s) + octet_length(m), 'col', length(s) + length(m)))")
    both = bound_sql(pairs, "every", f"named_struct('every', every, 'ends', {running('every', 'byte', 'col')})")
    one = """named_struct('match', x.m, 'start', get(b.ends, i).byte - octet_length(x.m), 'end', get(b.ends, i).byte, 'col', get(b.ends, i).col - length(x.m),
        'prev', case when length(x.s) > 0 then right(x.s, 1) when i > 0 then right(get(b.every, i - 1).m, 1) else '' end)"""
    return bound_sql(both, "b", f"transform(b.every, (x, i) -> {one})")


def totals(values: str) -> str:
    """running for an array of numbers: cheaper by far, as no struct is made."""
    steps = f"filter(array({', '.join(str(1 << k) for k in range(31))}), d -> d < size({values}))"
    return f"aggregate({steps}, {values}, (acc, d) -> transform(acc, (x, i) -> if(i < d, x, x + get(acc, i - d))))"


def core_sql(word: str) -> str:
    """SQL for a word without what stands around its first and last letter or digit; nothing does in most words."""
    return f"if({word} rlike {literal(r'^[0-9A-Za-z]++\z')}, {word}, regexp_replace(regexp_replace({word}, {literal(EDGE_BEFORE)}, ''), {literal(EDGE_AFTER)}, ''))"


def words(text: str, covers: str | None = None) -> Column:
    """The parts of the column text between white space, in order, as an array of structs: match, clean (core_sql of it) and end:
    where it ends, in bytes times 2^32 plus code points. Those whose clean part a match of the pattern covers has inside are left out.

    Matches of covers don't overlap, so the only one that can have such a part inside is the last that begins no later; a search
    by halves finds it, in words that some match touches. Texts without a match skip all that. All is one expression: as columns
    the optimizer would write the matches out inside the lambdas, and the clean part wherever it is used.
    """
    size = "shiftleft(bigint(octet_length(get(gs, i)) + octet_length(w)), 32) + length(get(gs, i)) + length(w)"
    sizes = bound_sql(f"split(`{text}`, '\\\\S+', -1)", "gs", f"transform(ws, (w, i) -> {size})")
    ends = bound_sql(sizes, "ns", totals("ns"))
    every = bound_sql(f"regexp_extract_all(`{text}`, '\\\\S+', 0)", "ws", bound_sql(ends, "es", f"transform(ws, (w, i) -> named_struct('match', w, 'clean', {core_sql('w')}, 'end', get(es, i)))"))
    if covers is None:
        return F.expr(every)
    halves = f"filter(array({', '.join(str(1 << k) for k in reversed(range(31)))}), d -> d < size(vs))"
    last = lambda at: f"get(vs, aggregate(hs, 0, (k, d) -> if(coalesce(get(vs, k + d).start <= {at}, false), k + d, k)))"
    begin = f"z - octet_length(x.match) + octet_length(regexp_extract(x.match, {literal(EDGE_BEFORE + '|^')}, 0))"
    inside = bound_sql(begin, "b", bound_sql(last("b"), "v", f"v.start <= b and v.end >= b + octet_length(x.clean)"))
    touched = bound_sql(last("z - 1"), "v", "v.start < z and v.end > z - octet_length(x.match)")
    covered = bound_sql("int(shiftright(x.end, 32))", "z", f"if({touched}, {inside}, false)")
    free = bound_sql(positions_sql(text, covers), "vs", bound_sql(halves, "hs", f"filter({every}, x -> not {covered})"))
    return F.expr(f"if(`{text}` rlike {literal(covers)}, {free}, {every})")


def is_word(term: str) -> bool:
    """Whether a term is one word that begins and ends with a letter or digit."""
    edges = [unicodedata.category(c) for c in (term[:1] + term[-1:])]
    return bool(edges) and all(c[0] == "L" or c == "Nd" for c in edges) and not any(c in "\t\n\v\f\r " for c in term)


def whole_term(terms: list[str]) -> str:
    """A pattern for any of terms as whole tokens, letters and digits being word characters, whatever the case; the longest
    alternative first."""
    quoted = "|".join(quote(t) for t in sorted(terms, key=lambda t: (-len(t.encode()), t)))
    return rf"(?iu)(?<![\p{{L}}\p{{Nd}}])(?:{quoted})(?![\p{{L}}\p{{Nd}}])"


def quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#/" else c for c in text)


def trim_chars(text: Column, chars: str) -> Column:
    """text without any of chars at its ends."""
    return F.btrim(text, F.lit(chars))


def fields(text: Column) -> Column:
    """The parts of a text between white space."""
    return F.filter(F.split(text, r"[\s\x85\xa0  -     　]+"), lambda x: x != "")


def phrases(text: Column) -> Column:
    """Phrases of two and three words in lower case, in order of their first word; all but letters, digits and - parts words."""
    split = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}\-]", " ")), " +"), lambda x: x != "")

    def of(words: Column) -> Column:
        def at(i: Column) -> Column:
            pair = F.array_join(F.slice(words, i, F.lit(2)), " ")
            return F.when(i + 1 < F.size(words), F.array(pair, F.array_join(F.slice(words, i, F.lit(3)), " "))).otherwise(F.array(pair))

        return F.when(F.size(words) >= 2, F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - 1), at))).otherwise(F.array().cast("array<string>"))

    return bound(split, of)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def is_identifier(token: Column) -> Column:
    """Tokens with a capital after the first character or a digit."""
    return token.rlike(IDENTIFIER)


def is_url_or_path(token: Column) -> Column:
    """Addresses, paths, issue numbers, versions and package names."""
    return token.rlike(r"(?i)^(?:https?|ftp)://") | (token.contains("/") & token.contains(".")) | token.rlike(r"^[#@]|^(?:v?[0-9][^.]*|v)\.")


def heading_words(text: Column) -> Column:
    """Words of a heading that have a letter, without the punctuation around them."""
    return F.filter(F.transform(fields(text), lambda w: trim_chars(w, HEADING_EDGES)), lambda w: w.rlike(r"\p{L}"))


def is_capitalized(word: Column) -> Column:
    return F.regexp_extract(word, r"\p{L}", 0).rlike(r"\p{Lu}")


def utf8_prefix(text: Column, limit: int) -> Column:
    """The longest prefix of at most limit bytes that ends between characters."""
    raw = text.cast("binary")
    ends = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda back: (F.hex(F.substring(raw, F.lit(limit + 1) - back, F.lit(1))) < "80") | (F.hex(F.substring(raw, F.lit(limit + 1) - back, F.lit(1))) >= "C0"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(raw, F.lit(1), F.lit(limit) - F.element_at(ends, 1)).cast("string"))


def sanitized(text: Column, space: bool = False) -> Column:
    """text without control characters but line breaks and tabs; or each of all of them as a space."""
    return F.regexp_replace(text, r"\p{Cc}", " ") if space else F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "")


def greedy(matches: Column) -> Column:
    """Of matches (structs with start and end) in order of precedence, those that share no byte with an accepted one."""
    kind = "array<struct<start:int,end:int>>"

    def add(acc: Column, m: Column) -> Column:
        free = ~F.exists(acc["taken"], lambda t: (t["start"] < m["end"]) & (m["start"] < t["end"]))
        one = F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"))
        return F.struct(F.when(free, F.concat(acc["taken"], F.array(one))).otherwise(acc["taken"]).alias("taken"))

    accepted = F.aggregate(matches, F.struct(F.array().cast(kind).alias("taken")), add, lambda acc: acc["taken"])
    return F.filter(matches, lambda m: F.exists(accepted, lambda t: (t["start"] == m["start"]) & (t["end"] == m["end"])))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
