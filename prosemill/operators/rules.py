"""The rules: each maps the tables of a Context to findings, in built-in expressions.

FINDING is every rule's schema. Rules on segments keep their matches in arrays and explode them once; rules that look across
a document use windows by document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import structure
from prosemill.plans.profile import Profile

FINDING = ["doc_id", "source", "rule_id", "rule_version", "checker", "checker_version", "enforcement", "severity", "start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column", "evidence", "message", "suggestion", "confidence"]
PLACE = FINDING[8:14]


class Context:
    """Documents and what is read from them, each part planned when a rule asks for it. tables: parts made before."""

    def __init__(self, docs: DataFrame, profile: Profile, comparison: dict | None = None, **tables: DataFrame):
        self.docs, self.profile, self.comparison, self.tables = docs, profile, comparison, tables

    @cached_property
    def prose(self) -> DataFrame:
        return self.tables["prose"] if "prose" in self.tables else structure.prose(self.docs)

    @cached_property
    def blocks(self) -> DataFrame:
        return self.tables["blocks"] if "blocks" in self.tables else structure.blocks(self.docs)

    @cached_property
    def sentences(self) -> DataFrame:
        return self.tables["sentences"] if "sentences" in self.tables else structure.sentences(self.docs)


Rule = Callable[[Context], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    def register(fn: Rule) -> Rule:
        RULES["CORE." + name] = fn
        return fn

    return register


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def finding(df: DataFrame, ctx: Context, rule_id: str, evidence: Column, message: Column | str, suggestion: Column | None = None, policy: tuple[str, str] | None = None, placed: bool = True) -> DataFrame:
    """df's rows as findings; its columns PLACE say where, unless placed is False."""
    enforcement, severity = policy or ctx.profile.policy(rule_id)
    place = [F.col(c).cast("int").alias(c) if placed else F.lit(None).cast("int").alias(c) for c in PLACE]
    message = F.lit(message) if isinstance(message, str) else message
    return df.select(
        "doc_id", "source", F.lit(rule_id).alias("rule_id"), F.lit(1).alias("rule_version"), F.lit(rule_id).alias("checker"), F.lit(1).alias("checker_version"), F.lit(enforcement).alias("enforcement"), F.lit(severity).alias("severity"),
        *place, evidence.alias("evidence"), message.alias("message"), (suggestion if suggestion is not None else F.lit(None).cast("string")).alias("suggestion"), F.lit(1.0).alias("confidence"),
    )


def exploded(segments: DataFrame, matches: Column) -> DataFrame:
    """A row for each match of a segment, with its place in the source, match and prev."""
    rows = segments.withColumn("m", F.explode(matches))
    out = {"start_byte": F.col("start_byte") + F.col("m.start"), "end_byte": F.col("start_byte") + F.col("m.end"), "end_line": F.col("start_line"), "end_column": F.col("start_column") + F.col("m.col") + F.length("m.match"), "start_column": F.col("start_column") + F.col("m.col")}
    return rows.select("doc_id", "source", "kind", "seg_no", "start_line", *[c.alias(k) for k, c in out.items()], F.col("m.match").alias("match"), F.col("m.prev").alias("prev"))


def matched(segments: DataFrame, pattern: str) -> DataFrame:
    """exploded over a pattern; segments without a match go before any position is counted."""
    return exploded(segments.filter(F.col("text").rlike(pattern)), T.positions("text", pattern))


def pattern_rule(name: str, pattern: str, label: str, message: str | Callable[[Context, Column], Column]) -> None:
    rule_id, java = "CORE." + name, T.ascii_boundary(pattern)

    def run(ctx: Context) -> DataFrame:
        rows = matched(ctx.prose, java)
        said = message if isinstance(message, str) else message(ctx, F.lower("match"))
        return finding(rows, ctx, rule_id, F.concat(F.lit(label + ": "), quoted(F.col("match"))), said)

    RULES[rule_id] = run


def _advice(key: str, otherwise: str) -> Callable[[Context, Column], Column]:
    """What the profile says about a word, or a general line."""

    def message(ctx: Context, word: Column) -> Column:
        out = F.lit(otherwise)
        for k, v in ctx.profile.dictionary.get(key, {}).items():
            out = F.when(word == k, v).otherwise(out) if v else out
        return out

    return message


# --- words ---------------------------------------------------------------------------------------------------------
# The patterns and phrases of the rules.

pattern_rule("CONTRACTION", r"(?i)\b\w+(?:n't|'ll|'re|'ve|'d)\b|\b(?:it's|that's|there's|here's|what's|who's|let's)\b", "contraction", "Write both words out.")
pattern_rule("BANNED_MODAL", r"(?i)\b(?:should|would|may|might|could)\b", "banned modal", _advice("banned_modal_suggestions", "Choose a modal that the profile approves."))
pattern_rule("LATIN_ABBREV", r"(?i)\b(?:e\.g\.|i\.e\.|etc\.?)", "Latin abbreviation", _advice("banned_latin_abbrev_suggestions", "Say it in English."))
pattern_rule("ORDINAL_NUMERAL", r"(?i)\b\d{1,3}(?:st|nd|rd|th)\b", "ordinal numeral", "Write the ordinal as a word.")
pattern_rule("PERCENT_STYLE", r"(?i)\b\d+(?:\.\d+)?\s+percent\b", "spelled-out percent", "After a numeral use the sign, as in 40%.")
TIME_ANCHORS = [
    "as of this writing", "as of today", "as of now", "at the time of writing", "at this time", "at present", "currently", "presently", "recently", "eventually",
    "in the future", "in the near future", "does not yet", "do not yet", "doesn't yet", "don't yet", "coming soon", "going forward", "now supports", "now includes",
    "now lets", "now enables", "now can", "is now available", "is now supported", "is now enabled", "is now deprecated", "is now required", "is now optional",
]
ANCHOR_MESSAGE = "This phrase dates the text. Say what holds; texts that carry a date may keep it."
HEADING_STOPWORDS = "a an the and or but nor for as at by in of on to with vs is are was were be it its".split()
SEQUENCE_WORDS = "first second third fourth fifth sixth seventh eighth ninth tenth then next finally lastly".split()


@rule("AMBIGUOUS_DATE")
def ambiguous_date(ctx: Context) -> DataFrame:
    rows = matched(ctx.prose, T.ascii_boundary(r"\b(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b"))
    rows = rows.filter((F.split("match", "/")[1].cast("int") <= 12) & (F.col("prev") != "/"))
    return finding(rows, ctx, "CORE.AMBIGUOUS_DATE", F.concat(F.lit("ambiguous date: "), quoted(F.col("match"))), "Readers differ on which number is the month. Name the month, or begin with the year as in 2025-03-04.")


@rule("EXCLAMATION")
def exclamation(ctx: Context) -> DataFrame:
    evidence = F.concat(F.lit("exclamation point at "), F.col("start_line").cast("string"), F.lit(":"), F.col("start_column").cast("string"))
    return finding(matched(ctx.prose, "!"), ctx, "CORE.EXCLAMATION", evidence, "End the sentence with a full stop.")


@rule("TIME_ANCHOR")
def time_anchor(ctx: Context) -> DataFrame:
    rows = ctx.prose.filter(F.col("text").rlike(T.whole_term(TIME_ANCHORS)))
    found = F.concat(*[T.positions("text", T.whole_term([p])) for p in TIME_ANCHORS])
    longer = lambda a, b: (a["start"] <= b["start"]) & (b["end"] <= a["end"]) & (a["end"] - a["start"] > b["end"] - b["start"])
    outer = F.filter("found", lambda m: ~F.exists("found", lambda o: longer(o, m)))
    return finding(exploded(rows.withColumn("found", found), outer), ctx, "CORE.TIME_ANCHOR", F.concat(F.lit("time anchor: "), quoted(F.col("match"))), ANCHOR_MESSAGE)


def numbered(matches: Column, entry: int) -> Column:
    return F.transform(matches, lambda m: m.withField("entry", F.lit(entry)))


def differs(spelling: str) -> Callable[[Column], Column]:
    return lambda m: m["match"] != spelling


@rule("TERM_DISCOURAGED")
def term_discouraged(ctx: Context) -> DataFrame:
    """Longer terms first; a match that shares a byte with an accepted one is passed over."""
    entries = [e for e in ctx.profile.dictionary["entries"] if e["status"] == "discouraged"]
    entries.sort(key=lambda e: -len(e["term"].encode()))
    rule_id = "CORE.TERM_DISCOURAGED"
    policy = ctx.profile.policy(rule_id, "enforced", "warning")
    if not entries:
        return finding(exploded(ctx.prose.limit(0), T.positions("text", "!")), ctx, rule_id, F.lit(""), "", policy=policy)
    rows = ctx.prose.filter(F.col("text").rlike(T.whole_term([e["term"] for e in entries])))
    found = F.concat(*[numbered(T.positions("text", T.whole_term([e["term"]])), i) for i, e in enumerate(entries)])
    rows = rows.withColumn("m", F.explode(T.greedy(found)))
    out = exploded_with_entry(rows)

    def choose(values: list[str | None]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("entry") + 1)

    joined = [", ".join(e.get("alternatives") or []) for e in entries]
    evidence = choose([f"'{e['term']}' is discouraged" + (f"; use '{j}' instead" if j else "") for e, j in zip(entries, joined)])
    return finding(out, ctx, rule_id, evidence, choose([e["reason"] for e in entries]), choose([j or None for j in joined]), policy)


def exploded_with_entry(rows: DataFrame) -> DataFrame:
    """Rows whose column m is a match with an entry number, as exploded gives them."""
    return rows.select(
        "doc_id", "source", "kind", "seg_no", "start_line", (F.col("start_byte") + F.col("m.start")).alias("start_byte"), (F.col("start_byte") + F.col("m.end")).alias("end_byte"), F.col("start_line").alias("end_line"),
        (F.col("start_column") + F.col("m.col")).alias("start_column"), (F.col("start_column") + F.col("m.col") + F.length("m.match")).alias("end_column"), F.col("m.match").alias("match"), F.col("m.entry").alias("entry"),
    )


@rule("TERM_CASE")
def term_case(ctx: Context) -> DataFrame:
    rule_id, entries = "CORE.TERM_CASE", [e for e in ctx.profile.dictionary["entries"] if e.get("canonical_case")]
    if not entries:
        return finding(exploded(ctx.prose.limit(0), T.positions("text", "!")), ctx, rule_id, F.lit(""), "", policy=("enforced", "warning"))
    rows = ctx.prose.filter(F.col("text").rlike(T.whole_term([e["term"] for e in entries])))
    found = F.concat(*[F.filter(numbered(T.positions("text", T.whole_term([e["term"]])), i), differs(e["canonical_case"])) for i, e in enumerate(entries)])
    out = exploded_with_entry(rows.withColumn("m", F.explode(found)))
    right = F.element_at(F.array(*[F.lit(e["canonical_case"]) for e in entries]), F.col("entry") + 1)
    return finding(out, ctx, rule_id, F.concat(F.lit("canonical case is "), quoted(right)), "The dictionary writes this term in another case.", policy=("enforced", "warning"))


@rule("TERM_UNKNOWN")
def term_unknown(ctx: Context) -> DataFrame:
    """Words that no dictionary term covers, where the profile's policy asks for them."""
    rule_id, policy = "CORE.TERM_UNKNOWN", ("candidate", "info")
    known = [e["term"] for e in ctx.profile.dictionary["entries"]]
    lines = ctx.prose.filter(F.col("text").rlike(r"[\p{L}\p{Nd}]")) if ctx.profile.rules.get("unknown_term_policy") == "candidate" else ctx.prose.limit(0)
    # A term of one word covers what equals it. The others lie in one segment each, so its words are held against its own such
    # terms: nothing is joined.
    alone, phrases = [k for k in known if T.is_word(k)], [k for k in known if not T.is_word(k)]
    rows = lines.withColumn("m", F.explode(T.words("text", T.whole_term(phrases) if phrases else None)))
    rows = rows.filter("m.clean <> ''")
    if alone:
        rows = rows.filter(~T.lower(F.col("m.clean")).isin([k.replace("İ", "i").lower() for k in alone]))
    end, column = F.shiftright("m.end", 32), F.col("start_column") + F.col("m.end").bitwiseAND(0xFFFFFFFF)
    rows = rows.select(
        "doc_id", "source", (F.col("start_byte") + end - F.octet_length("m.match")).alias("start_byte"), (F.col("start_byte") + end).alias("end_byte"), "start_line", F.col("start_line").alias("end_line"),
        (column - F.length("m.match")).alias("start_column"), column.alias("end_column"), F.col("m.clean").alias("clean"),
    )
    said = F.concat(F.lit("Unknown term: "), F.col("clean"))
    return finding(rows, ctx, rule_id, said, said, policy=policy)


@rule("TERM_CONSISTENCY")
def term_consistency(ctx: Context) -> DataFrame:
    """Spellings that differ from a document's first of the same key, which is the word without hyphens in lower case."""
    parts = F.transform(T.fields(F.col("text")), lambda w: T.trim_chars(w, T.TERM_EDGES))
    rows = ctx.prose.select("doc_id", "source", "seg_no", F.posexplode(parts).alias("pos", "term")).filter("term <> ''")
    rows = rows.withColumn("key", F.lower(F.replace("term", F.lit("-"), F.lit(""))))
    w = Window.partitionBy("doc_id", "key").orderBy("seg_no", "pos")
    rows = rows.withColumn("first", F.first("term").over(w)).filter("term <> first")
    evidence = F.concat(F.lit("term spelled as "), quoted(F.col("first")), F.lit(" and "), quoted(F.col("term")))
    return finding(rows, ctx, "CORE.TERM_CONSISTENCY", evidence, "The document spells this term in two ways.", policy=("candidate", "info"), placed=False)


@rule("PROCEDURE_MULTI_ACTION")
def procedure_multi_action(ctx: Context) -> DataFrame:
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    rows = ctx.prose.withColumn("t", text).filter((F.octet_length("t") >= 3) & F.col("t").rlike("^[0-9]") & F.col("t").contains(".") & F.lower("t").rlike(" (?:and|or) "))
    return finding(rows, ctx, "CORE.PROCEDURE_MULTI_ACTION", F.concat(F.lit("step contains multiple actions: "), quoted(F.col("t"))), "Give each action a step of its own.", policy=("candidate", "info"))


CAPS = r"(?<![\p{L}\p{Nd}_$])[A-Z]{2,5}(?![\p{L}\p{Nd}_$])"


def expanded(t: str, stopwords: frozenset[str]) -> list[str]:
    """Lower-case abbreviations that a text expands in parentheses, in either order: XY (x-words y-words), and the reverse.
    Words are listed once, so time is in proportion to the text's length."""
    counts = lambda w: w.lower() not in stopwords and len(w.encode()) >= 2
    initial = lambda w: w[0].upper() if w[0].isascii() else w[0]
    runs = [(m.start(), m[0]) for m in re.finditer(r"(?:-|[^\W_])+", t)]
    # Words may begin with hyphens but not end with one before a parenthesis, and the other way round in it.
    ahead = [(at + len(w), initial(w)) for at, run in runs if (w := run.rstrip("-")) and counts(w)]
    inside = [(at + len(run) - len(run.lstrip("-")), initial(w)) for at, run in runs if (w := run.lstrip("-")) and counts(w)]
    ends, starts = [at for at, _ in ahead], [at for at, _ in inside]
    out, close = set(), -1
    for m in re.finditer(r"\(", t):
        at = m.start()
        if close < at and (close := t.find(")", at)) < 0:
            break
        if short := re.compile(r"\(\s*([A-Z]{2,5})\s*\)").match(t, at):
            n = bisect_right(ends, at)
            if "".join(c for _, c in ahead[max(0, n - 16) : n])[-16:].endswith(short[1]):
                out.add(short[1].lower())
            continue
        before = at
        while before and t[before - 1].isspace():
            before -= 1
        if (w := re.search(r"(?:[-'’]|[^\W_])+$", t[max(0, before - 6) : before])) and re.fullmatch("[A-Z]{2,5}", w[0]):
            n = bisect_right(starts, at)
            if "".join(c for start, c in inside[n : n + 5] if start < close).startswith(w[0]):
                out.add(w[0].lower())
    return sorted(out)


def expansions(text: Column, stopwords: list[str]) -> Column:
    """expanded over a column."""
    small = frozenset(stopwords)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([expanded(t, small) for t in texts])

    return found(text)


@rule("UNEXPANDED_ABBREV")
def unexpanded_abbrev(ctx: Context) -> DataFrame:
    """The first place of each short capital word that a document nowhere expands. Only segments with parentheses and capitals
    are searched for expansions."""
    rows = matched(ctx.prose, CAPS).withColumn("key", F.lower("match"))
    known = sorted({*ctx.profile.words("stopword"), *ctx.profile.words("known_abbrev")})
    rows = rows.filter(~F.col("key").isin(known)) if known else rows
    said = ctx.prose.filter(F.col("text").contains("(") & F.col("text").rlike("[A-Z]{2,5}")).select(F.col("doc_id").alias("d"), F.explode(expansions(F.col("text"), ctx.profile.words("stopword"))).alias("k")).distinct()
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("start_byte"))).filter("at = 1")
    first = first.join(said, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")), "left_anti")
    message = F.concat(F.lit("Nowhere does the document say what "), quoted(F.col("match")), F.lit(" stands for; this is its first use."))
    return finding(first, ctx, "CORE.UNEXPANDED_ABBREV", F.concat(F.lit("unexpanded abbreviation: "), quoted(F.col("match"))), message)


# --- sentences -----------------------------------------------------------------------------------------------------


def sentence_limit(profile: Profile, kind: Column) -> Column:
    """Most words of a sentence by kind; 0 for none. Kinds without a limit of their own have that of descriptions."""
    own = {k: profile.parameter("CORE.SENTENCE_LENGTH", f"{k}_max_words") for k in ("description", "procedure", "pr")}
    return F.when(kind == "procedure", own["procedure"]).when(kind == "pr", own["pr"]).otherwise(own["description"])


@rule("SENTENCE_LENGTH")
def sentence_length(ctx: Context) -> DataFrame:
    # So many words and what parts them are twice as many characters, so shorter sentences needn't leave the parser.
    limits = [n for k in ("description", "procedure", "pr") if (n := ctx.profile.parameter("CORE.SENTENCE_LENGTH", f"{k}_max_words")) > 0]
    sentences = ctx.sentences if "sentences" in ctx.tables else structure.sentences(ctx.docs, 2 * min(limits, default=0) + 1)
    rows = sentences.withColumn("words", F.size(T.tokens(F.col("text")))).withColumn("most", sentence_limit(ctx.profile, F.col("kind")))
    evidence = F.concat(F.col("words").cast("string"), F.lit(" words; profile limit is "), F.col("most").cast("string"))
    return finding(rows.filter("most > 0 and words > most"), ctx, "CORE.SENTENCE_LENGTH", evidence, "Make several sentences of it, each with one claim.", policy=("enforced", "warning"))


@rule("DENSE_PARAGRAPH")
def dense_paragraph(ctx: Context) -> DataFrame:
    """Blocks of too many sentences or words, summed before anything moves."""
    most = ctx.profile.parameter("CORE.DENSE_PARAGRAPH", "max_sentences", 3), ctx.profile.parameter("CORE.DENSE_PARAGRAPH", "max_words", 50)
    place = [F.col("block_" + c).alias(c) for c in PLACE]
    rows = ctx.sentences.select("doc_id", "source", "block_no", *place, F.size(T.tokens(F.col("text"))).alias("words"))
    rows = rows.groupBy("doc_id", "source", "block_no", *PLACE).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    evidence = F.concat(F.col("n").cast("string"), F.lit(" sentences; "), F.col("words").cast("string"), F.lit(" words"))
    return finding(rows.filter((F.col("n") > most[0]) | (F.col("words") > most[1])), ctx, "CORE.DENSE_PARAGRAPH", evidence, "Break the paragraph up.", policy=("candidate", "info"))


@rule("GERUND_OPENER")
def gerund_opener(ctx: Context) -> DataFrame:
    rows = ctx.sentences.filter("marker = ''").withColumn("tokens", T.tokens(F.col("text"))).filter("size(tokens) >= 2")
    first, after = F.lower(F.col("tokens")[0]), F.lower(F.col("tokens")[1])
    rows = rows.filter(first.endswith("ing") & (F.length(first) >= 6) & after.isin(ctx.profile.words("gerund_determiner")))
    evidence = F.concat(F.lit("sentence opens with gerund "), quoted(F.col("tokens")[0]))
    return finding(rows, ctx, "CORE.GERUND_OPENER", evidence, "Begin with an imperative, or with who does it.", policy=("candidate", "info"))


def stack_runs(text: Column, stopwords: list[str]) -> Column:
    """Runs of words that aren't stopwords and cross no mark that ends a clause: structs of words and of the stopword before
    them ('' at a sentence's or clause's start)."""
    mark = lambda t: t.isin("—", "–", ";", ":")

    def runs(b: Column) -> Column:
        words, cuts = b["words"], b["cuts"]

        def one(at: Column, k: Column) -> Column:
            last = F.get(cuts, k - 1)
            head = F.get(words, last)
            before = F.when((last < 0) | mark(head), "").otherwise(T.lower(head))
            return F.when(k > 0, F.struct(F.slice(words, last + 2, at - last - 1).alias("words"), before.alias("before")))

        return F.filter(F.transform(cuts, one), lambda r: F.size(r["words"]) > 0)

    def cut(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda t, i: F.when(mark(t) | T.lower(t).isin(stopwords), i)), lambda i: i.isNotNull())
        return F.struct(words.alias("words"), F.concat(F.array(F.lit(-1)), at, F.array(F.size(words))).alias("cuts"))

    return T.bound(T.bound(T.tokens(text, T.STACK_SCAN), cut), runs)


@rule("NOUN_STACK")
def noun_stack(ctx: Context) -> DataFrame:
    p = ctx.profile
    least = p.parameter("CORE.NOUN_STACK", "min_stack_length", 3)
    rows = ctx.sentences.filter("marker = ''").withColumn("run", F.explode(F.filter(stack_runs(F.col("text"), p.words("stopword")), lambda r: F.size(r["words"]) >= least)))
    words, last = F.col("run.words"), T.lower(F.element_at(F.col("run.words"), -1))
    participle = last.isin(p.words("irregular_participle")) | ((F.octet_length(last) >= 4) & last.endswith("ed") & ~last.isin(p.words("participle_head_exception")))
    rows = rows.filter(~F.exists(words, lambda w: T.lower(w).isin(p.words("finite_verb"))) & ~participle)
    rows = rows.filter(~(F.col("kind").isin("code-comment", "pr") & F.exists(words, T.is_identifier)))
    head = words[0]
    ambiguous = F.col("run.before").isin(p.words("determiner")) & T.lower(head).isin(p.words("garden_path_head"))
    stack = F.concat(F.lit("noun stack ("), F.size(words).cast("string"), F.lit(" content words): "), quoted(F.array_join(words, " ")))
    evidence = F.when(ambiguous, F.concat(F.lit("ambiguous "), stack, F.lit(" (head "), quoted(head), F.lit(" is a verb/noun homograph after a determiner)"))).otherwise(stack)
    message = F.when(ambiguous, F.concat(F.lit("After a determiner "), quoted(head), F.lit(" can be taken for a verb. Put the words in another order."))).otherwise("Say with verbs and prepositions how these words relate.")
    return finding(rows, ctx, "CORE.NOUN_STACK", evidence, message, policy=("candidate", "info"))


# --- blocks --------------------------------------------------------------------------------------------------------


def headings(ctx: Context) -> DataFrame:
    return ctx.blocks.filter(F.col("marker").rlike("^#+$"))


@rule("HEADING_CASE")
def heading_case(ctx: Context) -> DataFrame:
    rows = headings(ctx).withColumn("words", T.heading_words(F.col("text"))).filter("size(words) >= 4")
    rest = F.filter(F.slice("words", F.lit(2), F.size("words")), lambda w: ~F.lower(w).isin(HEADING_STOPWORDS))
    rows = rows.withColumn("rest", rest).filter((F.size("rest") >= 3) & F.forall("rest", T.is_capitalized))
    return finding(rows, ctx, "CORE.HEADING_CASE", F.concat(F.lit("heading: "), quoted(F.col("text"))), "Capitalise the heading like a sentence.")


@rule("GERUND_HEADING")
def gerund_heading(ctx: Context) -> DataFrame:
    rows = headings(ctx).withColumn("words", T.heading_words(F.col("text"))).filter("size(words) >= 2")
    first = F.lower(F.col("words")[0])
    rows = rows.filter(first.endswith("ing") & (F.length(first) >= 6))
    return finding(rows, ctx, "CORE.GERUND_HEADING", F.concat(F.lit("heading opens with gerund: "), quoted(F.col("words")[0])), "Name the task with a plain verb, or the topic with a noun.")


@rule("HEADING_SKIP")
def heading_skip(ctx: Context) -> DataFrame:
    rows = headings(ctx).withColumn("level", F.length("marker"))
    rows = rows.withColumn("above", F.lag("level").over(Window.partitionBy("doc_id").orderBy("block_no"))).filter("level > above + 1")
    evidence = F.concat(F.lit("H"), F.col("level").cast("string"), F.lit(" follows H"), F.col("above").cast("string"))
    return finding(rows, ctx, "CORE.HEADING_SKIP", evidence, "Use the level right below the heading above.")


@rule("HEADING_PUNCTUATION")
def heading_punctuation(ctx: Context) -> DataFrame:
    rows = headings(ctx).filter(F.col("text").endswith(".") & ~F.col("text").endswith(".."))
    return finding(rows, ctx, "CORE.HEADING_PUNCTUATION", F.concat(F.lit("heading ends with period: "), quoted(F.col("text"))), "Drop the full stop; a heading is a label.")


@rule("SINGLE_ITEM_LIST")
def single_item_list(ctx: Context) -> DataFrame:
    """Bulleted or numbered blocks whose neighbours among the blocks are of another class."""
    kind = F.when(F.col("marker").isin("- ", "* ", "+ "), "bulleted").when(F.col("marker").rlike(r"^[0-9]+[.)]$"), "numbered").otherwise("other")
    w = Window.partitionBy("doc_id").orderBy("block_no")
    rows = ctx.blocks.withColumn("class", kind).withColumn("before", F.lag("class", 1, "").over(w)).withColumn("after", F.lead("class", 1, "").over(w))
    rows = rows.filter("class <> 'other' and before <> class and after <> class")
    return finding(rows, ctx, "CORE.SINGLE_ITEM_LIST", F.concat(F.lit("single-item list: "), quoted(F.col("text"))), "One item makes no list; put it in a sentence.")


@rule("SEQUENTIAL_BULLET")
def sequential_bullet(ctx: Context) -> DataFrame:
    rows = ctx.blocks.filter(F.col("marker").isin("- ", "* ", "+ ")).withColumn("words", T.heading_words(F.col("text"))).filter("size(words) > 0")
    rows = rows.filter(F.lower(F.col("words")[0]).isin(SEQUENCE_WORDS))
    return finding(rows, ctx, "CORE.SEQUENTIAL_BULLET", F.concat(F.lit("bulleted item opens with "), quoted(F.col("words")[0])), "Number the items, as their order matters.")
