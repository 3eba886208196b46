"""Prompts for revisers, within a model's context: guidance, what the profile says about the words at hand, and chunk plans.

A token is counted as four bytes of the request. A plan never drops text: a chunk that doesn't fit is cut smaller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import reports, structure
from prosemill.operators.revision import PRINCIPLES
from prosemill.plans.profile import Profile, ProfileError

#: Tokens kept for the answer and for safety, the least source tokens of a request, and bounds.
OUTPUT, SAFETY, LEAST, MOST_CHUNK, MOST_TERMS, MOST_REQUESTS, BYTES = 2048, 512, 512, 20 * 1024, 64, 1024, 4


def word_present(text: Column, term: str) -> Column:
    """Whether a term stands in a text as a word, where _ and all numbers belong to words."""
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){T.quote(term)}(?![\p{{L}}\p{{N}}_])")


def dictionary_guidance(text: Column, profile: Profile) -> Column:
    """Lines on the dictionary's terms that stand in a text, at most MOST_TERMS."""
    lines = []
    for e in profile.dictionary["entries"]:
        if e["status"] == "discouraged":
            line = f"Avoid '{e['term']}'" + (f"; use {', '.join(e['alternatives'])}" if e.get("alternatives") else "") + f". {e['reason']}"
        elif e["status"] in ("preferred", "allowed"):
            line = f"Keep '{e.get('canonical_case') or e['term']}' ({', '.join(e['parts_of_speech'])})."
        else:
            continue
        lines.append(F.when(word_present(text, e["term"]), F.lit(line)))
    return _present(lines)


def _present(lines: list[Column]) -> Column:
    found = F.filter(F.array(*lines), lambda x: x.isNotNull()) if lines else F.array().cast("array<string>")
    return F.slice(found, 1, MOST_TERMS)


def glossary(text: Column, profile: Profile) -> Column:
    """Lines on the project's own terms that stand in a text, in the project's order, at most MOST_TERMS."""
    lines = []
    for t in profile.terms:
        line = t["term"] + (f" (override: {t['reason']})" if t.get("override") and t.get("reason") else "") + (f": {t['definition']}" if t.get("definition") else "")
        lines.append(F.when(word_present(text, t["term"]), F.lit(line)))
    return _present(lines)


def system_text(kind: str) -> str:
    """What every request for a kind of text begins with."""
    told = reports.GUIDANCE[""] + reports.GUIDANCE[kind]
    return "\n".join([*told, "Name one or more of these principles for each proposal: " + ", ".join(PRINCIPLES), 'Answer with JSON: {"findings": [...]}'])


def rewrite_text(kind: str) -> str:
    """What a request for a whole rewrite begins with."""
    told = [t for t in reports.GUIDANCE[""] if not t.startswith("Ask")] + reports.GUIDANCE[kind]
    return "\n".join([*told, "Rewrite the text that follows so that it is shorter and more exact. Keep a part as it is where it doesn't say enough.", "Answer with the new text alone: no remarks, labels or fences."])


def with_prompts(chunks: DataFrame, profile: Profile, kind: str = "description", findings: DataFrame | None = None) -> DataFrame:
    """chunks (doc_id, chunk_no, start_byte, end_byte, text) with prompt and tokens. findings (doc_id, start_byte, rule_id,
    evidence) that begin in a chunk are named in it, in order."""
    out = chunks
    if findings is not None:
        f = findings.select(F.col("doc_id").alias("f_doc"), F.col("start_byte").alias("f_start"), F.concat(F.lit("- "), F.col("rule_id"), F.lit(": "), F.col("evidence")).alias("line"))
        hit = chunks.select("doc_id", "chunk_no", "start_byte", "end_byte").join(f, (F.col("doc_id") == F.col("f_doc")) & (F.col("f_start") >= F.col("start_byte")) & (F.col("f_start") < F.col("end_byte")))
        lines = hit.groupBy("doc_id", "chunk_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("f_start", "line"))), lambda x: x["line"]).alias("found"))
        out = out.join(lines, ["doc_id", "chunk_no"], "left")
    else:
        out = out.withColumn("found", F.lit(None).cast("array<string>"))
    terms = F.array_join(dictionary_guidance(F.col("text"), profile), "\n")
    own = F.array_join(glossary(F.col("text"), profile), "\n")
    prompt = F.concat_ws("\n\n", F.lit(system_text(kind)), F.when(terms != "", terms), F.when(own != "", F.concat(F.lit("Project terms:\n"), own)), F.when(F.size("found") > 0, F.concat(F.lit("Findings:\n"), F.array_join("found", "\n"))), F.concat(F.lit("Text:\n"), F.col("text")))
    return out.withColumn("prompt", prompt).withColumn("tokens", F.ceil(F.octet_length(F.to_json(F.struct("prompt"))) / BYTES).cast("long")).drop("found")


def chunk_bytes(context: int, kind: str, references: int = 0) -> int:
    """Bytes of text that a request has room for in a context of so many tokens; ProfileError if that is too little."""
    room = context - OUTPUT - SAFETY - -(-(len(system_text(kind).encode()) + references) // BYTES)
    if room < LEAST:
        raise ProfileError(f"a context of {context} tokens leaves {room} for text")
    return min(MOST_CHUNK, room * BYTES)


def planned(docs: DataFrame, profile: Profile, context: int, kind: str = "description", most_requests: int | None = MOST_REQUESTS) -> DataFrame:
    """with_prompts over chunks that fit the context, and fits. What a chunk's guidance and escapes take is only known once it is
    cut, so a document of which a chunk doesn't fit is cut at half the size, a quarter and so on, and has the chunks of the
    largest size of which all fit; where none does, those of the least, whose fits is false. One plan does it all: the smaller
    sizes are tried on those documents alone. ProfileError beyond most_requests, if that is given."""
    size = chunk_bytes(context, kind)

    def cut(some: DataFrame, most: int, level: int) -> DataFrame:
        made = with_prompts(structure.chunks(some, most), profile, kind)
        return made.withColumn("level", F.lit(level)).withColumn("fits", F.col("tokens") + OUTPUT + SAFETY <= context).withColumn("all", F.min("fits").over(Window.partitionBy("doc_id")))

    first, smaller = cut(docs, size, 0), [s for k in range(1, 16) if (s := size >> k) >= LEAST]
    out = first.filter("all") if smaller else first
    if smaller:
        rest = docs.join(first.filter(~F.col("all")).select("doc_id").distinct(), "doc_id", "left_semi")
        tried = reduce(DataFrame.unionByName, [cut(rest, s, k) for k, s in enumerate(smaller, 1)])
        best = F.min(F.when(F.col("all"), F.col("level"))).over(Window.partitionBy("doc_id"))
        out = out.unionByName(tried.withColumn("best", F.coalesce(best, F.lit(len(smaller)))).filter("level = best").drop("best"))
    out = out.drop("level", "all")
    if most_requests is not None and (n := out.count()) > most_requests:
        raise ProfileError(f"{n} requests are over the limit of {most_requests}")
    return out
