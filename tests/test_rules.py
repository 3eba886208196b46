import pytest
from pyspark.sql import functions as F

from prosemill.operators import rules, structure
from prosemill.plans import lint, profile

PROFILE = profile.resolve()


@pytest.fixture(scope="module")
def run(spark):
    def found(rule, text, kind="description", fmt="markdown", given=PROFILE):
        docs = structure.as_documents(spark.createDataFrame([(1, text)], "i long, t string"), "i", "t", kind=kind, fmt=fmt)
        raw, rows = text.encode(), rules.RULES["CORE." + rule](rules.Context(docs, given)).collect()
        for r in rows:
            assert list(r.asDict()) == rules.FINDING
            if r.start_byte is not None:
                lines = text.split("\n")
                before = raw[: r.start_byte].decode()
                assert (r.start_line, r.start_column) == (before.count("\n") + 1, len(before) - before.rfind("\n")) and r.end_line <= len(lines)
        return [(raw[r.start_byte : r.end_byte].decode() if r.start_byte is not None else None, r.evidence) for r in rows]

    return found


def texts(found):
    return sorted(t for t, _ in found)


def test_words(run):
    assert texts(run("CONTRACTION", "It's é: they don't, Bob's won't")) == ["It's", "don't", "won't"]
    assert texts(run("BANNED_MODAL", "You Should or may; maybe")) == ["Should", "may"]
    assert texts(run("LATIN_ABBREV", "Use e.g. this, etc. and i.e. that")) == ["e.g.", "etc.", "i.e."]
    assert texts(run("ORDINAL_NUMERAL", "1st 22ND x3rd 4444th")) == ["1st", "22ND"]
    assert texts(run("PERCENT_STYLE", "40 percent and 4.5  percent, 4 percents")) == ["4.5  percent", "40 percent"]
    assert texts(run("EXCLAMATION", "a! `b!` c!!")) == ["!", "!", "!"]


def test_dates(run):
    assert texts(run("AMBIGUOUS_DATE", "03/04/2025 03/14/2025 /var/log/03/04/2025")) == ["03/04/2025"]


def test_time_anchor_takes_the_longer_phrase(run):
    assert texts(run("TIME_ANCHOR", "Ships in the near future. Currently fine.")) == ["Currently", "in the near future"]


def test_terms(run):
    found = run("TERM_DISCOURAGED", "In order to utilize a Data Base.")
    assert texts(found) == ["Data Base", "In order to", "utilize"]
    assert texts(run("TERM_CASE", "javascript and JavaScript and xjavascript")) == ["javascript"]
    assert texts(run("TERM_UNKNOWN", "use flarb, don't utilize the data base")) == ["don't", "flarb,"]
    assert [e for _, e in run("TERM_CONSISTENCY", "Check-in then checkin. check-in")] == ['term spelled as "Check-in" and "checkin"', 'term spelled as "Check-in" and "check-in"']


def test_abbreviations(run):
    assert run("UNEXPANDED_ABBREV", "The EI (Ending Inventory) is EI.") == []
    assert run("UNEXPANDED_ABBREV", "The Ending Inventory (EI) is EI.") == []
    assert texts(run("UNEXPANDED_ABBREV", "EI and EI again from the EI module.")) == ["EI"]
    assert run("UNEXPANDED_ABBREV", "NPEHandler passes HTTPServer to countEIValue, an API.") == []


def test_sentences(run):
    short = profile.Profile(PROFILE.manifest, {"rules": [{"id": "CORE.SENTENCE_LENGTH", "enabled": True, "parameters": {"description_max_words": 5}}]}, PROFILE.dictionary)
    for kind in ("description", "code-comment"):
        assert texts(run("SENTENCE_LENGTH", "one two three four five six. ok", kind, given=short)) == ["one two three four five six."]
    assert run("SENTENCE_LENGTH", "one two three four five six.", "pr", given=short) == []
    assert len(run("DENSE_PARAGRAPH", "One. Two. Three. Four.")) == 1
    assert texts(run("GERUND_OPENER", "Running the tests helps. Running tests helps.")) == ["Running the tests helps."]


def test_noun_stacks(run):
    assert run("NOUN_STACK", "The build queue is full.") == []
    assert "prune logic attention" not in str(run("NOUN_STACK", "Case size changed — rebuild the measures"))
    assert any("ambiguous noun stack" in e for _, e in run("NOUN_STACK", "Give the prune logic real attention."))
    assert any("text labels" in e for _, e in run("NOUN_STACK", "Left-aligned text labels wrap cleanly."))


def test_blocks(run):
    assert texts(run("HEADING_SKIP", "# A\n### B\n## C")) == ["### B"]
    assert texts(run("HEADING_PUNCTUATION", "# A.\n# B..\n# C")) == ["# A."]
    assert texts(run("HEADING_CASE", "# The Big Red House\n# The big red house")) == ["# The Big Red House"]
    assert texts(run("GERUND_HEADING", "# Running tests\n# Ring it")) == ["# Running tests"]
    assert texts(run("SINGLE_ITEM_LIST", "- a\n\ntext\n\n- b\n- c\n1. d")) == ["- a", "1. d"]
    assert texts(run("SEQUENTIAL_BULLET", "- First do\n- Open")) == ["- First do"]
    assert texts(run("PROCEDURE_MULTI_ACTION", "1. open it and close it\n2. open it")) == ["1. open it and close it"]


def test_html_has_no_segments(run):
    assert run("EXCLAMATION", "<html><p>a!</p>", fmt="html") == []


def test_novelty(spark):
    make = lambda t: structure.as_documents(spark.createDataFrame([(1, t)], "i long, t string"), "i", "t", fmt="markdown")
    changed = make("bracket-mesh overgrid x. bracket-mesh overgrid y.")
    found = lint.lint(changed, PROFILE, make("plain words"), "abc123def456", ["CORE.CORPUS_NOVELTY"]).collect()
    assert {r.evidence.split('"')[1] for r in found} >= {"bracket-mesh", "overgrid", "bracket-mesh overgrid"}
    assert all("git_compare_count=0" in r.evidence and "(abc123de)" in r.message for r in found)
    assert lint.lint(changed, PROFILE, only=["CORE.CORPUS_NOVELTY"]).count() == 0


def test_coverage_and_verdict(spark):
    rows = lint.coverage(spark, PROFILE).collect()
    assert len(rows) == len(profile.RULES) and rows[0].state == "enforced" and {r.rule_id: r.state for r in rows}["CORE.TERM_CASE"] == "disabled"
    docs = structure.as_documents(spark.createDataFrame([(1, "a!")], "i long, t string"), "i", "t", fmt="markdown")
    found = lint.lint(docs, PROFILE)
    assert not lint.failed(found, "warning").first().failed and found.count() == 1


def test_unknown_terms_need_no_join(spark):
    """Words are held against the terms of their own line: nothing is shuffled or sent to the driver, however many terms there are."""
    n = 3_000
    text = "the (data base) é-flarb, use/utilize In Order to. " * n
    docs = structure.as_documents(spark.createDataFrame([(1, text), (2, "To use"), (3, "zork\nto zork")], "i long, t string"), "i", "t", fmt="markdown")
    found = rules.RULES["CORE.TERM_UNKNOWN"](rules.Context(docs, PROFILE))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    raw = text.encode()
    got = [(r.doc_id, r.start_byte, r.end_byte, r.evidence) for r in found.collect()]
    assert [(a, b, e) for d, a, b, e in got if d > 1] == [(0, 4, "Unknown term: zork"), (8, 12, "Unknown term: zork")]
    assert [raw[a:b].decode() for d, a, b, _ in got if d == 1] == ["é-flarb,", "use/utilize"] * n
    assert {e for d, _, _, e in got if d == 1} == {"Unknown term: é-flarb", "Unknown term: use/utilize"}


def test_unknown_terms_are_read_by_every_core(spark):
    """A file of one row group is read by one task; the notes made of it are spread before they are parsed."""
    import __spark_entry__ as entry

    found = entry.queries()["term_unknown"](spark, "/root/testdata/sf0.001")
    parts = found.select(F.spark_partition_id().alias("part")).distinct().count()
    assert spark.read.parquet("/root/testdata/sf0.001/orders.parquet").rdd.getNumPartitions() == 1 and parts > 1


def test_unknown_terms_at_edges(spark):
    """Words with marks around them, phrases that cover some words of others, and letters of several bytes."""
    lines = ["pre-data base-x data base, (data base) «data base»", "In Order to. in order tox in order", "é-ü ÜBER! ...!! -- 12. ₂x٣", "datá base to 𝔘𝔘 𝒳data", "use/data base to"]
    docs = structure.as_documents(spark.createDataFrame([(1, "\n".join(lines))], "i long, t string"), "i", "t", fmt="markdown")
    raw = "\n".join(lines).encode()
    got = [(raw[r.start_byte : r.end_byte].decode(), r.evidence[14:], r.start_line, r.start_column) for r in rules.RULES["CORE.TERM_UNKNOWN"](rules.Context(docs, PROFILE)).collect()]
    assert all(lines[line - 1][column - 1 :].startswith(word) for word, _, line, column in got)
    assert [g[:2] for g in got] == [
        ("pre-data", "pre-data"), ("base-x", "base-x"), ("in", "in"), ("order", "order"), ("tox", "tox"), ("in", "in"), ("order", "order"), ("é-ü", "é-ü"), ("ÜBER!", "ÜBER"), ("12.", "12"),
        ("₂x٣", "x٣"), ("datá", "datá"), ("base", "base"), ("𝔘𝔘", "𝔘𝔘"), ("𝒳data", "𝒳data"), ("use/data", "use/data"),
    ]
