"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, wanted = entry.queries()[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(wanted, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_vocabulary_runs_over_documents(spark, duck):
    assert {"phrase_counts_documents", "corpus_novelty_documents"} <= ORACLES.keys()
    assert duck.sql(ORACLES["phrase_counts_documents"]).df()["n"].sum() > duck.sql(ORACLES["phrase_counts"]).df()["n"].sum()
    assert entry.queries()["corpus_novelty_documents"](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["blocks", "sentences", "dense_paragraph", "noun_stack", "sentence_length"])
def test_lines_that_begin_with_a_number(spark, tmp_path, name):
    """An address or a decimal at the start of a line isn't a list item, so sentences go on over it."""
    text = "Clerks in lich auf keit build queue\n70.32.29.134 system lich " + "wort " * 26 + "gut.\n3.5 waren es\n4)ein und\nEnde. Gut. Alles."
    spark.createDataFrame([(1, text), (2, "Plain. Text.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as duck:
        duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        got, wanted = entry.queries()[name](spark, str(tmp_path)).toPandas(), duck.sql(ORACLES[name]).df()
    assert len(wanted) and rows(got, sorted(wanted.columns)) == rows(wanted, sorted(wanted.columns))


SENTENCE_QUERIES = ["sentences", "dense_paragraph", "noun_stack", "sentence_length"]


def differ(spark, path, name, texts):
    """Rows of a query over texts as documents, in Spark's result and in its SQL's."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    with duckdb.connect() as duck:
        duck.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
        got, wanted = entry.queries()[name](spark, str(path)).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(wanted.columns)
    assert len(wanted)
    return rows(got, columns), rows(wanted, columns)


LONG = "lich " * 30


@pytest.mark.parametrize("name", SENTENCE_QUERIES)
def test_etc_before_a_closing_mark(spark, tmp_path, name):
    """What follows a closing mark after etc. decides whether a sentence ends there, as without the mark."""
    texts = [f"Clerks{mark} {LONG}etc.{mark} {word} {LONG}ein.\nGut. Alles." for mark in ("", ")", '"', "»", '")') for word in ("Ende", "ende", "(Ende", "Ä")]
    got, wanted = differ(spark, tmp_path, name, texts)
    assert got == wanted


@pytest.mark.parametrize("name", SENTENCE_QUERIES)
def test_capitals_are_letters_and_lower_case_has_one_letter(spark, tmp_path, name):
    """A Roman numeral or a letter in a circle isn't a capital letter, and a capital I with a dot is lowered to i."""
    texts = [f"Clerks {LONG}etc. {word} {LONG}ein.\nGut. Alles." for word in ("Ⅷ", "Ⓐ", "Ä", "ä")]
    texts += [f"Clerks {LONG}{word} Und {LONG}ein.\nGut. Alles." for word in ("İ.", "fİg.", "(İ.", "vİ.", "É.")]
    got, wanted = differ(spark, tmp_path, name, texts)
    assert got == wanted


@pytest.mark.parametrize("name", SENTENCE_QUERIES)
def test_separators_of_data_are_no_white_space(spark, tmp_path, name):
    """U+001C to U+001F, which Python counts as white space, neither end a word nor stand around a sentence."""
    texts = [f"Clerks {LONG}gut.{c}Und {LONG}ein.\nGut. Alles.{c} {c}Ende" for c in "\x1c\x1d\x1e\x1f"] + ["Gut\x1fa. Und gut. \x1e. Alles etc. \x1dUnd. Gut."]
    got, wanted = differ(spark, tmp_path, name, texts)
    assert got == wanted


@pytest.mark.parametrize("name", SENTENCE_QUERIES)
def test_white_space_after_the_last_word(spark, tmp_path, name):
    """A text's last sentence ends with its last word, however many spaces follow."""
    texts = [f"Clerks gut. {LONG}system{end}{spaces}" for end in ("", ".", ".\nUnd build queue system") for spaces in ("", " ", "   ")]
    got, wanted = differ(spark, tmp_path, name, [*texts, "Eins. Zwei. Drei. Vier. "])
    assert got == wanted


BLANK = ["", " ", "\n", " \n  ", "Eins.\n", "Eins.\n\n", "Eins.\n  ", "\nEins. Zwei", "  \n\n Eins é.\nZwei. \n\n"]


@pytest.mark.parametrize("texts", [BLANK, [f"Eins.\n{c}\nZwei. {c}" for c in "\x1c\x1d\x1e\x1f"], [f"{mark}{space}\nEins. Zwei" for mark in ("3.", "12)", "-", "+", "*") for space in ("", " ")]], ids=["blank", "separators", "marks"])
def test_plain_texts_are_one_block(spark, tmp_path, texts):
    """White space at a text's ends is its block's, a text of white space is a block without text, U+001C to U+001F don't make a
    blank line, and a number or dash alone on a line is no mark."""
    got, wanted = differ(spark, tmp_path, "blocks", texts)
    assert got == wanted
