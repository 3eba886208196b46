import json
import shutil

import pytest

from pyspark.sql import functions as F

from prosemill.operators import comments, reports, revision
from prosemill.plans import profile
from prosemill.sources import files


def test_profile_is_sound_and_resolves(tmp_path):
    p = profile.resolve("docs-en@1.0.0", tmp_path)
    profile.install(p.source, tmp_path)
    assert profile.resolve("docs-en@1.0.0", tmp_path).sha256 == p.sha256
    assert profile.profiles(tmp_path) == [("docs-en", "1.0.0", p.sha256)]
    with pytest.raises(profile.ProfileError):
        profile.resolve("docs-en@9.9.9")


def test_faults_come_all_at_once(tmp_path):
    folder = shutil.copytree(profile.resolve().source, tmp_path / "p")
    rules = json.loads((folder / "rules.json").read_text())
    rules["rules"][0]["severity"] = "loud"
    rules["rules"].append(dict(rules["rules"][1], parameters={"x": 1}))
    (folder / "rules.json").write_text(json.dumps(rules))
    with pytest.raises(profile.ProfileError) as e:
        profile.load(folder)
    for part in ("invalid severity", "duplicate rule", "unknown parameter", "hash"):
        assert part in str(e.value)


def test_term_precedence():
    p = profile.resolve()
    terms = [{"term": "utilize", "parts_of_speech": ["verb"], "override": True, "reason": "ours"}, {"term": "flarb", "parts_of_speech": ["noun"]}]
    q = profile.with_terms(p, terms)
    assert q.resolve_term("UTILIZE")["status"] == "preferred" and q.resolve_term("flarb")["status"] == "allowed" and q.resolve_term("use")["status"] == "preferred"
    with pytest.raises(profile.ProfileError):
        profile.with_terms(p, [{"term": "utilize", "parts_of_speech": ["verb"]}])


def test_config(tmp_path):
    (tmp_path / profile.CONFIG).write_text('profile = "docs-en@1.0.0"\nother = 1\n[[terms]]\nterm = "a"\nparts_of_speech = ["noun"]\n')
    (tmp_path / "sub").mkdir()
    assert profile.configured(profile.discover(tmp_path / "sub"))["terms"][0]["term"] == "a"


PY = '"""doc # no"""\nx = "# a" # one\n# two\n# three\n\'\'\ny=1 # é\n'


def test_lexers():
    texts = lambda path, lang, s: [c[4] for c in comments.catalog(path, lang, s)]
    assert texts("a.py", "py", PY) == ["# one", "# two\n# three", "# é"]
    assert texts("a.go", "go", "// a\n// b\nx := \"//no\" /* q */\ny := `// no`\nz := '\"' // w\n") == ["// a\n// b", "/* q */", "// w"]
    assert texts("a.rs", "rust", "/* a /* b */ c */ fn f<'a>(x: &'a str) { r#\"// no\"#; '\"'; } // z\n") == ["/* a /* b */ c */", "// z"]
    assert texts("a.sh", "sh", '#!/bin/sh\necho foo#bar # yes\ncat <<EOF\n# no\nEOF\ncat <<< "# no" # two\n${x#y}\n') == ["# yes", "# two"]
    assert texts("a.ts", "ts", "const a = /\\/\\/x/; // c1\nlet b = `// no ${ 1 /* in */ } `; if (x) /re#/.test(y); a / b / c; // end") == ["// c1", "/* in */", "// end"]
    assert texts("a.tsx", "ts", 'const a = <div title="// no">text // no {/* yes */} <b/></div>; // c\nif (a < b) {} // d') == ["/* yes */", "// c", "// d"]


@pytest.mark.parametrize("language, source", [("go", '"abc'), ("py", '"""x'), ("rust", "/* /* */"), ("sh", "'x"), ("ts", "`${a"), ("sh", "cat <<EOF\nx")])
def test_lexers_fail_closed(language, source):
    with pytest.raises(comments.LexError):
        comments.catalog("x", language, source)


def test_replacement_safety():
    assert comments.replacement_is_safe("py", "# a\n", 0, "line", "# b")
    assert not comments.replacement_is_safe("py", "# a\n", 0, "line", "b") and not comments.replacement_is_safe("go", "/* a */", 0, "block", "/* a */ x /* b */")


def test_comments_table(spark):
    rows = comments.comments(spark.createDataFrame([("a.py", PY), ("b.py", '"'), ("c.zig", "x"), ("d.go", None)], "path string, content string")).collect()
    assert [r.comment_id for r in rows if r.path == "a.py"] == ["c0001", "c0002", "c0003"]
    assert {r.path for r in rows if r.error} == {"b.py", "c.zig"}


def item(**more):
    return {"kind": "rewrite", "source_text": "a", "source_range": {"start": 0, "end": 1}, "principle_ids": ["CORE.SHORT_SENTENCE"], "reason": "r", "replacement": "b", "confidence": 0.5} | more


@pytest.mark.parametrize("wrong", [{"kind": "x"}, {"source_text": ""}, {"source_range": {"start": 2, "end": 1}}, {"principle_ids": []}, {"principle_ids": ["X"]}, {"principle_ids": ["CORE.SHORT_SENTENCE"] * 2}, {"reason": " "}, {"replacement": None}, {"question": "q"}, {"reason": "we guarantee"}, {"confidence": 2}])
def test_contract(wrong):
    assert revision.revisions(json.dumps({"findings": [item()]}))[0]
    with pytest.raises(ValueError):
        revision.revisions(json.dumps({"findings": [item(), item(**wrong)]}))


def test_contract_details():
    assert revision.revisions(json.dumps({"findings": [item(principle_ids=["CORE.EXCLAMATION"]), item(principle_ids=["CORE.NOUN_STACK"])]}))[1] == 1
    assert revision.principles_of(["CORE.NOUN_STACK", "CORE.SHORT_SENTENCE"]) == ["CORE.EXPLICIT_RELATIONSHIPS", "CORE.SHORT_SENTENCE"]
    assert revision.located(b"aa bb aa", b"aa", 5) == (6, 8) and revision.located(b"aa bb aa", b"aa", 3) is None and revision.located(b"a  b", b"a b", 0) == (0, 4)
    assert revision.reported_error('{"error": {"message": "no\\u0007 way"}}') == "no  way" and revision.reported_error("{}") is None
    with pytest.raises(ValueError):
        revision.revisions(json.dumps({"findings": [item()] * 21}))


def test_rewrites(spark):
    rows = spark.createDataFrame([("See https://a.b/c now", "See https://a.b/c"), ("Use --flag", "Use it"), ("Hi", "Mail me@x.org"), ("Hi", " ")], "source string, rewrite string")
    assert [r.reason for r in revision.judged_rewrites(rows).collect()] == [None, "protected content lost", "content injected", "empty"]


def test_client_is_injected(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "a b")], "doc_id long, chunk_no int, start_byte int, text string")
    answer = json.dumps({"findings": [item()]})
    got = revision.validated(revision.revised(chunks, lambda prompt: answer, lambda t: t)).collect()
    assert [(r.status, r.start_byte, r.replacement) for r in got] == [("ok", 0, "b")]


def test_references(spark, tmp_path):
    for name, body in {"a.md": b"hi", ".env.local": b"x", "k.md": b"-----BEGIN X", "bin.txt": b"a\0b", "bad.txt": b"\xff", "x.zig": b"x", "p.html": b"<p>a&amp;b</p>"}.items():
        (tmp_path / name).write_bytes(body)
    raw = files.reference_files(spark, str(tmp_path)).withColumn("explicit", F.col("path").endswith("bad.txt"))
    entries, refused = files.references(raw)
    assert {(r.path.rpartition("/")[2], r.content) for r in entries.collect()} == {("a.md", "hi"), ("p.html", "a&b\n")}
    assert {(r.path.rpartition("/")[2], r.level) for r in refused.collect()} == {(".env.local", "warning"), ("k.md", "warning"), ("bin.txt", "warning"), ("bad.txt", "error"), ("x.zig", "warning")}


def test_reference_folders(spark, tmp_path):
    root = tmp_path / ".d"
    (root / ".git").mkdir(parents=True)
    (root / "_notes").mkdir()
    for name, body in {".npmrc": "token", ".lint.json": "{}", ".git/a.md": "x", "_notes/b.md": "y", "c.md": "z"}.items():
        (root / name).write_text(body)
    (root / "link.md").symlink_to(root / "c.md")
    entries, refused = files.references(files.reference_files(spark, str(root)))
    assert {(r.path.rpartition("/")[2], r.content) for r in entries.collect()} == {(".lint.json", "{}"), ("b.md", "y"), ("c.md", "z")}
    assert {(r.path.rpartition("/")[2], r.reason) for r in refused.collect()} == {(".npmrc", "name looks like a secret"), ("link.md", "is a symbolic link")}
    docs, _ = files.scan(spark, str(root))
    assert sorted(r.source.rpartition("/")[2] for r in docs.collect()) == ["b.md", "c.md"]
    one, _ = files.references(files.reference_files(spark, str(root / "c.md")))
    assert one.count() == 1 and files.scan(spark, str(tmp_path / ".d" / "_notes"))[0].count() == 1
    with pytest.raises(profile.ProfileError):
        files.scan(spark, str(root / "link.md"))


def test_canonical_paths(spark):
    given = ["/a/./b/../../c", "file:/a/../../b", "s3://x/a//b/./c/..", "a/../../b", "/", "x"]
    rows = spark.createDataFrame([(p,) for p in given], "p string").select(files.canonical(F.col("p")).alias("c")).collect()
    assert [r.c for r in rows] == ["/c", "file:/b", "s3://x/a/b", "../b", "/", "x"]


def test_scan(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    for name in ("a.md", "b.html", "c.bin", ".git/d.md"):
        (tmp_path / name).write_text("x")
    docs, refused = files.scan(spark, str(tmp_path))
    assert sorted(r.format for r in docs.collect()) == ["html", "markdown"] and refused.count() == 1


def test_reports(spark):
    judged = spark.createDataFrame([("a", "matched"), ("a", "missed"), ("a", "invalid"), ("b", "context")], "run string, class string")
    got = {r.run: (r.recall, r.precision) for r in reports.scores(judged).collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, 1.0)}
    assert {r.run: r.missed for r in reports.missed_targets(reports.scores(judged)).collect()} == {"a": ["recall", "precision"], "b": []}


def test_stream(spark, tmp_path):
    from prosemill import streaming
    from prosemill.operators import structure

    spark.createDataFrame([(1, "a! b!"), (2, "# A\n### B")], "i long, t string").write.parquet(str(tmp_path / "in"))
    docs = structure.as_documents(spark.readStream.schema("i long, t string").parquet(str(tmp_path / "in")), "i", "t", fmt="markdown")
    streaming.lint_stream(docs, profile.resolve(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_requests_fit_and_drop_nothing(spark):
    from prosemill.operators import prompts, structure

    text = ("To utilize the data base, quote \"it\".\n" * 400) + "é" * 3000
    docs = structure.as_documents(spark.createDataFrame([(1, text)], "i long, t string"), "i", "t", fmt="markdown")
    rows = sorted(prompts.planned(docs, profile.resolve(), 4096).collect(), key=lambda r: r.start_byte)
    assert "".join(r.text for r in rows) == text and all(r.tokens + prompts.OUTPUT + prompts.SAFETY <= 4096 for r in rows)
    assert "Avoid 'data base'" in rows[0].prompt and all(r.fits for r in rows)
    with pytest.raises(profile.ProfileError):
        prompts.planned(docs, profile.resolve(), 2600)
    with pytest.raises(profile.ProfileError):
        prompts.planned(docs, profile.resolve(), 4096, most_requests=1)


def test_documents_that_never_fit_are_marked(spark):
    from prosemill.operators import prompts, structure

    own = [{"term": f"t{i}", "parts_of_speech": ["noun"], "definition": "long " * 60} for i in range(60)]
    given = profile.with_terms(profile.resolve(), own)
    rows = [(1, " ".join(t["term"] for t in own) * 40), (2, "plain " * 3000), (3, "")]
    docs = structure.as_documents(spark.createDataFrame(rows, "i long, t string"), "i", "t", fmt="markdown")
    got = prompts.planned(docs, given, 4096, most_requests=None).collect()
    for i, text in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start_byte)
        assert "".join(r.text for r in mine) == text and all(r.fits == (i == 2) for r in mine)
