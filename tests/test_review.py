import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from prosemill.operators import evaluation, models, prompts, reports, review, revision, structure
from prosemill.plans import profile

GO = "package a\n\n// Old words.\nfunc f() {}\n\n/* Block\n   words. */\nvar s = \"// no\"\n"


def finding(**given):
    return {"comment_id": "c0001", "action": "rewrite", "principle_ids": ["CORE.PLAIN_MECHANISM"], "reason": " stale ", "replacement": "// New words.", "question": None, "confidence": 0.9} | given


def answer(*items):
    return json.dumps({"findings": list(items)})


def test_comment_contract():
    found, gone, unsafe = review.judged_comments(answer(finding()), "a.go", GO)
    assert [(f["start"], f["source_text"], f["reason"]) for f in found] == [(GO.index("// Old"), "// Old words.", "stale")] and gone == unsafe == 0
    bad = [
        finding(confidence=0.79), finding(confidence=True), finding(confidence="1"), finding(comment_id="c9"), finding(action="delete"), finding(principle_ids=[]), finding(principle_ids=["CORE.EXCLAMATION"]),
        finding(principle_ids=["CORE.PLAIN_MECHANISM"] * 2), finding(reason=" "), finding(replacement=None), finding(question="why?"), finding(extra=1), {"comment_id": "c0001"}, 5, finding(action="clarification"),
    ]
    for item in bad:
        assert review.judged_comments(answer(item), "a.go", GO) == ([], 1, 0), item
    for unsafe in ("New words.", "// a\ncode()", "/* other form */", "// a\n// b */ x /*"):
        got = review.judged_comments(answer(finding(replacement=unsafe)), "a.go", GO)
        assert got[1:] == ((1, 1) if unsafe != "// a\n// b */ x /*" else (got[1], got[2]))
    assert review.judged_comments(answer(finding(), finding()), "a.go", GO) == ([], 2, 0)
    asked = finding(action="clarification", comment_id="c0002", replacement=None, question="Why?")
    assert len(review.judged_comments(f"```json\n{answer(finding(), asked)}\n```", "a.go", GO)[0]) == 2
    for broken in ("", "[]", "{}", '{"findings": {}}', '{"findings": [], "x": 1}', '{"error": "no"}', answer(*[finding()] * 6), " " * 10_001):
        with pytest.raises(ValueError):
            review.judged_comments(broken, "a.go", GO)


def test_comment_tables(spark):
    rows = [("a.go", GO, answer(finding(), finding(comment_id="c9"))), ("b.go", GO, answer()), ("c.go", GO, None), (None, None, "x"), ("d.go", GO, answer(finding(replacement="x")))]
    got = {r.path: r for r in review.validated_comments(spark.createDataFrame(rows, "path string, content string, raw string")).collect()}
    a = got["a.go"]
    assert (a.status, a.discarded, a.comment_id, a.kind, a.start_byte, a.start_line, a.end_column) == ("ok", 1, "c0001", "rewrite", GO.index("// Old"), 3, 14)
    assert got["b.go"].status == "ok" and got["b.go"].kind is None and got["c.go"].status == got[None].status == "failed"
    v = review.validated_comments(spark.createDataFrame(rows, "path string, content string, raw string"))
    assert review.discards(v).first().asDict() == {"discarded_findings": 2, "discarded_rewrites": 1}
    assert review.validated_comments(spark.createDataFrame([], "path string, content string, raw string")).count() == 0


def test_comment_requests(spark):
    files = spark.createDataFrame([("a.go", GO), ("b.go", "package a\n"), ("c.go", '"open'), ("d.zig", "x"), ("e.go", "// " + "x" * 40_000), ("f.go", None)], "path string, content string")
    got = {r.path: r for r in review.comment_requests(files).collect()}
    assert {p: r.status for p, r in got.items()} == {"a.go": "ask", "b.go": "none", "c.go": "failed", "d.zig": "failed", "e.go": "failed", "f.go": "none"}
    body = got["a.go"].user
    listed = json.loads(body.partition("Its comments:\n")[2])
    assert GO in body and [(c["id"], c["form"], c["text"]) for c in listed["comments"]] == [("c0001", "line", "// Old words."), ("c0002", "block", "/* Block\n   words. */")] and len(listed["source_sha256"]) == 64
    large = {r.path: r for r in review.comment_requests(files, 100_000).collect()}
    assert large["e.go"].status == "ask" and large["a.go"].limit == (100_000 - 2048 - 512) * 4
    assert {r.status for r in review.comment_requests(files.filter("path = 'a.go'"), 2000).collect()} == {"failed"}


def scripted():
    """A client whose structured answers break the contract for some texts, and the judge of its answers."""
    right = answer(finding())

    def client(system, user, mode, limit):
        if "down" in user:
            raise models.ModelError("no way")
        return "nonsense" if "odd" in user and mode != "prompt_json" or "never" in user else right

    def valid(row):
        review.judged_comments(row["raw"], "a.go", "// Old words.\n")

    return client, valid


def requests(spark, users):
    return spark.createDataFrame([(f"p{i}", 0, 10, "s", u, 1000) for i, u in enumerate(users)], "path string, start_byte int, end_byte int, system string, user string, limit int")


def test_one_fallback_within_the_budget(spark):
    rows = {r.user: r for r in review.answered(requests(spark, ["fine", "odd 1", "odd 2", "never", "down"]), *scripted(), most=7).collect()}
    assert {u: (r.requests, r.error is None) for u, r in rows.items()} == {"fine": (1, True), "odd 1": (2, True), "odd 2": (2, True), "never": (1, False), "down": (1, False)}
    assert "request: no way" in rows["down"].error
    again = {r.user: r for r in review.answered(requests(spark, ["never"]), *scripted()).collect()}
    assert again["never"].requests == 2 and "once more" in again["never"].error
    alone = review.answered(requests(spark, ["odd"]), *scripted(), mode="prompt_json").first()
    assert alone.requests == 1 and alone.error is None
    for n, most in ((3, 2), (1, 0), (1, 1025)):
        with pytest.raises(profile.ProfileError):
            review.answered(requests(spark, ["x"] * n), *scripted(), most=most)


def test_status_and_analysis(spark):
    answers = spark.createDataFrame([("a", 0, 10, None, 1), ("a", 10, 25, "bad", 2), ("b", 0, 5, None, 1)], "path string, start_byte int, end_byte int, error string, requests int")
    docs = spark.createDataFrame([("a", 25, 25), ("b", 5, 5), ("c", 9, 7)], "path string, input_bytes int, analysis_bytes int")
    got = {r.path: (r.analyzed_bytes, r.chunks, r.requests, r.complete) for r in review.source_analysis(docs, answers).collect()}
    assert got == {"a": (10, 2, 3, False), "b": (5, 1, 1, True), "c": (7, 0, 0, True)}
    status = lambda where: review.run_status(answers.filter(where)).first().status
    assert (status("true"), status("path = 'b'"), status("error is not null"), status("false")) == ("partial", "ok", "failed", "ok")


def test_reports(spark):
    rows = [("b.go", GO, answer(finding(comment_id="c0002", action="clarification", replacement=None, question="Why?"), finding())), ("a.go", GO, answer(finding(replacement="x")))]
    found = review.validated_comments(spark.createDataFrame(rows, "path string, content string, raw string"))
    answers = spark.createDataFrame([("a.go", 0, 9, None, 1), ("b.go", 0, 9, None, 1), ("c.go", 0, 9, "no", 1)], "path string, start_byte int, end_byte int, error string, requests int")
    docs = spark.createDataFrame([("a.go", 9, 9), ("b.go", 9, 9), ("c.go", 9, 9)], "path string, input_bytes int, analysis_bytes int")
    made = review.revise_report(answers, review.source_analysis(docs, answers), found, model="m")
    assert made["status"] == "partial" and made["discarded_rewrites"] == made["discarded_findings"] == 1 and [r["range"]["start_line"] for r in made["revisions"]] == [3, 6]
    text, body = review.revise_text(made), json.loads(review.revise_text(made, "json"))
    assert text.startswith("status: partial\nmodel: m\nanalysis: a.go chunks=1 requests=1 bytes=9/9 complete=true\n") and "replacement: // New words.\n---\nkind: clarification" in text and "question: Why?" in text and "error: c.go: no" in text
    assert "lines" not in body and "question" not in body["revisions"][0]
    judged = revision.judged_rewrites(spark.createDataFrame([("p", "See --flag", "See it"), ("q", "Hi there", "Hi")], "path string, source string, rewrite string"))
    out = {r.path: json.loads(r.value) for r in review.rewrite_json(judged, profile="x@1").collect()}
    assert out["p"]["discarded"] and out["p"]["discard_reason"] == "protected_content" and out["p"]["rewritten_text"] == "See --flag" and out["q"]["output_bytes"] == 2 and "discard_reason" not in out["q"]
    assert {r.value for r in review.rewrite_lines(judged.filter("path = 'q'")).collect()} == {"status: ok\nsource: q\ninput: 8 bytes, output: 2 bytes\n---\nHi\n"}


# --- client --------------------------------------------------------------------------------------------------------


@pytest.fixture
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

        def do_GET(self):
            self.reply(200, {"data": [{"id": "b", "max_model_len": 9}, {"id": " a ", "context_length": 5, "max_model_len": 9}, {"id": "b"}, {"id": "x\n y"}, {"id": ""}, 3]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            said = body["messages"][1]["content"]
            if said == "deny":
                self.reply(403, b"key sk-secret\x07 is wrong")
            elif said == "large":
                self.reply(200, b"x" * 70_000)
            else:
                self.reply(200, b"{}" if said == "empty" else {"choices": [{"message": {"role": "assistant", "content": "hi"}}], "usage": {}})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_client(service, monkeypatch):
    base, seen = service
    client = models.Client(base + "/v1/chat/completions/?q=1#f", "m", key="sk-secret", max_tokens=7)
    assert client("s", "u") == "hi" and client("s", "u", "json_schema") == "hi"
    assert [s[:2] for s in seen] == [("/v1/chat/completions", "Bearer sk-secret")] * 2 and seen[0][2] == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "max_tokens": 7}
    assert seen[1][2]["response_format"]["json_schema"]["schema"]["properties"]["findings"]["maxItems"] == 20
    for said, wanted in (("deny", "HTTP 403: key \\[REDACTED\\]  is wrong"), ("large", "over 65536"), ("empty", "isn't a chat's")):
        with pytest.raises(models.ModelError, match=wanted):
            client("s", said)
    with pytest.raises(models.ModelError, match="of at most 32000"):
        client("s", "x" * 32_000)
    assert client("s", "x" * 32_000, limit=40_000) == "hi"
    monkeypatch.setenv("SOME_KEY", "k2")
    models.Client(base, "m", key_env="SOME_KEY")("s", "u")
    assert seen[-1][:2] == ("/v1/chat/completions", "Bearer k2")
    assert client.models() == [{"id": "a", "context": 5}, {"id": "b", "context": 9}] and models.Client(base, "b").context() == 9 and client.context() == 0
    with pytest.raises(models.ModelError):
        models.Client("http://127.0.0.1:1", "m", timeout=2)("s", "u")


def test_client_settings():
    assert models.endpoint("https://h") == "https://h/v1/chat/completions" and models.endpoint("http://h:8/api/") == "http://h:8/api/chat/completions"
    for bad in ("ftp://h", "http://", "http://u:p@h", "h"):
        with pytest.raises(models.ModelError):
            models.endpoint(bad)
    for given in ({"model": ""}, {"model": "m", "key": "a", "key_env": "B"}, {"model": "m", "key_env": "9A"}):
        with pytest.raises(models.ModelError):
            models.Client("http://h", **given)
    assert [models.is_env_name(n) for n in ("A", "_a1", "1a", "", "a-b", "é")] == [True, True, False, False, False, False]
    assert models.context_window({"context_length": 0, "max_context_length": 3, "max_model_len": 9}) == 3 and models.context_window({"context_length": True}) == 0
    assert models.response_format("auto", "comments") is None and models.response_format("json_object", "comments") == {"type": "json_object"}
    assert models.schema("comments")["properties"]["findings"]["maxItems"] == 5


def test_user_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert profile.user_config() == {}
    path = profile.write_user_config({"base_url": "http://h", "model": 'a"b', "timeout": 30, "max_requests": 4})
    assert path == tmp_path / "prosemill" / "config.toml" and path.stat().st_mode & 0o777 == 0o600 and [p.name for p in path.parent.iterdir()] == ["config.toml"]
    assert profile.user_config() == {"base_url": "http://h", "model": 'a"b', "timeout": 30, "max_requests": 4}
    for bad in ({"nope": 1}, {"model": 5}, {"api_key": "a", "api_key_env": "B"}):
        with pytest.raises(profile.ProfileError):
            profile.write_user_config(bad)
    assert profile.user_config()["model"] == 'a"b'


# --- evaluation ----------------------------------------------------------------------------------------------------


def test_scanner_fails_open():
    found = lambda text, language: [text[a:b] for a, b in evaluation.scan(text, language)]
    assert found('x := "// a" // b\n`/* c` /* d */ \'"\' // e', "go") == ["// b", "/* d */", "// e"]
    assert found("fn f<'a>(x: &'a str) { r#\"// \"# } /* a /* b */ c */ '\\'' // d", "rust") == ["/* a /* b */ c */", "// d"]
    assert found("'''# a''' # b\ns = \"# \\\" c\" # d", "py") == ["# b", "# d"]
    assert found("a /* open", "ts") == ["/* open"] and found('a "open // b', "go") == [] and found("/* a /* b */", "rust") == ["/* a /* b */"]
    for language in ("go", "rust", "py", "ts"):
        assert found("", language) == []


def test_corpora(spark):
    files = spark.createDataFrame([("a/b.go", "x"), ("a/vendor/c.go", "x"), ("go.sum", "x"), ("d.RS", "x"), ("e.txt", "x"), ("gen/f.py", "x"), ("gen2/g.py", "y")], "path string, content string")
    got = evaluation.corpus_files(files, ["gen/"])
    assert [(r.path, r.language) for r in got.collect()] == [("a/b.go", "go"), ("d.RS", "rust"), ("gen2/g.py", "py")]
    lock = evaluation.locked(got)
    assert json.loads(evaluation.lock_text(lock))["files"][0]["size"] == 1
    pinned = spark.createDataFrame([("a/b.go",), ("d.RS",), ("gen2/g.py",), ("new.go",)], "path string")
    now = spark.createDataFrame([("a/b.go", "x"), ("d.RS", "z"), ("new.go", "x")], "path string, content string")
    assert {(r.path, r.state) for r in evaluation.checked(lock, pinned, now).collect()} == {("d.RS", "changed"), ("gen2/g.py", "missing"), ("new.go", "unlocked")}
    repo = {"id": "r", "url": "https://h/x", "revision": "a" * 40, "language": "go", "files": ["z.go", "a.go", "vendor/b.go", "t/c.go"], "exclude_prefixes": ["t"]}
    assert evaluation.manifest({"repos": [repo]}) == [("go", "r", "a.go"), ("go", "r", "z.go")]
    for bad in ({"url": "http://h/x"}, {"revision": "main"}):
        with pytest.raises(profile.ProfileError):
            evaluation.manifest({"repos": [repo | bad]})


def test_recorded_responses(spark):
    source = "x = 1  # é one\ny = 'one'\nz = 2  # one\n"
    files = spark.createDataFrame([("a.py", source, "py"), ("b.py", None, "py")], "path string, content string, language string")
    rows = [("a.py", 1, "# one", 3, "why \n not"), ("a.py", 2, "one", 1, None), ("a.py", 3, "one", 2, "x" * 200), ("a.py", 4, "none", 1, " "), ("a.py", 5, "", 1, "r"), ("b.py", 6, "x", 1, "r"), ("c.py", 7, None, None, "r"), ("a.py", 8, "one", 99, "r")]
    got = {r.id: r for r in evaluation.judged(spark.createDataFrame(rows, "file string, id int, source_text string, line int, reason string"), files).collect()}
    assert len(got) == 8
    assert (got[1].start_byte, got[1].line, got[1].comment_target, got[1].title) == (len(source[: source.rindex("# one")].encode()), 3, True, "why not")
    assert (got[2].line, got[2].comment_target, got[2].title) == (1, True, "code-comment finding")
    assert (got[3].line, got[3].comment_target, len(got[3].title)) == (1, True, 120) and got[8].line == 1
    assert all(got[i].start_byte == -1 and not got[i].target_resolved and not got[i].comment_target for i in (4, 5, 6, 7))
    assert evaluation.review_summary(evaluation.judged(spark.createDataFrame(rows, "file string, id int, source_text string, line int, reason string"), files)).first().asDict() == {"findings": 8, "comment_targets": 4, "non_comment_targets": 4, "unresolved_targets": 4}
    used = spark.createDataFrame([('{"prompt_tokens": 5, "x": "y"}',), ('{"prompt_tokens": 7}',), ("no",), (None,)], "usage string")
    assert [(r.name, r.tokens) for r in evaluation.usage(used).collect()] == [("prompt_tokens", 12)]


def test_nearest_occurrence(spark):
    """Against a plain search: overlapping places, ties, lines that aren't there, longer texts than the source."""
    rng = random.Random(3)
    some = lambda most: "".join(rng.choice("aaé\n世") for _ in range(rng.randint(0, most)))
    rows = [(i, some(14), some(3), rng.choice([None, -1, 0, 1, 2, 3, 4, 9, 2**40])) for i in range(400)]
    got = {r.i: r["at"] and tuple(r["at"]) for r in spark.createDataFrame(rows, "i int, s string, t string, l long").select("i", evaluation.resolved(F.col("s"), F.col("t"), F.col("l")).alias("at")).collect()}
    for i, s, t, line in rows:
        lines = s.split("\n")
        near = len("\n".join(lines[: line - 1])) + 1 if line and 1 < line <= len(lines) else 0
        best = min(((abs(k - near), k) for k in range(len(s)) if t and s.startswith(t, k)), default=None)
        begin = len(s[: best[1]].encode()) if best else 0
        assert got[i] == (best and (begin, begin + len(t.encode()), s[: best[1]].count("\n") + 1)), (s, t, line)


def test_all_targets(spark):
    scored = spark.createDataFrame([("a", 3, 0, 0.5, 0.9, 90, 60)], "run string, invalid int, non_comment int, recall double, precision double, replacement_safety int, overall_quality int")
    assert reports.missed_targets(scored).first().missed == ["invalid", "recall", "overall_quality"]


# --- spans and glossary --------------------------------------------------------------------------------------------


def test_spans_of_visible_text(spark):
    page = "<p>ab &amp; c <code>x</code> d</p><p>e</p>"
    docs = structure.as_documents(spark.createDataFrame([(1, page)], "i long, t string"), "i", "t", fmt="html")
    runs = structure.projection(docs)
    text = structure.visible_text(docs).first().text
    ranges = spark.createDataFrame([(1, 1, 6, "r"), (1, 0, 0, "none"), (2, 0, 5, "other"), (1, text.index("d") - 2, len(text), "rest")], "doc_id long, start_byte int, end_byte int, run_no string")
    got = structure.source_spans(ranges.withColumnRenamed("run_no", "name"), runs).orderBy("name", "source_start").collect()
    spans = {}
    for r in got:
        spans.setdefault(r.name, []).append(page[r.source_start : r.source_end] if r.source_start is not None else None)
    assert spans["r"] == ["b ", "&amp;", " c"] and spans["none"] == spans["other"] == [None] and "d" in "".join(spans["rest"])
    kept = {r.name: r.protected for r in structure.with_protected(ranges.withColumnRenamed("run_no", "name"), runs).collect()}
    assert kept == {"r": False, "none": False, "other": False, "rest": True}


def test_glossary(spark):
    own = [{"term": f"term{i:03d}", "parts_of_speech": ["noun"], "definition": f"d{i}"} for i in range(100)] + [{"term": "OVER", "parts_of_speech": ["noun"], "override": True, "reason": "r"}]
    given = profile.with_terms(profile.resolve(), own)
    rows = spark.createDataFrame([(" ".join(t["term"] for t in own[5:80]),), ("over it",), ("none",)], "t string").select(prompts.glossary(F.col("t"), given).alias("g")).collect()
    assert rows[0].g == [f"term{i:03d}: d{i}" for i in range(5, 69)] and rows[1].g == ["OVER (override: r)"] and rows[2].g == []
