import json
import subprocess

from prosemill.__main__ import main


def test_lint(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("Stop! " + "word " * 30 + ".\n")
    assert main(["lint", str(tmp_path / "a.md"), "--fail-on", "warning", "--format", "json"]) == 1
    found = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {f["rule_id"] for f in found} >= {"CORE.EXCLAMATION", "CORE.SENTENCE_LENGTH"}
    assert main(["lint", "--text", "Stop!", "--format", "agent"]) == 0
    assert "lint: INFO CORE.EXCLAMATION path:<text>" in capsys.readouterr().out
    assert main(["lint"]) == 2 and main(["nothing"]) == 2 and main(["lint", str(tmp_path / "missing")]) == 3


def test_other_commands(capsys, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert main(["explain", "CORE.EXCLAMATION"]) == 0 and main(["explain", "utilize"]) == 0 and main(["explain", "x"]) == 2
    assert main(["prompt", "--kind", "pr"]) == 0 and main(["profile", "list"]) == 0 and main(["profile", "verify"]) == 0
    assert "docs-en@1.0.0" in capsys.readouterr().out


def test_comparison_with_a_revision(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.md").write_text("plain words")
    (tmp_path / "a.py").write_text("# overgrid here\n")
    git("add", ".")
    git("commit", "-qm", "x")
    (tmp_path / "b.md").write_text("flarbing flarbing plain plain")
    assert main(["lint", str(tmp_path / "b.md"), "--compare", f"{tmp_path}@HEAD"]) == 0
    out = capsys.readouterr().out
    assert 'term "flarbing"' in out and 'term "plain"' not in out


def test_user_config_and_model_settings(tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    monkeypatch.chdir(tmp_path)
    assert main(["config", "base_url=http://h", "model=m", "api_key=s3cret", "max_requests=3"]) == 0
    assert "s3cret" not in capsys.readouterr().out and main(["config"]) == 0 and "api_key = (set)" in capsys.readouterr().out
    for bad in (["nope=1"], ["model"], ["max_requests=x"]):
        assert main(["config", *bad]) == 2
    assert main(["revise", "--text", "x", "--base-url", "ftp://h"]) == 2 and main(["rewrite", "--text", "x", "--base-url", "http://"]) == 2
    (tmp_path / "prosemill" / "config.toml").unlink()
    assert main(["revise", "--text", "x"]) == 2


def test_revise_and_rewrite(spark, tmp_path, capsys, monkeypatch):
    """Against a service that proposes one revision, one finding on a comment, and a rewrite."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            user = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
            shared = {"principle_ids": ["CORE.SHORT_SENTENCE"], "reason": "long", "question": None, "confidence": 0.9}
            if "<source-code" in user:
                said = json.dumps({"findings": [shared | {"comment_id": "c0001", "action": "rewrite", "replacement": "# Short."}]})
            elif user.startswith("Text:"):
                said = json.dumps({"findings": [shared | {"kind": "rewrite", "source_text": "very long", "source_range": {"start": 0, "end": 9}, "replacement": "long"}]})
            else:
                said = "Short text."
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"role": "assistant", "content": said}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    monkeypatch.chdir(tmp_path)
    model = ["--base-url", f"http://127.0.0.1:{server.server_port}", "--model", "m"]
    (tmp_path / "a.md").write_text("A very long text.\n")
    (tmp_path / "a.py").write_text("x = 1\n# A very long comment.\n")
    assert main(["revise", "a.md", "--format", "json", *model]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["status"] == "ok" and [(r["replacement"], r["range"]["start_byte"]) for r in made["revisions"]] == [("long", 2)] and made["analysis"][0]["complete"]
    assert main(["revise", "a.py", "--kind", "code-comment", *model]) == 0
    assert "replacement: # Short." in capsys.readouterr().out
    assert main(["rewrite", "a.md", *model]) == 0
    assert capsys.readouterr().out.endswith("---\nShort text.\n")
    server.shutdown()
    assert main(["revise", "a.md", "--base-url", "http://127.0.0.1:1", "--model", "m"]) == 1
    assert main(["rewrite", "a.md", "--base-url", "http://127.0.0.1:1", "--model", "m"]) == 3
