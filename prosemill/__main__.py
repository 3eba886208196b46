"""The command line: lint, revise, rewrite, config, comments, explain, prompt, profile.

Exit codes: 0 fine, 1 findings at or above --fail-on, 2 wrong use, 3 a fault.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from prosemill.plans import profile
from prosemill.plans.profile import KINDS, ProfileError


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("prosemill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prosemill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    lint = sub.add_parser("lint", help="findings on files, a folder or a text")
    lint.add_argument("path", nargs="?")
    lint.add_argument("--text")
    lint.add_argument("--kind", choices=KINDS)
    lint.add_argument("--format", choices=["human", "json", "agent"], default="human")
    lint.add_argument("--fail-on", choices=["none", "warning", "error"])
    lint.add_argument("--compare", metavar="REPOSITORY@REVISION", help="a Git revision whose vocabulary counts as known")
    comments = sub.add_parser("comments", help="the comments of source files")
    comments.add_argument("path")
    explain = sub.add_parser("explain", help="a rule or term of the profile")
    explain.add_argument("name")
    prompt = sub.add_parser("prompt", help="guidance for a kind of text")
    prompt.add_argument("--kind", choices=KINDS, default="description")
    revise = sub.add_parser("revise", help="a model's proposals on files or a text")
    rewrite = sub.add_parser("rewrite", help="a model's whole rewrite of a file or a text")
    for s in (revise, rewrite):
        s.add_argument("path", nargs="?")
        s.add_argument("--text")
        s.add_argument("--kind", choices=KINDS)
        s.add_argument("--format", choices=["human", "json"], default="human")
        s.add_argument("--base-url")
        s.add_argument("--model")
        s.add_argument("--api-key-env", metavar="VARIABLE")
        s.add_argument("--mode", choices=["json_schema", "json_object", "prompt_json"])
        s.add_argument("--context-tokens", type=int)
        s.add_argument("--max-requests", type=int)
    config = sub.add_parser("config", help="show the user's configuration, or set it")
    config.add_argument("values", nargs="*", metavar="KEY=VALUE")
    bundles = sub.add_parser("profile", help="list, verify or install profiles")
    bundles.add_argument("action", choices=["list", "verify", "install"])
    bundles.add_argument("folder", nargs="?")
    for s in (lint, explain, bundles, revise, rewrite):
        s.add_argument("--profile")
        s.add_argument("--installed", help="folder of installed profiles")
    return p


def chosen(args: argparse.Namespace) -> tuple[profile.Profile, dict]:
    """The profile and configuration: the flag first, then the nearest configuration file, then the package's own."""
    found = profile.discover(".")
    config = profile.configured(found) if found else {"terms": []}
    return profile.with_terms(profile.resolve(args.profile or config.get("profile") or "docs-en@1.0.0", args.installed), config["terms"]), config


def run_lint(args: argparse.Namespace) -> int:
    from prosemill.operators import comments, reports, structure
    from prosemill.plans import lint
    from prosemill.sources import files

    if (args.path is None) == (args.text is None):
        raise ProfileError("give a path or --text, not both")
    given, config = chosen(args)
    kind = args.kind or config.get("kind") or "description"
    spark = session()
    if args.text is not None:
        docs = files.from_texts(spark, [("<text>", args.text)], kind)
    elif kind == "code-comment":
        docs, _ = comments.comment_documents(comments.comments(source_files(spark, args.path)))
    else:
        docs, refused = files.scan(spark, args.path, kind, None if Path(args.path).is_file() else files.PROSE)
        for r in refused.collect():
            print(f"{r.path}: {r.reason}", file=sys.stderr)
    base, revision = None, ""
    if args.compare:
        repository, _, revision = args.compare.rpartition("@")
        snapshot = files.snapshot(spark, repository or ".", revision).withColumnRenamed("path", "source")
        base = structure.as_documents(snapshot.selectExpr("xxhash64(source) as id", "source", "content"), "id", "content", "source")
    found = lint.lint(docs, given, base, revision).cache()
    # The verdict fills the cache, all rules at once; lines are then read from few partitions, one after another.
    failed = lint.failed(found, args.fail_on or config.get("fail_on") or "error").first().failed
    lines = reports.as_json(found) if args.format == "json" else reports.as_lines(found, args.format)
    for r in lines.coalesce(8).toLocalIterator():
        print(r.value)
    found.unpersist()
    lint.release()
    return int(failed)


def read_documents(args: argparse.Namespace, kind: str):
    from prosemill.sources import files

    if (args.path is None) == (args.text is None):
        raise ProfileError("give a path or --text, not both")
    spark = session()
    if args.text is not None:
        return files.from_texts(spark, [("<text>", args.text)], kind)
    docs, refused = files.scan(spark, args.path, kind, None if Path(args.path).is_file() else files.PROSE)
    for r in refused.collect():
        print(f"{r.path}: {r.reason}", file=sys.stderr)
    return docs


def client_of(args: argparse.Namespace, user: dict, of: str):
    """The client that flags, then the user's configuration name, and the mode of its answers."""
    from prosemill.operators import models

    model = args.model or (user.get("code_model") if of == "comments" else None) or user.get("model") or ""
    named = args.api_key_env or user.get("api_key_env") or ""
    try:
        return models.Client(args.base_url or user.get("base_url") or "", model, "" if named else user.get("api_key", ""), named, float(user.get("timeout", models.TIMEOUT)), of=of), args.mode or user.get("response_mode") or "json_schema"
    except models.ModelError as e:
        raise ProfileError(str(e)) from None


def run_revise(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from prosemill.operators import prompts, review, revision, structure

    given, config = chosen(args)
    user = profile.user_config()
    kind = args.kind or config.get("kind") or "description"
    code = kind == "code-comment" and args.path is not None
    client, mode = client_of(args, user, "comments" if code else "revisions")
    context, most = args.context_tokens or user.get("context_tokens") or 0, args.max_requests or user.get("max_requests") or review.REQUESTS
    if code:
        asked = review.comment_requests(source_files(session(), args.path), context).cache()
        for r in asked.filter("status = 'failed'").collect():
            print(f"{r.path}: {r.error}", file=sys.stderr)
        requests = asked.filter("status = 'ask'").select("path", F.lit(0).alias("start_byte"), F.octet_length("content").alias("end_byte"), "content", "system", "user", "limit")
        valid = lambda row: review.judged_comments(row["raw"], row["path"], row["content"])
        documents = asked.filter("status <> 'failed'").select("path", F.octet_length("content").alias("input_bytes"), F.octet_length("content").alias("analysis_bytes"))
    else:
        docs = read_documents(args, kind)
        shown = structure.visible_text(docs).join(docs.select("doc_id", "source", "content"), "doc_id")
        documents = shown.select(F.col("source").alias("path"), F.octet_length("content").alias("input_bytes"), F.octet_length("text").alias("analysis_bytes"))
        system = prompts.system_text(kind)
        chunks = prompts.planned(docs, given, context or 8192, kind, most)
        if small := chunks.filter(~F.col("fits")).select("source").distinct().limit(5).collect():
            raise ProfileError(f"too long for the context however they are cut: {', '.join(r.source for r in small)}")
        user_text = F.substring("prompt", len(system) + 3, 1 << 30)
        requests = chunks.select(F.col("source").alias("path"), "start_byte", "end_byte", F.col("text").alias("content"), F.lit(system).alias("system"), user_text.alias("user"), F.lit(0).alias("limit"))
        valid = lambda row: revision.revisions(row["raw"])
    answers = review.answered(requests, client, valid, most, mode).cache()
    good = answers.filter("error is null")
    if code:
        found = review.validated_comments(good.select("path", "content", "raw"))
        key = "path"
    else:
        found = revision.validated(good.select(F.concat_ws("#", "path", "start_byte").alias("response_id"), F.col("content").alias("chunk"), F.col("start_byte").alias("chunk_start"), "raw"))
        found, key = found.withColumn("path", F.regexp_replace("response_id", "#[0-9]+$", "")), "response_id"
    report = review.revise_report(answers, review.source_analysis(documents, answers), found.cache(), key, profile=f"{given.manifest['id']}@{given.manifest['version']}", model=client.model)
    print(review.revise_text(report, args.format), end="")
    return int(report["status"] == "failed")


def run_rewrite(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from prosemill.operators import models, prompts, review, revision

    given, config = chosen(args)
    kind = args.kind or config.get("kind") or "description"
    client, _ = client_of(args, profile.user_config(), "revisions")
    row = read_documents(args, kind).select("source", "content").collect()
    if len(row) != 1:
        raise ProfileError(f"a rewrite takes one document, not {len(row)}")
    try:
        raw = client(prompts.rewrite_text(kind), row[0].content, "prompt_json")
    except models.ModelError as e:
        raise RuntimeError(str(e)) from None
    judged = revision.judged_rewrites(session().createDataFrame([(row[0].source, row[0].content, raw)], "path string, source string, rewrite string"))
    about = {"profile": f"{given.manifest['id']}@{given.manifest['version']}", "model": client.model}
    print((review.rewrite_json(judged, **about) if args.format == "json" else review.rewrite_lines(judged)).first().value, end="" if args.format == "human" else "\n")
    return 0


def run_config(args: argparse.Namespace) -> int:
    values = profile.user_config()
    for given in args.values:
        key, equals, value = given.partition("=")
        if not equals or key not in profile.USER_KEYS:
            raise ProfileError(f"KEY=VALUE, with a key of {', '.join(profile.USER_KEYS)}")
        try:
            values[key] = profile.USER_KEYS[key](value)
        except ValueError:
            raise ProfileError(f"{key} is a number") from None
    if args.values:
        print(profile.write_user_config(values))
    for key, value in values.items():
        print(f"{key} = {'(set)' if key == 'api_key' else value}")
    return 0


def source_files(spark, path: str):
    from pyspark.sql import functions as F

    from prosemill.operators.comments import EXTENSIONS

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.filter(F.col("path").rlike(r"(?i)\.(?:" + "|".join(EXTENSIONS) + ")$")).select("path", F.col("content").cast("string").alias("content"))


def placed(path: str | None) -> str | None:
    """A path that names no file system, seen from where the command runs; the JVM may have been started elsewhere."""
    return path if path is None or ":" in path.split("/")[0] else os.path.abspath(path)


def main(argv: list[str] | None = None) -> int:
    try:
        args = options().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if "path" in args:
        args.path = placed(args.path)
    try:
        if args.command == "lint":
            return run_lint(args)
        if args.command in ("revise", "rewrite", "config"):
            return {"revise": run_revise, "rewrite": run_rewrite, "config": run_config}[args.command](args)
        if args.command == "comments":
            from prosemill.operators.comments import comments

            spark = session()
            for r in comments(source_files(spark, args.path)).toJSON().toLocalIterator():
                print(r)
        elif args.command == "explain":
            given, _ = chosen(args)
            rule, entry = given.rule(args.name), given.resolve_term(args.name)
            if not rule and not entry and args.name not in profile.RULES:
                raise ProfileError(f"neither a rule nor a term: {args.name}")
            print(rule or entry or {"id": args.name, "version": 1, "enabled": False})
        elif args.command == "prompt":
            from prosemill.operators.prompts import system_text

            print(system_text(args.kind))
        elif args.action == "list":
            for name, version, digest in profile.profiles(args.installed):
                print(f"{name}@{version} {digest}")
        elif args.action == "verify":
            found = profile.load(args.folder) if args.folder else chosen(args)[0]
            print(f"{found.manifest['id']}@{found.manifest['version']} {found.sha256}")
        else:
            if not args.folder or not args.installed:
                raise ProfileError("install needs a folder and --installed")
            profile.install(args.folder, args.installed)
        return 0
    except ProfileError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
