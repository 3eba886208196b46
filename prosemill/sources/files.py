"""Files as documents, references with secret screening, and snapshots.

Files are listed by Hadoop and read by Spark's binaryFile source, so any file system works. That source passes over names
that begin with a dot or an underscore; those are listed too, judged by name, and what may be read of them is read by tasks.
What is refused is a row with its reason, not an exception, unless the caller asks for strictness.
"""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import comments, structure
from prosemill.plans.profile import ProfileError

#: Limits in bytes, extensions of prose and of references, and what marks secrets.
FILE_BYTES = 5 * 1024 * 1024
PROSE = [".md", ".markdown", ".txt", ".html", ".htm"]
REFERENCES = ".md .markdown .txt .html .htm .go .rs .py .js .jsx .ts .tsx .java .c .h .cc .cpp .cxx .hh .hpp .json .yaml .yml .toml .ini .cfg .conf .xml .csv .sh .bash .zsh .sql .proto".split()
SECRET_EXTENSIONS = ".pem .key .cert .crt .cer .der .p12 .pfx .jks .keystore .kdb .ps1 .tfvars .tfstate".split()
SECRET_NAMES = "kubeconfig credentials.json credentials service-account.yaml service-account.yml service-accounts.json serviceaccount.json application_default_credentials.json .npmrc .netrc .pypirc .dockercfg id_rsa id_dsa id_ecdsa id_ed25519 id_xmss".split()
SECRET_MARKS = ["-----BEGIN", "private_key", "privateKey", "client_secret", "clientSecret", "refresh_token", "refreshToken", "access_token", "accessToken", "client-key-data", "client-certificate-data"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def hidden(path: Column) -> Column:
    """Paths, from the root on, under a folder whose name begins with a dot."""
    return path.rlike(r"(?:^|/)\.[^/]+/")


#: A name, or one of a folder below the root, that Spark's file sources pass over.
PASSED_OVER = r"(?:^|/)(?:\.|_(?![^/]*=))|\._COPYING_(?:/|$)"


FILE = "path string, relative string, size long, symlink boolean"


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, int, bool]]:
    """FILE rows of all files at or below a path, hidden ones too, in order of path; relative is the path from the root on.
    Names and sizes come to the driver, as they do when Spark lists files. Links aren't followed; a root that is one is an
    error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(hadoop.Path(path))
    java = spark._jvm.java
    linked = lambda at: fs.getScheme() == "file" and java.nio.file.Files.isSymbolicLink(java.io.File(at.toUri().getPath()).toPath())
    if linked(root):
        raise ProfileError(f"{path} is a symbolic link")
    top, out = root.toString().rstrip("/"), []
    single, waiting = fs.getFileStatus(root).isFile(), [root]
    while waiting:
        for status in fs.listStatus(waiting.pop()):
            at = status.getPath()
            link = linked(at)
            if status.isDirectory() and not link:
                waiting.append(at)
            else:
                name = at.toString()
                out.append((name, at.getName() if single else name[len(top) + 1 :], status.getLen(), link))
    return sorted(out)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """FILE and content binary of all files at or below a path. What Spark's source passes over is read by tasks, a file at a
    time. Links, and files that their name or size has refused in any case, aren't read; their content is null."""
    found = listed(spark, path)
    rows = spark.createDataFrame(found, FILE)
    passed, wanted = F.col("relative").rlike(PASSED_OVER), ~secret_name(F.col("path")) & ~F.col("symlink") & (F.col("size") <= FILE_BYTES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("b_path"), "content") if found else spark.createDataFrame([], "b_path string, content binary")
    usual = rows.filter(~passed).join(raw, (F.col("path") == F.col("b_path")) & wanted, "left").drop("b_path")

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for i, row in batch.iterrows():
                # Hadoop writes file:/x where others write file:///x.
                system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", row["path"]))
                with system.open_input_stream(at) as stream:
                    yield batch.loc[[i]].assign(content=[stream.read()])

    rest = rows.filter(passed & wanted).mapInPandas(read, FILE + ", content binary")
    return usual.unionByName(rest).unionByName(rows.filter(passed & ~wanted).withColumn("content", F.lit(None).cast("binary")))


def secret_name(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.startswith(".env") | extension(path).isin(SECRET_EXTENSIONS) | name.endswith(".tfstate.backup") | name.isin(SECRET_NAMES) | name.rlike(r"^service-account.*\.json$|\.tf(?:vars|state)\.json$")


def secret_content(text: Column) -> Column:
    out = F.lit(False)
    for mark in SECRET_MARKS:
        out = out | F.contains(text, F.lit(mark))
    return out


def admitted(files: DataFrame, allowed: list[str] | None, limit: int = FILE_BYTES, secrets: bool = False) -> DataFrame:
    """files (path, content binary) with status (ok or refused) and reason. allowed: extensions, or None for any; secrets: also
    refuse names and contents that look like secrets and contents with NUL."""
    c = F.col("content")
    size = F.coalesce(F.octet_length(c), F.col("size") if "size" in files.columns else F.lit(None))
    reason = F.when(c.isNull(), "can't be read")
    # The last test that is written here is the first that counts.
    if secrets:
        reason = F.when(secret_content(F.try_validate_utf8(c.cast("string"))), "content looks like a secret").otherwise(reason)
    reason = F.when(~F.is_valid_utf8(c.cast("string")), "not UTF-8").otherwise(reason)
    if secrets:
        reason = F.when(F.contains(c.cast("string"), F.lit("\0")), "binary").otherwise(reason)
    reason = F.when(size > limit, f"over {limit} bytes").otherwise(reason)
    if allowed is not None:
        reason = F.when(~extension(F.col("path")).isin(allowed), "extension isn't allowed").otherwise(reason)
    if secrets:
        reason = F.when(secret_name(F.col("path")), "name looks like a secret").otherwise(reason)
    if "symlink" in files.columns:
        reason = F.when(F.col("symlink"), "is a symbolic link").otherwise(reason)
    return files.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("refused"))


def scan(spark: SparkSession, path: str, kind: str = "description", allowed: list[str] | None = PROSE) -> tuple[DataFrame, DataFrame]:
    """The documents of a file or folder, and (path, reason) of what is refused. Hidden folders and links are passed over."""
    files = contents(spark, path).filter(~hidden(F.col("relative")) & ~F.col("symlink"))
    rows = admitted(files, allowed)
    good = rows.filter("status = 'ok'").select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").cast("string").alias("text"))
    return structure.as_documents(good, "doc_id", "text", "path", kind), rows.filter("status <> 'ok'").select("path", "reason")


def reference_files(spark: SparkSession, path: str) -> DataFrame:
    """contents and explicit: a file that is named itself is explicit; below a folder, hidden folders are passed over."""
    files = contents(spark, path)
    single = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = single.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(single).isFile()
    return files.filter(~hidden(F.col("relative"))).withColumn("explicit", F.lit(single))


def from_texts(spark: SparkSession, texts: list[tuple[str, str]], kind: str = "description", fmt: str | None = None) -> DataFrame:
    """Documents of (source, text) pairs; fmt text forces plain text."""
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "i long, source string, text string")
    return structure.as_documents(rows, "i", "text", "source", kind, fmt)


def checked_total(files: DataFrame, limit: int = 25 * 1024 * 1024) -> None:
    """Raises if all contents together are over a limit; no limit holds unless this is called."""
    total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if total > limit:
        raise ProfileError(f"{total} bytes are over the limit of {limit}")


def canonical(path: Column) -> Column:
    """A path without . parts, and without .. parts and what each of them undoes."""
    head = F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*", 0)

    def add(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != "..")
        return F.when(part.isin("", "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((part == "..") & head.endswith("/"), acc).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(F.substring(path, F.length(head) + 1, F.length(path)), "/")
    return F.concat(head, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/"))


def references(files: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files (path, content binary, explicit boolean) to entries (path, content, input_bytes, included_bytes), each canonical path
    once, without those of sources (path), and refusals (path, reason, level): of named files an error, of others a warning."""
    rows = admitted(files.withColumn("path", canonical(F.col("path"))), None, secrets=True)
    named = ~extension(F.col("path")).isin(REFERENCES) & ~F.col("explicit") & (F.col("status") == "ok")
    rows = rows.withColumn("reason", F.when(named, "extension isn't allowed").otherwise(F.col("reason"))).withColumn("status", F.when(named, "refused").otherwise(F.col("status")))
    if sources is not None:
        rows = rows.join(sources.select("path").distinct(), "path", "left_anti")
    good = rows.filter("status = 'ok'").dropDuplicates(["path"]).select("path", F.col("content").cast("string").alias("raw"))
    docs = structure.as_documents(good.withColumn("id", F.xxhash64("path")), "id", "raw", "path")
    shown = structure.visible_text(docs).join(docs.select("doc_id", "source", "content"), "doc_id")
    entries = shown.select(F.col("source").alias("path"), F.col("text").alias("content"), F.octet_length("content").alias("input_bytes"), F.octet_length("text").alias("included_bytes"))
    return entries, rows.filter("status <> 'ok'").select("path", "reason", F.when(F.col("explicit"), "error").otherwise("warning").alias("level"))


def rendered(entries: DataFrame) -> DataFrame:
    """(path, text): each entry wrapped for a prompt; in order of path they are the whole."""
    body = F.concat("content", F.when(F.col("content").endswith("\n"), "").otherwise("\n"))
    return entries.select("path", F.concat(F.lit('<reference file="'), F.col("path"), F.lit('">\n'), body, F.lit("</reference>\n")).alias("text"))


def snapshot(spark: SparkSession, repository: str, revision: str) -> DataFrame:
    """(path, content) of the text files of a Git revision: names are listed on the driver, contents are read by tasks that see
    the repository. Files that can't be read are left out."""
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, check=True).stdout
    commit = git("rev-parse", "--verify", f"{revision}^{{commit}}").strip()
    names = [n for n in git("ls-tree", "-r", "--name-only", "-z", commit).split("\0") if n and (n.lower().endswith(tuple(PROSE)) or comments.detect_language(n))]

    def read(batches):
        for b in batches:
            got = [subprocess.run(["git", "-C", repository, "show", f"{commit}:{n}"], capture_output=True) for n in b["path"]]
            b["content"] = [g.stdout.decode("utf-8", "replace") if g.returncode == 0 else None for g in got]
            yield b[b["content"].notna()]

    return spark.createDataFrame([(n,) for n in names], "path string").mapInPandas(read, "path string, content string")


def snapshot_prose(files: DataFrame) -> DataFrame:
    """(doc_id, seg_no, text) of a snapshot's (path, content): prose segments of prose files, comments of source files."""
    code = F.col("path").rlike(r"(?i)\.(?:" + "|".join(comments.EXTENSIONS) + ")$")
    prose = structure.prose(structure.as_documents(files.filter(~code).withColumn("id", F.xxhash64("path")), "id", "content", "path", fmt="markdown")).select("doc_id", "seg_no", "text")
    found = comments.comments(files.filter(code)).filter("error is null")
    return prose.unionByName(found.select(F.xxhash64("path").alias("doc_id"), F.col("start_byte").alias("seg_no"), "text"))
