"""Each operator against a plain version, a round trip or held-out labels, and over nulls, ties, repeats and odd columns."""

import hashlib
import os
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prosemill.llm import chat, components, digest, langid, media, mixing, packing, quality, queries, sharding, simhash, toxicity
from prosemill.llm.common import labelled

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, ties, repeated rows, an empty and a very long text.
ODD = [
    (1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (1, "other words here", "en", "a", 3), (None, "null id text", None, None, None),
    (None, None, None, None, None), (2, "", "en", "b", 0), (3, None, "en", "b", 0), (4, "word " * 30_000, "de", None, 1), (5, "!!! ??? 123", "fr", "c", 9), (6, "Éa ﬁ ß x", "fr", "c", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("x"), "h": F.lit(1), "shard": F.lit(2), "digest": F.lit("d"), "score": F.lit(9), "fp": F.lit(0), "node": F.lit("n"), "host": F.lit("h"), "key": F.lit(0), "taken": F.lit(0)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def oracle(name, folder=SF):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return c.sql(queries.ORACLES[name]).df()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda f: sorted(map(str, f[cols].astype(object).itertuples(index=False, name=None)))
    assert key(a) == key(b)


# --- 1 mixing ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), oracle(name))


def plain_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    t, live, total = {}, set(order), share * sum(sizes.values())
    while live:
        left, weight = total - sum(t.values()), sum(w[s] for s in live)
        over = {s for s in live if left * w[s] / weight > cap * sizes[s]}
        if not over:
            return t | {s: left * w[s] / weight for s in live}
        t |= {s: cap * sizes[s] for s in over}
        live -= over
    return t


def test_mix(spark, odd, none):
    out = mixing.mix_sources(odd).toPandas()
    assert len(out) == len(ODD)
    sizes = defaultdict(int)
    for _, text, _, source, _ in ODD:
        sizes[source] += len((text or "").encode().split())
    wanted = plain_targets(sizes, (3, 1, 2), 1.5, 2.0)
    for source, rows in out.groupby(out["source"].astype(object).where(out["source"].notna(), None), dropna=False):
        source = None if source != source else source
        assert abs(rows["target"].iloc[0] - wanted[source]) < 1e-6
        assert wanted[source] - 3 <= rows["taken"].sum() <= wanted[source]  # rows of one hash share what is left, rounded down
        assert (rows["taken"] <= 2 * rows["size"]).all()
    assert mixing.mix_sources(none).count() == 0
    assert sorted(mixing.mix_sources(odd).collect(), key=str) == sorted(mixing.mix_sources(odd).collect(), key=str)


def test_mix_repeats_rows(spark, odd):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    out, plan = mixing.repeated(docs), mixing.mix_sources(docs)
    assert out.columns == docs.columns
    words = out.select("source", mixing.n_words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    assert words.join(plan.groupBy("source").agg(F.sum("taken").alias("t")), "source").filter("n <> t").count() == 0
    assert out.filter("n_chars <> length(text)").count() == docs.filter("n_chars <> length(text)").count() == 0
    assert mixing.repeated(odd).columns == odd.columns


# --- 2 media -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [*range(0, 400, 13), 176, 177, 183, 184, 185, 32768, 100_001])
def test_stream_round_trip(n):
    data = media.padded(os.urandom(n))
    assert len(data) % 64 == 0 and data
    for unit in (250, media.UNIT):
        s = media.demux(media.mux(data, unit))
        assert s.payload == data and not s.error and not s.lost and not s.bad_tables and len(s.times) == len(s.random_access) == -(-len(data) // unit)
        assert s.times == [i * unit * 90_000 // 8_000 for i in range(len(s.times))]


def test_stream_tables_over_packets_and_repeated_packets():
    good = media.mux(bytes(range(256)) * 8, 1000)
    pat = good[:188]
    body = media._section(media.PMT_TABLE, 1, b"\xe1\x00\xf0\x00" + bytes([0x1B, 0xE2, 0, 0xF0, 200]) + bytes(200) + bytes([media.PRIVATE_TYPE, 0xE1, 0, 0xF0, 0]))
    head = lambda start, n: bytes([0x47, 0x50 if start else 0x10, 0, 0x10 | n])
    long = head(1, 0) + b"\0" + body[:183] + (head(0, 1) + body[183:]).ljust(188, b"\xff")
    s = media.demux(pat + long + good[376:])
    assert s.payload == bytes(range(256)) * 8 and not s.bad_tables and not s.error
    assert media.demux(pat + long[:188] + good[376:]).bad_tables == 1
    packets = [good[i : i + 188] for i in range(0, len(good), 188)]
    again = media.demux(b"".join(packets[:2] + [p for p in packets[2:] for _ in range(2)]))
    assert again.payload == s.payload and again.repeated == len(packets) - 2 and not again.lost and len(again.units) == len(s.units)


def test_stream_index_pairs_times_with_their_packets(spark):
    good = bytearray(media.mux(bytes(3000), 1000))
    starts = [i for i in range(376, len(good), 188) if good[i + 1] & 0x40]
    good[starts[1] + 5] &= ~0x40  # no random access in the second
    rows = spark.createDataFrame([("x", bytes(good)), (None, None), ("y", b"broken"), (None, bytes(good))], "unit string, media binary").withColumns({"time": F.lit(1), "packet": F.lit(2)})
    got = media.stream_index(rows, "unit").collect()
    wanted = [(i, i * 1000 * 90_000 // 8_000, s // 188, i != 1) for i, s in enumerate(starts)]
    for key in ("x", None):
        assert sorted(tuple(r)[1:] for r in got if r.unit_ == key) == wanted
    assert len(got) == 6


def test_stream_faults():
    good = bytearray(media.mux(bytes(5000), 1000))
    lost = good[: 188 * 4] + good[188 * 5 :]
    assert media.demux(bytes(lost)).lost == 1
    bad = bytearray(good)
    bad[10] ^= 1
    assert media.demux(bytes(bad)).bad_tables == 1 and media.demux(bytes(bad)).error == "no program"
    for broken in (b"", b"x", bytes(188), bytes(good[:188])):
        assert media.demux(broken).error
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_streams(spark, odd, none):
    out = media.stream_features(media.add_streams(odd.select("doc_id", "text")), ["doc_id", "n_bytes"]).toPandas()
    wanted = Counter()
    for _, text, *_ in ODD:
        raw = (text or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        wanted[len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += 1
    assert Counter(zip(out["n_bytes"], out["payload_bytes"], out["payload_sha256"], out["tail_crc32"])) == wanted
    assert media.stream_features(media.add_streams(none.select("doc_id", "text")), ["doc_id"]).count() == 0
    assert media.stream_index(media.add_streams(odd.filter("doc_id = 4")), "doc_id").count() == 5


# --- 3 language ----------------------------------------------------------------------------------------------------


def test_languages(spark, odd, none):
    docs, pages = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "pages"))
    out = langid.identify(docs, pages)
    right = out.join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id")
    assert right.filter("lang = l").count() / right.count() > 0.98 and right.filter("accepted").count() / right.count() > 0.98
    assert out.filter("page_id is not null and lang = declared").count() / pages.count() > 0.98
    assert langid.keep_identified(docs).columns == docs.columns and langid.keep_identified(docs).count() > 0.98 * docs.count()
    p = spark.createDataFrame([(1, None, None), (2, "nonsense", "<html lang=FR><p>x"), (None, "http://a.b.co/x", "")], "page_id long, url string, html string")
    assert langid.identify(odd, p).count() == len(ODD) + 3
    assert langid.identify(none, p.limit(0)).count() == 0 and langid.keep_identified(none).columns == none.columns


def test_priors_lean_on_what_is_around(spark):
    rows = [("a", "d", [0.0, -9.0], 9)] * 40 + [("b", "d", [0.0, -9.0], 9)] + [("c", "e", [-9.0, 0.0], 9)] * 40
    made = spark.createDataFrame(rows, "host string, domain string, loglik array<double>, n_trigrams int").withColumns({"suffix": F.lit(None).cast("string"), "declared": F.lit(None).cast("string")})
    asked = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "e"), ("z", "z")], "host string, domain string").withColumns({"suffix": F.lit(None).cast("string"), "declared": F.lit(None).cast("string"), "loglik": F.array(F.lit(0.0), F.lit(0.0)), "n_trigrams": F.lit(9)})
    p = {r.host: r.posterior[0] for r in langid.fused(asked, made, ["x", "y"]).collect()}
    assert p["a"] > p["b"] > p["z"] > p["c"]


def test_hostile_pages():
    import time

    began = time.perf_counter()
    for page in ("<script " * 120_000, "<!--" * 250_000, "<" * 1_000_000, "<style>x</style>" * 60_000, "<head><script>" * 70_000):
        langid.visible(page)
    assert time.perf_counter() - began < 20
    assert langid.visible("a<SCRIPT>x</script >b<!-- c --><p>d<style>e").split() == ["a", "b", "d", "e"]


def test_a_repeated_id_is_learnt_once(spark):
    rows = [(1, "abc abc abc", "x", "s")] * 50 + [(2, "def def def", "y", "s")]
    model = langid.learn_text(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert model.languages == ["x", "y"] and abs(np.exp(model.table).max(1)[0] - np.exp(model.table).max(1)[1]) < 1e-6


def test_url_parts(spark):
    parts = langid.url_parts(F.col("u"))
    got = spark.createDataFrame([("https://u@Blog.A.co.uk:8/x?y",), ("nohost",), (None,)], "u string").select(*[c.alias(k) for k, c in parts.items()]).collect()
    assert tuple(got[0]) == ("blog.a.co.uk", "co.uk", "uk") and got[1].host is None and got[2].host is None


# --- 4 quality -----------------------------------------------------------------------------------------------------


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    bad = out[out["quality"] == 0]
    assert (out["predicted"] == out["quality"]).mean() > 0.98 and (bad["predicted"] == 0).mean() > 0.95
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (5, 0)], "doc_id long, quality int")
    got = quality.classify(odd, some).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.classify(none, some).count() == 0 and quality.keep_good(odd, some).columns == odd.columns
    assert {r.score for r in quality.classify(odd, some.limit(0)).collect()} == {0.5}


def test_labels_are_not_learnt_from_held_out_rows(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    got = {r.doc_id for r in labelled(docs, docs.select("doc_id", F.lit(1).alias("y")), "y", 1000).collect()}
    assert got == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, alone = quality.fit(x, y), quality.fit(x, y, pairs=0)
    assert ((with_pairs.score(x) > 0.5) == y).mean() > 0.95 > 0.7 > ((alone.score(x) > 0.5) == y).mean()
    assert with_pairs.pairs[0] == (0, 1)
    again = quality.Model.loads(with_pairs.dumps())
    assert (again.score(x) == with_pairs.score(x)).all()


# --- 5 chat --------------------------------------------------------------------------------------------------------


def test_templates():
    run = lambda t, **v: chat.compile_template(t)(**v)
    assert run("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}])[0] == "1P,2Q"
    assert run("{% set a = 'x' ~ 1 %}{{ a }}{# no #}{% if a == 'x1' and 1 < 2 %}y{% elif a %}n{% else %}m{% endif %}")[0] == "x1y"
    assert run("a{% generation %}bc{% endgeneration %}d{% generation %}{{ e }}{% endgeneration %}", e="é") == ("abcdé", [(1, 3), (4, 5)])
    assert run("a  {{- 'b' -}}  c")[0] == "abc" and run("{{ none }}{{ m['k'][0] }}", m={"k": "z"})[0] == "z"
    for bad in ("{% for x %}", "{{ x | eval }}", "{% if a %}", "{{ a( }}", "{{ import os }}", "{% endfor %}", "{{ }}", "{{ x.__class__() }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        run("{{ x.__class__ }}", x=1)


def test_constants_are_folded():
    body = chat.fold_body(chat.parse("a{{ 'b' ~ 2 }}{% if 1 == 2 %}x{% else %}c{% endif %}{% if q %}{{ 'd' | upper }}{% endif %}"))
    assert len(body) == 2 and body[0].value.value == "ab2c" and body[1].arms[0][1][0].value.value == "D"


def test_escapes():
    random.seed(2)
    for _ in range(2000):
        s = "".join(random.choice(["<|", "|>", "\\", "n", "\n", "im_end", "é"]) for _ in range(random.randint(0, 8)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape(chat.escape_line(s)) == s and "\n" not in chat.escape_line(s)


WHOLE = "{% set n = 'none' %}{% for m in messages %}{{ loop.index }}{{ n }}{{ '<|im_start|>' }}{{ m.role | escape_line }}{{ '\\n' }}{% if loop.last %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>{% set n = m.role %}{% endfor %}"


def test_templates_that_see_other_messages(spark):
    assert chat.by_message(chat.TEMPLATE) and chat.by_message("{% for m in messages %}{{ m.text }}{% endfor %}")
    for other in (WHOLE, "a{% for m in messages %}{{ m.text }}{% endfor %}", "{% for m in messages %}{{ loop.index }}{% endfor %}", "{% for m in messages %}{{ messages[0].text }}{% endfor %}", "{% for m in messages %}{% set x = 1 %}{% endfor %}", "{{ x }}", ""):
        assert not chat.by_message(other)
    with pytest.raises(chat.TemplateError):
        chat.render_turns(spark.createDataFrame([(1, 1, "a", "b")], "conv_id long, turn long, role string, text string"), WHOLE)
    rows = [(1, 0, "user", "q<|im_end|>"), (1, 1, "assistant", "a"), (2, None, None, None), (1, 2, "user", "é"), (None, 1, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    out = chat.render_conversations(df, WHOLE)
    run = chat.compile_template(WHOLE)
    for r in out.collect():
        messages = [{"role": o or "", "text": t or ""} for c, n, o, t in sorted(rows, key=lambda x: (x[1] is None, x[1])) if c == r.conv_id]
        assert (r.segment, [tuple(s) for s in r.spans]) == run(messages=messages, add_generation_prompt=False)
    got = {r.conv_id: r for r in chat.conversation_report(out).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256("é".encode()).hexdigest() and len(got) == 3
    assert chat.render_conversations(df.limit(0), WHOLE).count() == 0
    # Message by message or whole, the usual template gives the same text.
    by_turn = chat.render_conversations(df).orderBy(F.col("turn").asc_nulls_last()).collect()
    whole = chat.compile_template(chat.TEMPLATE)
    assert "".join(r.segment for r in by_turn if r.conv_id == 1) == whole(messages=[{"role": o, "text": t} for c, _, o, t in rows if c == 1], add_generation_prompt=False)[0]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "<|im_end|>\n"), (1, 0, "user", None), (1, None, "us\ner", "x"), (1, 0, "user", None), (None, 0, None, "é"), (2, 5, "assistant", ""), (2, 5, "assistant", "b\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat.conversation_report(chat.render_turns(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2], chat.escape(t[3])))
        learnt = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.conversation_report(chat.render_turns(df.limit(0))).count() == 0


# --- 6 digests -----------------------------------------------------------------------------------------------------


def plain_form(t):
    t = unicodedata.normalize("NFKC", t or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())


def test_digests(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd.select("doc_id", "text")):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
        ties = defaultdict(list)
        for i, t in rows:
            ties[i].append(t)
        hashes = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
        rows = [(i, t) for i in ties for t in sorted(ties[i], key=lambda t: (hashes[t], t))]
        wanted = Counter()
        for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            d = lambda x: xxhash.xxh3_128_hexdigest(plain_form(x).encode())
            wanted[i, len(t), hashlib.sha256(e.encode()).hexdigest(), d(t), d(e), float(plain_form(t) == plain_form(e)), float(plain_form(t) == plain_form(n))] += 1
        got = digest.fingerprint_report(df).collect()
        assert Counter(tuple(r) for r in got) == wanted
    assert digest.fingerprint_report(none).count() == 0
    groups = {r.doc_id: r for r in digest.exact_groups(spark.createDataFrame([(1, "Ａ  b"), (2, "a B\n"), (3, "c")], "doc_id long, text string")).collect()}
    assert groups[2].group_id == 1 and groups[1].copies == 2 and groups[3].copies == 1


def test_edited_forms_that_share_a_digest_are_found(spark):
    rows = spark.createDataFrame([("d1", "s1", "e1", "t1"), ("d2", "s2", "d1", "s1"), ("d3", "s3", "e1", "t2"), ("e1", "t1", "d2", "zz")], "digest string, second string, edited_digest string, edited_second string")
    assert {r.digest for r in digest.crossed(rows).collect()} == {"e1", "d2"}


def test_different_forms_in_one_bucket_are_told_apart(spark):
    rows = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "digest string, second string")
    got = digest.resolved(rows, spark.createDataFrame([("x",)], "digest string"), {"fingerprint": ("digest", "second")})
    assert sorted(r.fingerprint for r in got.collect()) == ["x-1", "x-2", "y"]


# --- 7 sharding ----------------------------------------------------------------------------------------------------


def plain_ring(keys, order, room, bits):
    """Keys one by one clockwise from the last virtual node; each goes to the next shard with room."""
    arc = lambda h: next((i for i, (p, _) in enumerate(order) if p >= h >> 48 - bits), 0)
    turn = lambda h: h >> 48 - bits > order[-1][0]
    used, out = [0] * len(room), Counter()
    for h, key in sorted(keys, key=lambda k: (arc(k[0]), not turn(k[0]), k[0], str(k[1]))):
        i = arc(h)
        while used[s := order[i % len(order)][1]] == room[s]:
            i += 1
        used[s] += 1
        out[key, s] += 1
    return out


def test_ring(spark, odd, none):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    out = sharding.bounded_ring(docs, 8).toPandas()
    assert sorted(out["shard"].value_counts()) == [125] * 8
    for _, rows in out.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16)
    wanted = plain_ring([(h(i), i) for i in out["doc_id"]], sharding.ring(spark, 8), [125] * 8, sharding.BITS)
    assert Counter(zip(out["doc_id"], out["shard"])) == wanted
    got = sharding.bounded_ring(odd, 3).toPandas()
    assert len(got) == len(ODD) and max(Counter(got["shard"]).values()) - min(Counter(got["shard"]).values()) <= 1
    assert Counter(got["size"]) == Counter(len((t or "").encode()) + 1 for _, t, *_ in ODD)
    assert Counter(got["text_crc32"]) == Counter(zlib.crc32((t or "").encode()) for _, t, *_ in ODD)
    assert sharding.bounded_ring(none).count() == 0


@pytest.mark.parametrize("run", [1 << 17, 7])
def test_a_hot_key_is_spread(spark, monkeypatch, run):
    monkeypatch.setattr(sharding, "RUN", run)
    docs = spark.range(900).select(F.when(F.col("id") < 600, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.bounded_ring(docs, 8).toPandas()
    assert len(out) == 900 and sorted(out["shard"].value_counts())[0] >= 112 and not out.duplicated(["shard", "slot"]).any()


def test_slack_limits_movement(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before, after = (sharding.bounded_ring(docs, n, slack=0.25).toPandas().set_index("doc_id")["shard"] for n in (8, 9))
    assert (before != after.reindex(before.index)).mean() < 0.35 and before.value_counts().max() <= 625


def test_movement_as_registered(spark):
    """With counts at most one apart, as op7 has them, one more shard takes a ninth of the rows; few others move."""
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before, after = (sharding.bounded_ring(docs, n).toPandas().set_index("doc_id")["shard"] for n in (8, 9))
    after = after.reindex(before.index)
    assert (before != after).mean() < 0.25 and ((before != after) & (after == 8)).mean() > 0.11


# --- 8 near duplicates ---------------------------------------------------------------------------------------------


def test_sets_meet_in_any_four_positions():
    from itertools import combinations

    for sets, n in ((simhash.covering_sets(10), 20), (simhash.covering_sets(1 << 40), 70)):
        assert len(sets) == n and all(any(set(t) <= set(q) for t in sets) for q in combinations(range(8), 4))


def test_postings_tally_shared_bytes():
    rng = np.random.default_rng(3)
    for size in (8, 20):
        signatures = rng.integers(0, 4, (40, size), np.uint8)
        signatures[:, 2] = 9
        index = simhash.Postings(signatures)
        assert index.common == 1 and all((index.tally(i) == (signatures == signatures[i]).sum(1)).all() for i in range(40))


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    random.seed(3)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == classes(ids, [p for p in pairs if p[0] != p[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_joined_where_their_links_are(spark, monkeypatch):
    from prosemill.llm import common

    monkeypatch.setattr(common, "SMALL", 10)
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 540)] + [(399, 520)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == classes({x for p in pairs for x in p}, pairs)


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd, none):
    docs = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fp = {r.doc_id: plain_simhash(r.text) for r in docs.collect()}
    ids = sorted(fp)
    wanted = classes(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert all(got[i].fingerprint == f"{fp[i]:016x}" and got[i].component_id == wanted[i] for i in ids)
    out = simhash.simhash_components(odd.limit(100)).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.fingerprint == "0" * 16} == {2}
    assert simhash.simhash_components(none).count() == 0


def test_hash_is_the_contract_s(spark):
    assert int(simhash.shingle_hashes(simhash.words("Aé b C d"), 4).view(np.int64)[0]) == spark.sql("select xxhash64('aé b c d')").first()[0]


def test_crowded_keys_are_cut_into_blocks(spark):
    random.seed(4)
    fps = list({sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for _ in range(300)} | {random.getrandbits(64) for _ in range(50)})
    entries = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, bytearray(f.to_bytes(8, "big"))) for f in fps], "node long, signature binary")
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    wanted = classes(signed.values(), [(signed[a], signed[b]) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    for block, sets in ((8192, simhash.covering_sets(1)), (16, simhash.covering_sets(1)), (8192, simhash.covering_sets(1 << 40))):
        found = {r.node: r.root for r in components.components(simhash.links(entries, sets, 4, 4, 8, block)).collect()}
        assert {n: found.get(n, n) for n in wanted} == wanted


def test_near_copies(spark, odd, none):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    wanted = classes(ids, [(a, b) for a in ids for b in ids if a < b and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and alike(sets[a], sets[b])])
    out = simhash.drop_near_copies(docs)
    assert {r.doc_id for r in out.collect()} == set(wanted.values()) and out.columns == docs.columns
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "1", "2", "4", "5", "6", "None"]
    assert simhash.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("most", [2048, 100])
def test_near_copies_among_many_just_below(spark, monkeypatch, most):
    """Hundreds of texts, each nearly as like to all others as to the one whose copy it is."""
    monkeypatch.setattr(simhash, "TEXTS", most)
    random.seed(9)
    new = iter(range(1 << 30))
    some = lambda n: [f"w{next(new)}" for _ in range(n)]
    base, texts = some(204), []
    for k in range(200):  # of two texts that share q more words, (200 + q) of (260 - q) shingles are shared: from 0.77 to 0.87
        shared = some(k % 13)
        texts += [base + shared + some(30 - len(shared)) for _ in range(2)]
    random.shuffle(texts)
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    ids = range(len(texts))
    wanted = classes(ids, [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert 200 < len(set(wanted.values())) < 400
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == set(wanted.values())


# --- 9 packing -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_ids_are_the_tokenizer_s(path, monkeypatch):
    import time

    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "WORDS", 50)  # words are forgotten on the way

    whole, encode = Tokenizer.from_file(path), packing.tokenizer(path)
    random.seed(5)
    letters = list("ab'stre \n\t  .,!_-09½²é߀Ω中ー́\x1c\x85　​ªºµ") + ["'ll", "<|endoftext|>", "🙂"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    texts += ["".join(random.choice([*letters, " a", " é,", ". Ab", "\nx", " ÿÿ!", " 12", " 'll"]) for _ in range(random.randint(0, 12))) for _ in range(6000)]
    for t in texts:
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    began = time.perf_counter()
    for t in (" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000):
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert time.perf_counter() - began < 60


def test_best_fit():
    random.seed(6)
    for _ in range(300):
        window = random.choice([5, 8, 16, 31, 100])
        lengths = [random.randint(1, window) for _ in range(random.randint(1, 60))]
        rooms, wanted = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else window) - lengths[i])
        places = packing.best_fit(lengths, window)
        assert len(rooms) == 1 + max(s for s, _ in places)
        used = defaultdict(list)
        for (s, o), n in zip(places, lengths):
            used[s].append((o, n))
        for v in used.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= window


def test_packing(spark, odd, none, path):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    pieces = packing.token_pieces(docs, path, 256).cache()
    out = packing.pack(pieces, 256, block=300).toPandas()
    encode = packing.tokenizer(path)
    whole = {r.doc_id: encode(r.text) + bytes(4) for r in docs.collect()}
    for i, rows in out.groupby("doc_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(whole[i]) // 4 and r.ids_crc32 == zlib.crc32(whole[i][4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(whole[i]) // 4
    for _, rows in out.groupby("sequence_id"):
        at = 0
        for r in rows.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert out["length"].sum() / (256 * out["sequence_id"].nunique()) > 0.97
    got = packing.pack(packing.token_pieces(odd, path, ids=False)).toPandas()
    assert Counter(got.drop_duplicates(["sequence_id", "offset"])["start"])[0] == len(ODD)
    assert packing.pack(packing.token_pieces(none, path)).count() == 0


def test_sequences_are_whole(spark, odd, none, path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    encode = packing.tokenizer(path)
    wanted = Counter()
    for r in docs.collect():
        ids = encode(r.text or "") + bytes(4)
        wanted.update((r.doc_id, at // 4, ids[at : at + 1024]) for at in range(0, len(ids), 1024))
    pieces = packing.token_pieces(docs, path, 256)
    laid = packing.sequences(pieces, 256, block=300, pad_id=7).cache()
    found = Counter()
    for r in laid.collect():
        assert len(r.ids) == 4 * 256 and bytes(r.ids[4 * r.used :]) == b"\7\0\0\0" * (256 - r.used)
        assert [p.offset for p in r.pieces] == [sum(p.length for p in r.pieces[:i]) for i in range(len(r.pieces))] and sum(p.length for p in r.pieces) == r.used
        found.update((p.doc_id, p.start, bytes(r.ids[4 * p.offset : 4 * (p.offset + p.length)])) for p in r.pieces)
    assert found == wanted
    out = packing.digests(laid)
    plain = packing.pack(pieces, 256, block=300)
    assert out.columns == [c for c in plain.columns if c != "ids"]
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in out.collect()) == Counter((i, at, zlib.crc32(ids)) for i, at, ids in wanted.elements())
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in plain.collect()) == wanted
    assert packing.sequences(packing.token_pieces(none, path)).count() == 0
    # In one step it is the same, and the last windows of a partition aren't full, no others.
    once = packing.sequences_of(docs, path, 256, block=300, pad_id=7).collect()
    assert Counter((p.doc_id, p.start, bytes(r.ids[4 * p.offset : 4 * (p.offset + p.length)])) for r in once for p in r.pieces) == wanted
    assert len({r.sequence_id for r in once}) == len(once) and all(len(r.ids) == 1024 for r in once)
    assert packing.sequences_of(none, path).count() == 0


# --- 10 toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out[out["toxic"] == 1]["predicted"] == 1).mean() > 0.85 and (out[out["toxic"] == 0]["predicted"] == 1).mean() < 0.01
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.classify(odd, some).count() == len(ODD) and toxicity.classify(none, some).count() == 0
    assert all(r.score <= 0.5 for r in toxicity.classify(odd, some.limit(0)).collect())


def test_later_categories_use_earlier_ones():
    rng = np.random.default_rng(7)
    rows = [sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist()) for _ in range(1500)]
    first = np.array([float(0 in r or 1 in r) for r in rows])
    chain = toxicity.fit(rows, np.column_stack((first, first)), np.arange(1500) % 5, [f"t{i}" for i in range(6)], ["a", "b"])
    assert chain.weights[1][8] > 0.5 and len(chain.weights[1]) == len(chain.weights[0]) + 1
    p = toxicity.Chain.loads(chain.dumps()).probabilities(rows)
    assert ((p[:, 1] > 0.5) == first).mean() > 0.99
