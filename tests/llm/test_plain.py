"""The learnt operators and the pipeline against versions that do the same one row at a time, in plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from prosemill.llm import langid, mixing, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages", "labels")}


# --- 3 language ----------------------------------------------------------------------------------------------------


def plain_trigrams(text):
    raw = text.lower().encode()
    letter = lambda b: 97 <= b <= 122 or b >= 128
    out = []
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if letter(a) + letter(b) + letter(c) >= 2:
            x, y, z = (v if letter(v) else 32 for v in (a, b, c))
            h = (x * 0x9E3779B1 ^ y * 0x85EBCA6B ^ z * 0xC2B2AE35) & 0xFFFFFFFF
            out.append((h * 0x27D4EB2F & 0xFFFFFFFF) >> 17)
    return out


def test_language_evidence(spark, tables):
    docs, pages = tables["documents"].collect(), tables["pages"].collect()
    # The text model: every labelled document is within the bound here.
    sums = defaultdict(Counter)
    for r in docs:
        for gram, n in Counter(plain_trigrams(r.text or "")).items():
            sums[r.lang][gram] += math.ceil(math.sqrt(n))
    languages = sorted(sums)
    whole = {k: sum(sums[k].values()) + 0.5 * langid.BINS for k in languages}
    log = lambda k, gram: math.log((sums[k][gram] + 0.5) / whole[k])
    rows = []
    for r in docs:
        rows.append((("d", r.doc_id), r.text or "", r.source, r.source, None, None))
    for r in pages:
        host = r.url.partition("://")[2].partition("/")[0].partition(":")[0].rpartition("@")[2].lower() or None
        tag = (r.html or "").lower().partition("<html")[2].partition(">")[0]
        lang = tag.partition("lang=")[2].strip("\"' ")[:2] or None
        rows.append((("p", r.page_id), langid.visible(r.html or ""), host, ".".join(host.split(".")[-2:]) if host else None, host.split(".")[-1] if host else None, lang))
    evidence = []
    for _, text, *_ in rows:
        grams = plain_trigrams(text)
        weight = min(len(grams), langid.WEIGHT)
        evidence.append((len(grams), [sum(log(k, g) for g in grams) / len(grams) * weight for k in languages] if grams else [0.0] * len(languages)))
    votes = [max(range(len(languages)), key=lambda i: e[i]) if n else None for n, e in evidence]
    n = len(languages)
    every = [sum(v == i for v in votes) for i in range(n)]
    base = [(v + 1) / (sum(every) + n) for v in every]

    def counts(column, value):
        return [sum(v == i for v, r in zip(votes, rows) if r[column] == value) for i in range(n)]

    known = {}
    for column in (2, 3, 4, 5):
        for value in {r[column] for r in rows if r[column] is not None}:
            known[column, value] = counts(column, value)
    got = {("d", r.doc_id) if r.doc_id is not None else ("p", r.page_id): r for r in langid.identify(tables["documents"], tables["pages"]).collect()}
    assert len(got) == len(rows)
    for (key, _, host, domain, suffix, declared), (grams, loglik) in zip(rows, evidence):
        score = list(loglik)
        for i in range(n):
            d, h = known.get((3, domain), [0] * n), known.get((2, host), [0] * n)
            smooth = (d[i] + langid.DOMAIN_PRIOR * base[i]) / (sum(d) + langid.DOMAIN_PRIOR)
            score[i] += math.log((h[i] + langid.HOST_PRIOR * smooth) / (sum(h) + langid.HOST_PRIOR)) if host is not None and sum(h) else math.log(base[i])
            for column, value in ((4, suffix), (5, declared)):
                if value is not None and sum(known[column, value]):
                    v = known[column, value]
                    score[i] += math.log((v[i] + langid.ONE * sum(v) / (sum(every) + 1)) / (every[i] + langid.ONE))
        top = max(score)
        share = [math.exp(s - top) for s in score]
        r = got[key]
        best = share.index(max(share))
        assert r.lang == (languages[best] if grams else None)
        assert abs(r.confidence - (share[best] / sum(share) if grams else 0)) < 1e-4, key


# --- 4 quality -----------------------------------------------------------------------------------------------------


def test_quality_scores(spark, tables):
    labels = {r.doc_id: r.quality for r in tables["labels"].collect()}
    docs = sorted(tables["documents"].collect(), key=lambda r: r.doc_id)
    learnt = [r for r in docs if labels.get(r.doc_id) is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = quality.fit(np.array([quality.features(r.text or "") for r in learnt]), np.array([float(labels[r.doc_id]) for r in learnt]))
    got = {r.doc_id: r for r in quality.classify(tables["documents"], tables["labels"]).collect()}
    for r in docs:
        x = quality.features(r.text or "")
        at = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.cuts)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[i]][at[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-total))) < 1e-9 and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_quality_features():
    text = "Ab ab ab, 12 x!\n#z |é\nAb ab ab, 12 x!"
    f = dict(zip(quality.FEATURES, quality.features(text)))
    words, raw = text.split(), text.encode()
    assert f["words"] == math.log1p(len(words)) and abs(f["longest_word"] - math.log1p(3)) < 1e-12 and f["distinct_words"] == len(set(words)) / len(words)
    assert f["top_word"] == max(Counter(words).values()) / len(words) and f["repeats"] == sum(a == b for a, b in zip(words, words[1:])) / len(words)
    assert f["distinct_pairs"] == len(set(zip(words, words[1:]))) / len(words) and f["digits"] == 4 / len(raw) and f["upper"] == 2 / len(raw) and f["not_ascii"] == 2 / len(raw)
    assert f["lines"] == 3 / len(words) and abs(f["repeated_lines"] - 1 / 3) < 1e-12
    shares = [n / len(raw) for n in Counter(raw).values()]
    assert abs(f["entropy"] + sum(p * math.log2(p) for p in shares)) < 1e-9
    assert quality.features("x" * 500)[2] == math.log1p(500) and quality.features(" \n") == [0.0] * len(quality.FEATURES)


# --- 10 toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity_chain(spark, tables):
    chain = toxicity.learn(tables["documents"], tables["labels"])
    width = len(chain.vocabulary)
    assert chain.categories == ["dense", "heavy", "toxic"] and [len(w) for w in chain.weights] == [width + 2, width + 3, width + 4]
    got = {r.doc_id: r for r in toxicity.classify(tables["documents"], tables["labels"]).collect()}
    for r in tables["documents"].collect():
        words = {toxicity.EDGES.sub("", w) for w in (r.text or "").lower().split()}
        here = [t in words or (t.endswith("*") and any(w[: len(t) - 1] == t[:-1] for w in words)) for t in chain.vocabulary]
        x, p = [float(h) for h in here] + [math.log1p(sum(here)), 1.0], []
        for w in chain.weights:
            before = [math.log(min(max(q, 1e-4), 1 - 1e-4) / (1 - min(max(q, 1e-4), 1 - 1e-4))) / 4 for q in p]
            p.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(x + before, w)))))
        assert max(abs(a - b) for a, b in zip(p, (got[r.doc_id].p_dense, got[r.doc_id].p_heavy, got[r.doc_id].score))) < 1e-9


def test_folds_don_t_see_their_rows():
    """A term that is the label of one fold's rows alone: a model that saw them would be sure, the folds' can't be."""
    rng = np.random.default_rng(5)
    folds = np.arange(500) % 5
    y = rng.integers(0, 2, 500).astype(float)
    leak = [[0] if f == 0 and t else [] for f, t in zip(folds, y)]
    views = {f: toxicity.design([[] if f == 0 else r for r in leak], 1) for f in range(5)}
    seen = []
    original = toxicity.odds
    try:
        toxicity.odds = lambda p: seen.append(p) or original(p)
        toxicity.fit(leak, np.column_stack((y, y)), folds, ["t"], ["a", "b"], views)
    finally:
        toxicity.odds = original
    out = [p for p in seen if p.shape[1] == 1][-1][:, 0]
    assert np.abs(out[folds == 0] - 0.5).max() < 0.2


# --- 8 near duplicates: recall -------------------------------------------------------------------------------------


def test_recall_of_near_copies_in_a_large_group(spark):
    """600 variants of one text, from 0.7 to 0.95 alike: the links found among pairs of at least 0.8."""
    random.seed(11)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(600):
        words = list(base)
        for at in random.sample(range(300), random.randint(1, 9)):
            words[at] = f"v{k}x{at}"
        texts.append(" ".join(words))
    hashes = [simhash.shingle_hashes(simhash.words(t), 5) for t in texts]
    sets = [set(h.tolist()) for h in hashes]
    signed = np.stack([np.frombuffer(simhash.minwise(h, simhash.POSITIONS), np.uint8) for h in hashes])
    bands, matches, near, met = simhash.bands(simhash.POSITIONS, simhash.BAND, simhash.BANDS), round((0.8 - simhash.MARGIN) * simhash.POSITIONS), 0, 0
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            same = signed[i] == signed[j]
            near += 1
            met += same.sum() >= matches and any(all(same[p] for p in b) for b in bands)
    assert near > 10_000 and met / near > 0.995, (near, met)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parent = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = i, j
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {i for i in range(len(texts)) if parent[i] == i}


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tables, tmp_path):
    """run against the stages done plainly: near copies by all pairs, the mix by sorted hashes, ids by the whole text."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    first = corpus_pipeline.language(spark, tables["documents"], SF)
    docs = {r.doc_id: r for r in corpus_pipeline.good(spark, first, SF).collect()}
    words = {i: (r.text or "").encode().lower().split() for i, r in docs.items()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    group = {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(sorted(docs), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    kept = [i for i in docs if root(i) == i]
    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16)
    by_source, copies = defaultdict(list), Counter()
    for i in kept:
        by_source[docs[i].source].append(i)
    sizes = {s: sum(len(words[i]) for i in ids) for s, ids in by_source.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, live = {}, set(order)
    while live:
        left, w = 1.5 * sum(sizes.values()) - sum(target.values()), sum(weight[s] for s in live)
        over = {s for s in live if left * weight[s] / w > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: left * weight[s] / w for s in live}
        live = live - over if over else set()
    for s, ids in by_source.items():
        whole, budget = int(target[s] // sizes[s]), int(target[s])
        budget -= whole * sizes[s]
        for i in sorted(ids, key=h):
            n = len(words[i])
            taken = min(n, max(budget, 0))
            copies[i] = whole + (2 * taken >= n if n else 0)
            budget -= n
    encode = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    wanted = Counter()
    for i, n in copies.items():
        ids = [*encode.encode(docs[i].text or "", add_special_tokens=False).ids, 0] if n else []
        for at in range(0, len(ids), 1024):
            piece = np.array(ids[at : at + 1024], "<u4").tobytes()
            wanted[i, at, len(piece) // 4, zlib.crc32(piece), len(ids)] += n
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == wanted
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024


def odd_tables(spark, folder, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, `__row` string, size int, h string"
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:3]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    same = "the same words again and again in one line of plain text that is long enough"
    rows = [(1, same, "en", "a", 9), (1, same, "en", "a", 9), (2, same, "en", None, None), (None, "null id words in a line", None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, "word " * 30_000, "de", "b", 1), (6, "Wörter über Wörter und Sätze", "de", "b", 1), (None, None, None, None, None)]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    odd_tables(spark, str(tmp_path / "odd"), rows)
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns == columns and {r.doc_id for r in out.collect()} <= {1, 2, 5, 6, None}
    odd_tables(spark, str(tmp_path / "none"), [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
