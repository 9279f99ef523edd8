"""Operators against brute force on small fixtures."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import bpe, chat, exact_dedup, kdtree, lm_scoring, packing, pii, simhash, toxicity, urls

DOCS = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.WordBpe(bpe.vocabulary_path())


@given(st.lists(st.text(max_size=40) | st.text(alphabet="aAbzÉéßẞñŒœµªº×÷ÿŸ\u212a\u212bİıσΣς'’.,$%<|>1٣\u0301 \x1c\x85\xa0\n", max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_library(texts):
    from tokenizers import Tokenizer

    test_bpe_is_the_library.t = t = getattr(test_bpe_is_the_library, "t", None) or Tokenizer.from_file(bpe.vocabulary_path())
    words = bpe.loaded(bpe.vocabulary_path())
    for text, data in zip(texts, bpe.Encoder(words.encode_chunks)(pa.array(texts, pa.string())).to_pylist(), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, "<u4").tolist() == want
        assert words.decode(want) == t.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself(vocabulary):
    inner = {w: i for w, i in vocabulary.final.items()}
    got = vocabulary.encode_words(inner)
    assert all(got[w] == [i] for w, i in inner.items())


def test_cache_is_bounded(tokenizer):
    words = bpe.WordBpe(bpe.vocabulary_path())
    words.held.most = 7
    e = bpe.Encoder(words.encode_chunks, most=5)
    texts = [f"alpha{i} beta{i % 3}. gamma {'long' * 50}{i}" for i in range(30)]
    got = [np.frombuffer(x.as_py(), "<u4").tolist() for i in range(0, 30, 4) for x in e(pa.array(texts[i : i + 4]))]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(e.held.keys) <= 5 and len(words.held.keys) <= 7
    assert all(len(k.as_py()) <= bpe.CACHE_BYTES for k in e.held.keys)


def test_long_lists_are_written_out_in_runs(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "JOINED_IDS", 8)
    lists = [[5, 6, 7], [], list(range(100, 130)), [9], [], list(range(40, 49))]
    ids = pa.array(lists, pa.list_(pa.int32())).slice(1)
    assert [x.as_py().decode() for part in vocabulary.joined(ids, "decimals") for x in part] == [" ".join(map(str, x)) for x in lists[1:]]
    assert [x.as_py().decode() for part in vocabulary.joined(ids, "tokens") for x in part] == [vocabulary.decode(x) for x in lists[1:]]


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_best_fit(lengths, open_bins):
    bins, content = packing.BestFit(64, open_bins), collections.defaultdict(int)
    for n in lengths:
        at, offset = bins.place(n)
        assert offset == content[at]
        content[at] += n
        assert content[at] <= 64 and bins.open <= open_bins


def test_op1(spark, tokenizer):
    docs = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()}
    rows = packing.op1_packing(spark, DOCS).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(docs)
    for i, ids in docs.items():
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(map(len, docs.values()))
    assert len({r.sequence_id for r in rows}) <= 1.03 * total / 4096 + 1


def test_op8(spark, tokenizer):
    for r, d in zip(bpe.op8_bpe(spark, DOCS).orderBy("doc_id").collect(), spark.read.parquet(f"{DOCS}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit / sum(r.toxic for r in got) > 0.9 and hit / sum(r.predicted for r in got) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_op3_against_plain_models(spark):
    """Scores are a rising function of the mean over all words of the difference of log-likelihoods under two models written out in full."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: toxicity.words(r.text) for r in docs.collect()}
    count = {0: collections.Counter(), 1: collections.Counter()}
    for i, found in texts.items():
        if i in toxic and zlib.crc32(str(i).encode()) % 4 != 2:
            count[toxic[i]].update(set(found))
    shared = count[0] + count[1]
    total = {c: sum(count[c].values()) for c in count}
    everything = sum(total.values())

    def keeps(c, w):
        expected = shared[w] * total[c] / everything
        return max(0, count[c][w] - expected - 3 * expected**0.5 - 0.75) / total[c]

    free = {c: 1 - sum(keeps(c, w) for w in count[c]) for c in count}
    likelihood = lambda c, w: keeps(c, w) + free[c] * (shared[w] + 1) / (everything + len(shared) + 1)
    for c in count:  # a distribution, with one place for all unknown words
        assert abs(sum(likelihood(c, w) for w in shared) + likelihood(c, "") - 1) < 1e-9
    difference, unknown, (slope, constant) = toxicity.fit(docs, labels)
    assert slope > 0 and difference
    for r in toxicity.op3_toxicity(spark, sf).collect():
        found = texts[r.doc_id]
        mean = sum(np.log(likelihood(1, w)) - np.log(likelihood(0, w)) for w in found) / max(1, len(found)) - (np.log(free[1] / free[0]) if found else 0)
        mean = 0 if abs(mean) < 1e-12 else mean
        x = toxicity.feature(found, difference, unknown)
        assert abs(x * abs(x) - mean) < 1e-9
        assert abs(r.score - 1 / (1 + np.exp(-slope * x - constant))) < 1e-9


def test_op3_learns_the_share_of_all_labels_from_a_capped_sample(spark):
    """On held-out rows, with caps that bite, precision holds and scores add up to about the toxic rows."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, sample_rows=1000)
    held = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(held, model).collect()
    predicted = [r for r in got if r.score >= toxicity.THRESHOLD]
    assert sum(r.toxic for r in predicted) / len(predicted) > 0.75
    assert 0.8 < sum(r.score for r in got) / sum(r.toxic for r in got) < 1.25


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return sorted(out)


TRICKY = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112", "é😀 a.b+c@d-e.fg.hi, 😀+49 30 1234567.", "9" * 5000, "a" * 20_000 + "@b.c", "foo@bar.com@baz.com", "+1+2345678901", "1.2.3.4" * 300, "u@v.w " * 2000, "4111111111111111", "x@y.z-+1 222 333 4444"]


def test_op4(spark, tmp_path):
    small = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text")
    spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(TRICKY)], small.schema).union(small).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    rows = pii.op4_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith(("term", "secret"))) == line
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in want) for k in PLAIN]


def plain_terms(texts):
    """Disclosing terms of distinct texts, by dictionaries, with the default thresholds; matches and words by Python's patterns."""
    import math

    secret = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{16})(?=(?:[A-Za-z]*[0-9]){3})(?=(?:[0-9]*[A-Za-z]){3})[A-Za-z0-9]+"
    term = r"(?<![^\W_])(?=\d*[^\W\d_])[^\W_]{2,}"
    texts = sorted(set(texts))
    meets, near, of_entity, occurs = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for k, text in enumerate(texts):
        for w in re.findall(term, text.lower()):
            occurs[w].add(k)
        for kind, pattern in (PLAIN | {"secret": secret}).items():
            spans = [m.span() for m in re.finditer(pattern, text)]
            valid = {(a, b) for a, _, x, b in base_spans(text) if x == kind}
            for (a, b), (_, left), (right, _) in zip(spans, [(0, 0), *spans], [*spans[1:], (len(text), 0)], strict=False):
                if kind != "secret" and (a, b) not in valid:
                    continue
                value, number = text[a:b].lower(), re.sub("[^0-9]", "", text[a:b])
                names = {"email": (value, value.split("@")[-1]), "ip": (value, value.rpartition(".")[0]), "card": (number, number[:6]), "phone": (number, number[:4]), "secret": (value, len(value))}[kind]
                before, after = (" " * (left == 0 and a == spans[0][0]) + text[left:a])[-80:], (text[b:right] + " " * (b == spans[-1][1]))[:80]
                before, after = (re.sub(r"^[^\W_]+|[^\W_]+$", "", x) for x in (before, after))
                for entity in (f"{kind}={names[0]}", f"{kind}~{names[1]}", kind):
                    of_entity[entity].add(k)
                    for w in re.findall(term, f"{before}\n{after}".lower()):
                        meets[w, entity].add(k)
                        near[w].add(k)
    out = {}
    for (w, entity), together in meets.items():
        p, content = len(together) / len(occurs[w]), math.log2(len(texts) / len(of_entity[entity]))
        if p >= 0.5 and content > 0 and math.log2(p) + content >= 0.75 * content:
            out.setdefault(w, []).append((p, together))
    return texts, out


def test_disclosing_terms_against_counts(spark):
    """Whatever the operator finds has the plain probability; whatever meets an entity in many different texts is found."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    names = ["alpha", "bravo", "charlie", "delta", "echo"]
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    # A fixed signature in many different documents.
    texts += [f"{filler(60)}. Contact Alissya Smythe, Akmelabs, a.s@labs.example.org" for _ in range(40)]
    # Names with an address each, of one domain, and one staff number.
    texts += [f"{filler(30)} {names[i % 5]}quist E4471x wrote from {names[i % 5]}@firm.example {filler(30)}" for i in range(60)]
    # One text a hundred times with another word at its end: near copies are no evidence.
    texts += [f"{' '.join(['kopiertes', 'wort'] + [f'w{i}ort' for i in range(40)])} kop@x.org {filler(1)}" for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keyed = df.select(pii.key_of(F.col("text")).alias("key"), "text")
    got = {r.term: r.probability for r in pii.disclosing_terms(keyed)[0].collect()}
    distinct, want = plain_terms(texts)
    shingle = lambda k: frozenset(zip(*(distinct[k].lower().split()[j:] for j in range(3)), strict=False))
    for w, p in got.items():
        assert any(abs(p - q) < 1e-12 for q, _ in want[w]), w
    for w, found in want.items():
        # Texts that share no shingle are different for sure.
        apart = [t for _, t in found if len(t) >= 3 and sum(map(len, map(shingle, t))) == len(frozenset().union(*map(shingle, t)))]
        if apart:
            assert w in got, w
    assert {"alissya", "smythe", "akmelabs", "alphaquist", "e4471x", "token"} <= set(got)
    assert not {w for w in got if w.startswith(("kopiert", "w1", "w2"))}
    spans = {r.text: r.term_spans for r in pii.term_spans(keyed).join(keyed, "key").collect()}
    for text, found in spans.items():
        assert [(s.start, s.end) for s in found] == [m.span() for m in re.finditer(r"(?<![^\W_])(?=\d*[^\W\d_])[^\W_]{2,}", text) if m[0].lower() in got]
    assert len(spans) == sum(bool(set(re.findall(r"(?<![^\W_])(?=\d*[^\W\d_])[^\W_]{2,}", t.lower())) & set(got)) for t in set(texts))


def test_op4_finds_terms(spark):
    rows = pii.op4_pii(spark, "/root/testdata/sf0.01").collect()
    assert sum("term:" in r.spans for r in rows) >= 3 and sum("secret:" in r.spans for r in rows) >= 3


def test_running_sums(spark):
    sizes = [0, 1, 127, 128, 129, 1000]
    df = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, x array<long>").orderBy("n").withColumn("b", pii.in_blocks(F.col("x"))).withColumn("s", pii.before(F.transform("b", pii.total)))
    for n, got in zip(sizes, df.select(pii.running(F.col("b"), F.col("s"))).collect(), strict=True):
        assert got[0] == np.cumsum(range(n)).tolist()


def test_op5_against_plain_counts(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DOCS}/labels.parquet")
    rows = {r.doc_id: r for r in lm_scoring.op5_lm_scoring(spark, DOCS).collect()}
    texts = {r.doc_id: re.findall(r"\w+", (r.text or "").lower()) for r in docs.collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    score = plain_scorer(texts, good)
    for i, t in texts.items():
        assert abs(rows[i].score - (score(t) if t else 0.0)) < 1e-9 and rows[i].n_tokens == len(t)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    mean = [np.mean([rows[i].score for i, q in quality.items() if q == k]) for k in (0, 1)]
    assert mean[1] < mean[0]


def plain_scorer(texts, good):
    """Cross-entropy difference by dictionaries, without a limit on words or bigrams; a text's end is a context's end too."""
    pairs = lambda t: list(zip(["", *t[:-1]], t, strict=True))
    models = []
    for some in ([t for i, t in texts.items() if i in good], list(texts.values())):
        grams = collections.Counter(p for t in some for p in pairs(t))
        ends = collections.Counter(t[-1] for t in some if t)
        models.append((grams, collections.Counter(p[0] for t in some for p in pairs(t)) + ends, collections.Counter(w for t in some for w in t)))
    size = len(models[1][2])

    def loss(grams, contexts, unigrams, total, p):
        return -np.log2((grams[p] + lm_scoring.PRIOR * (unigrams[p[1]] + 1) / (total + size + 2)) / (contexts[p[0]] + lm_scoring.PRIOR))

    models = [(*m, m[2].total()) for m in models]
    return lambda text: np.mean([loss(*models[0], p) - loss(*models[1], p) for p in pairs(text)])


def plain_score(texts, good, text):
    return plain_scorer(texts, good)(text)


def test_lm_scoring_target_is_all_good_documents(spark):
    rng = np.random.default_rng(6)
    texts = {i: [f"v{x}" for x in rng.integers(0, 500, 8)] for i in range(21_000)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 20_500)) for i in range(21_000)] + [(5, 1), (None, 1)], "doc_id long, quality int")
    ids = lm_scoring.vocabulary(df)
    got = {r.doc_id: r for r in lm_scoring.score(df, ids, lm_scoring.fit(df, lm_scoring.target_ids(labels), ids)).collect()}
    assert len(got) == 21_000
    for i in (0, 20_499, 20_999):
        assert abs(got[i].score - plain_score(texts, set(range(20_500)), texts[i])) < 1e-9


def test_lm_scoring_counts_each_bigram_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 200_000, raising=False)
    rng = np.random.default_rng(5)
    texts = {i: [f"w{x}" for x in rng.integers(0, 60_000, 3000)] for i in range(420)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    good = set(range(0, 420, 3))
    ids = lm_scoring.vocabulary(df)
    models = lm_scoring.fit(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), ids)
    got = {r.doc_id: r for r in lm_scoring.score(df, ids, models).collect()}
    assert len(got) == 420
    for i in (0, 1, 3, 419):
        assert abs(got[i].score - plain_score(texts, good, texts[i])) < 1e-9
    # Texts that the models have not counted.
    other = texts[7][:50] + ["unseen"] + texts[9][:50]
    (row,) = lm_scoring.score(spark.createDataFrame([(1, " ".join(other))], "doc_id long, text string"), ids, models).collect()
    assert row.n_tokens == 101 and abs(row.score - plain_score(texts, good, other)) < 1e-9


@given(st.integers(0, 2**32), st.integers(1, 3), st.integers(1, 6))
@settings(max_examples=25, deadline=None)
def test_kd_tree(seed, spread, k):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(-spread, spread + 1, (400, 6)), rng.permutation(400)
    tree = kdtree.KdTree(ids, x, leaf=16)
    q = rng.integers(-spread, spread + 1, (9, 6))
    (a, b, c), = tree.search(np.arange(9), q, np.full(9, -np.inf), k)
    for i in range(9):
        want = sorted(((-int(s), int(j)) for s, j in zip(x @ q[i], ids, strict=True) if j != i))[:k]
        assert [(-s, j) for j, s in zip(b[a == i], c[a == i], strict=True)] == want


def test_top_k_over_shards(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (600, 4)) / 256.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = kdtree.top_k(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=100).orderBy("query_id", "rank").collect()
    whole = np.floor(x * 256).astype(int)
    want = [(q, r + 1, j, -s) for q in range(0, 600, 50) for r, (s, j) in enumerate(sorted((-int(whole[q] @ whole[j]), j) for j in range(600) if j != q)[:5])]
    assert [tuple(r) for r in got] == want


def test_top_k_on_repeats_and_large_components(spark):
    """A third of the rows are one vector; some components are huge; shards are small. As by brute force in whole numbers."""
    rng = np.random.default_rng(4)
    x = [[1.0, -2.0, 0.5]] * 200 + [[float(v) for v in r] for r in rng.integers(-40, 40, (390, 3)) / 8.0] + [[float(v) for v in r] for r in rng.integers(-(2**40), 2**40, (8, 3))]
    rows = [(i, v) for i, v in enumerate(x)] + [(7, [1.0, -2.0, 0.5]), (601, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    small = {0, 50, 250, 350}
    got = kdtree.top_k(df, F.col("vec_id").isin(*small), k=5, shard_rows=40).collect()
    for q in small:
        (mine,) = [v for i, v in whole if i == q]
        want = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in whole if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_url_sweep_over_many_rules_and_ranges(spark):
    rng = np.random.default_rng(11)
    label = lambda: "abc"[rng.integers(3)] + "xy-"[rng.integers(3)] * int(rng.integers(2))
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "/" + "/".join("pq"[rng.integers(2)] for _ in range(rng.integers(3)))
    rules = list({(host(rng.integers(1, 4)), path()): ("block", "allow")[rng.integers(2)] for _ in range(120)}.items())
    pages = [(i, f"http://{host(rng.integers(1, 5))}{path()}") for i in range(800)]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string").repartition(4), spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string"), default="none")
    for r in got.collect():
        fits = [(len(h + p), len(h), v == "block", h + p, v) for (h, p), v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, default=None)
        assert (r.rule, r.verdict) == ((best[3], best[4]) if best else (None, "none")), r


@given(st.text(alphabet="<|\\im_startend>\n a", max_size=40), st.text(alphabet="<|\\n\nro", max_size=10))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible(text, role):
    line, a, b = chat.render(role, text)
    assert chat.parse(line) == (role, text) and chat.unescape(line[a:b]) == text and line.count(chat.START) == line.count(chat.END) == 1


@given(st.integers(0, 2**32))
@settings(max_examples=20, deadline=None)
def test_vantage_point_shards_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 120), dtype=np.uint64)
    x = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1], base ^ flips[0] ^ flips[1] ^ flips[2]]))
    tree = simhash.fit(x[::3], 8)
    at, leaf, own = simhash.route(tree, x)
    assert np.array_equal(np.sort(at[own]), np.arange(len(x)))
    forest = simhash.Forest(len(x))
    for n in np.unique(leaf):
        u, v = simhash.shard_forest(x[at[(leaf == n) & own]], x[at[(leaf == n) & ~own]])
        forest.link(np.searchsorted(x, u), np.searchsorted(x, v))
    plain = simhash.Forest(len(x))
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    plain.link(a, b)
    n = np.arange(len(x))
    assert np.array_equal(forest.roots(n), plain.roots(n))


def test_similar_texts(spark, monkeypatch):
    """Planted near copies are found and nothing else, over one shard or many, in a group of any size."""
    rng = np.random.default_rng(23)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    texts, group = [], []
    for g in range(60):
        base = [word() for _ in range(200)]
        for _ in range(300 if g == 0 else 1 + g % 3):
            copy = list(base)
            for at in rng.choice(200, 1):
                copy[at] = word()
            texts.append(" ".join(copy))
            group.append(g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for points in (100_000, 60):
        monkeypatch.setattr(simhash, "WIDE_SHARD_POINTS", points)
        got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
        assert got == {i: group.index(g) for i, g in enumerate(group)}
    assert simhash.deduplicate(df).count() == 60


def test_pairs_in_doubt_are_settled_exactly(spark):
    """Around 0.8, with one text in all pairs, against plain sets; texts of fewer words than a shingle too."""
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base)] + [" ".join([*base[:at], *(f"x{i}.{k}" for k in range(m)), *base[at + m :]]) for i, (at, m) in enumerate((at, m) for at in range(5, 150, 12) for m in range(8, 30))] + ["a b", "", "a b c"]
    rows = [(i, f"k{i:04}", x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3], "mark long, text_key string, text string")
    pairs = [(0, i) for i in range(1, len(texts))] + [(len(texts) - 3, len(texts) - 1)]

    def plain(text):
        parts = text.split()
        return {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()

    sets = [plain(x) for x in texts]
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = simhash.alike(spark.createDataFrame(pairs, "u long, v long"), df, df, 0.8).collect()
    assert {(r.u, r.v) for r in got} == want and len(got) == len(want) and 0 < len(want) < len(pairs)


def test_similar_texts_around_the_threshold(spark, monkeypatch):
    """Every pair at 0.8 or more ends in one group and no other, against plain sets: pairs alone, and a family without any group so far."""
    rng = np.random.default_rng(29)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))

    def edited(base, m):
        at = int(rng.integers(5, len(base) - m - 5))
        return [*base[:at], *(word() for _ in range(m)), *base[at + m :]]

    def plain(parts):
        return {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()

    texts = []
    for g in range(120):
        base = [word() for _ in range(204)]
        texts += [base, edited(base, 16 + g % 5)]  # 0.82 to 0.79
    sets = [plain(t) for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    alike = [len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, 240, 2)]
    assert [got[2 * g] == got[2 * g + 1] for g in range(120)] == alike and 60 < sum(alike) < 120
    assert len(set(got.values())) == 240 - sum(alike)

    monkeypatch.setattr(simhash, "MEET", 8)
    monkeypatch.setattr(simhash, "COMMON", 50)
    base = [word() for _ in range(204)]
    texts = [base, [], base[:3], base[:3]] + [edited(base, m) for m in range(1, 20) for _ in range(3)]
    sets = [plain(t) for t in texts]
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    keyed = spark.createDataFrame([(i, f"k{i:03}", " ".join(t)) for i, t in enumerate(texts)], "id long, text_key string, text string")
    rare = simhash.cut(simhash.sketches(keyed, 0.8).withColumn("mark", F.col("id")))
    first = {r.of: r.id for r in rare.orderBy(F.desc("id")).collect()}
    for roots in ([], [(i, 4) for i in range(4, 40)]):
        pairs = simhash.cut(simhash.left_apart(rare.select("mark", "of", "size", "rare"), spark.createDataFrame(roots, "node long, root long"), 0.8))
        out = simhash.alike(pairs, keyed, rare.select(F.col("of").alias("mark"), "text_key"), 0.8).collect()
        found = {frozenset((first[r.u], first[r.v])) for r in out}
        known = dict(roots)
        assert found == {frozenset(p) for p in map(tuple, want) if len({known.get(i, i) for i in p}) > 1 and 3 not in p} and len(out) == len(found) > 50


def test_shared_passages_come_last_and_texts_do_not_meet_by_them(spark, monkeypatch):
    """A passage of four texts of 8,400 is known as shared wherever they lie, so none meet by it."""
    word = lambda i, k: f"w{i}.{k}"
    texts = [" ".join([word(i, k) for k in range(14)] + [f"p{i % 2100}.{k}" for k in range(7)]) for i in range(8400)]
    keyed = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    known, counts = simhash.common_shingles(keyed)
    assert len(known) == 3 * 2100 and set(counts.tolist()) == {4} and np.array_equal(known, np.unique(known))

    given, plain = [], simhash.beside
    monkeypatch.setattr(simhash, "beside", lambda pairs, sets: given.append(pairs.count()) or plain(pairs, sets))
    rare = simhash.cut(simhash.sketches(keyed, 0.8).withColumn("mark", F.col("id")))
    none = spark.createDataFrame([], "node long, root long")
    assert simhash.left_apart(rare.select("mark", "of", "size", "rare"), none, 0.8).count() == 0 and given == [0]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_op10(spark, monkeypatch):
    import xxhash

    monkeypatch.setattr(simhash, "SHARD_POINTS", 30)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()}

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = {i: plain(t) for i, t in texts.items()}
    for r in simhash.op10_simhash(spark, DOCS).collect():
        assert r.fingerprint == f"{marks[r.doc_id]:016x}"
        near, todo = set(), {r.doc_id}
        while todo:
            i = todo.pop()
            near.add(i)
            todo |= {j for j in marks if j not in near and (marks[i] ^ marks[j]).bit_count() <= 2}
        assert r.component_id == min(near)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DOCS}/labels.parquet"))
    curve = lambda x: 1 / (1 + np.exp(-(model[2][0] * x + model[2][1])))
    kept = {r.doc_id: r.text for r in docs.collect() if curve(toxicity.feature(toxicity.words(r.text), *model[:2])) < toxicity.THRESHOLD}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
    kept = {i: kept[i] for i in first.values()}
    left = {}

    def shingles(text):
        parts = text.encode().lower().split()
        return {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))}

    sets = {i: shingles(t or "") for i, t in kept.items()}

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    for i in sorted(kept):
        todo, seen = [i], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [j for j in kept if alike(x, j)]
        if min(seen) == i:
            left[i] = kept[i]
    rows = corpus_pipeline.run(spark, DOCS).collect()
    assert {r.doc_id for r in rows} == set(left)
    whole = bpe.Encoder(bpe.WordBpe(bpe.vocabulary_path()).encode_chunks)
    for r in rows:
        if not base_spans(left[r.doc_id]) and r.piece == 0 and r.length < 4096:
            (ids,) = whole(pa.array([left[r.doc_id]], pa.string())).to_pylist()
            assert r.ids_crc32 == zlib.crc32(ids + (1).to_bytes(4, "little"))


@pytest.mark.parametrize("module", [exact_dedup, urls, chat, kdtree])
def test_sql_twins(spark, module):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DOCS}/{t}.parquet'")
    for name, sql in module.SQL.items():
        got = module.QUERIES[name](spark, DOCS)
        columns = sorted(got.columns)
        rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
        assert rows == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)
