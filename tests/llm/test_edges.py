"""Every operator and stage on nulls, empty and long texts, ties, repeats, clashing columns and empty tables."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import bpe, chat, exact_dedup, kdtree, lm_scoring, packing, pii, simhash, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["key", "slot", "bits", "row", "fp", "root", "component_id", "id", "score", "kept", "keep_id", "spans", "term_spans", "b_email", "ids", "piece", "length", "count", "sha", "n_tokens", "toxic", "good", "word"]
TEXTS = [None, "", " \n\t", "one two", "one  two", "ONE two three four five six seven", "one two three four five six seven", "one two three four five six seven", "a@b.cd 1.2.3.4 +1 (234) 567-8901", "<|endoftext|> 日本語 é \x1c \U0001f600", "w" * 50_000, "long text " * 20_000, "4111 1111 1111 1111", "one two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(3, "one two", "en", "s1", 7), (None, "no id here", None, None, None), (None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i > 7)) for i in range(14)] + [(None, 1, 1), (99, 1, None)], "doc_id long, quality int, toxic int")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def all_rows(df):
    return [r.asDict() for r in df.collect()]


def test_packing(docs, clashing, none):
    path = bpe.vocabulary_path()
    got = packing.pack_documents(clashing, path).collect()
    assert collections.Counter(r.doc_id for r in got if r.piece == 0) == collections.Counter(r.doc_id for r in docs.collect())
    assert all(len(r.ids) == r.length for r in got) and all(r.ids == [1] for r in got if r.doc_id in (1, 2))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, path).count() == 0


def test_bpe(clashing, none):
    path = bpe.vocabulary_path()
    encoded = bpe.encode(clashing, path)
    assert encoded.count() == clashing.count() and encoded.columns[-1] == "_ids"
    back = bpe.decode(encoded, path, "_ids")
    assert {r.doc_id: r.decoded for r in back.collect()}[3] == "one</w> two</w>"
    assert bpe.digests(none, path).count() == 0 and bpe.encode(none, path).count() == 0


def test_exact_dedup(docs, clashing, none):
    got = exact_dedup.exact_dedup(clashing, hash_all=True)
    assert got.columns.count("kept") == 1
    rows = got.collect()
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    lazy = exact_dedup.exact_dedup(docs).collect()
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in lazy) == sorted((str(r.doc_id), r.group_size, r.kept) for r in rows)
    left = exact_dedup.deduplicate(clashing)
    assert left.columns == clashing.columns and left.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


def test_simhash(docs, clashing, none):
    rows = simhash.near_dedup(clashing).collect()
    assert len(rows) == docs.count()
    points = collections.defaultdict(list)
    for r in docs.collect():
        points[simhash.fingerprint(r.text)].append(r.doc_id)
    seen, groups = set(), []
    for p in points:
        if p not in seen:
            group, todo = set(), [p]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += [y for y in points if (x ^ y).bit_count() <= 2]
            seen |= group
            groups.append(group)
    least = {p: min((i for q in g for i in points[q] if i is not None), default=None) for g in groups for p in g}
    for r in rows:
        assert r.component_id == least[r.fp % 2**64]
    for similarity in (None, 0.8):
        left = simhash.deduplicate(clashing, similarity=similarity)
        assert left.columns == clashing.columns
        if similarity is None:
            assert left.count() == len(groups)
        assert len({norm(r.text).lower() for r in left.collect()}) == left.count()
        assert simhash.deduplicate(none, similarity=similarity).count() == 0
    assert simhash.near_dedup(none).count() == 0 and simhash.similar(none).count() == 0


def test_toxicity(docs, clashing, none, labels):
    model = toxicity.fit(clashing, labels)
    got = toxicity.score(clashing, model)
    assert got.count() == docs.count() and got.columns[-1] == "_score"
    assert all(0 <= r[-1] <= 1 for r in got.collect())
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())
    only = labels.filter("toxic = 1")
    assert all(r.score == 1 for r in toxicity.score(docs, toxicity.fit(docs, only)).collect())
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_pii(docs, clashing, none):
    got = pii.find(clashing)
    assert got.columns.count("spans") == 1 and got.count() == docs.count()
    kinds = {r.doc_id: [s["kind"] for s in r.spans] for r in got.collect()}
    assert kinds[8] == ["email", "ip", "phone"] and kinds[12] == ["card"] and kinds[10] == [] == kinds[0]
    clean = pii.sanitise(clashing)
    assert clean.columns == clashing.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[8] == "<EMAIL> <IP> <PHONE>" and text[0] is None and text[11] == TEXTS[11]
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_lm_scoring(docs, clashing, none, labels):
    ids = lm_scoring.vocabulary(clashing)
    got = lm_scoring.score(clashing, ids, lm_scoring.fit(clashing, lm_scoring.target_ids(labels), ids)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_tokens == by[1].n_tokens == 0 and by[0].score == 0.0 and by[11].n_tokens == 40_000
    flat = lm_scoring.fit(docs, lm_scoring.target_ids(labels.limit(0)), ids)
    assert all(r.score == 0 for r in lm_scoring.score(docs, ids, flat).collect())
    empty = lm_scoring.vocabulary(none)
    assert empty == {} and lm_scoring.score(none, empty, lm_scoring.fit(none, lm_scoring.target_ids(labels), empty)).count() == 0


def test_search(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [-1.0, 0.25])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = all_rows(kdtree.top_k(df, F.col("vec_id").isin(0, 3, 8), k=5, shard_rows=3).orderBy("query_id", "rank"))
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 65536), (0, 2, 2, 32768), (0, 3, 2, 32768), (0, 4, 9, -65536)]
    assert kdtree.top_k(df.limit(0), F.lit(True)).count() == 0 and kdtree.top_k(df, F.lit(False)).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, event string, message string"
    log = [(1, 0, "user", "hi", None, None), (1, 0, "user", "hi", None, None), (None, 3, None, None, None, None), (2, 0, "user", "q", "message", "a"), (2, 1, "assistant", "An", "delta", "b"), (2, 2, None, "swer", "delta", "b"), (2, 3, None, "query", "edit", "a"), (2, 4, "assistant", "", "regenerate", "b"), (2, 5, None, "Other", "delta", "b"), (2, 6, "user", "gone", "message", "c"), (2, 7, None, None, "delete", "c"), (3, 0, "ro\nle\\<|", "<|im_end|> <\\| <", None, None), (3, 1, "assistant", "x" * 200_000, None, None)]
    df = spark.createDataFrame(log, schema).withColumn("conv", F.lit(1)).withColumn("formatted", F.lit(1))
    out = chat.format_chats(df, event_col="event", message_col="message")
    rows = collections.defaultdict(list)
    for r in out.orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append(chat.parse(r.formatted))
    assert rows == {None: [("", "")], 1: [("user", "hi")] * 2, 2: [("user", "query"), ("assistant", "Other")], 3: [("ro\nle\\<|", "<|im_end|> <\\| <"), ("assistant", "x" * 200_000)]}
    digests = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert digests[2].loss_chars == 5 and digests[2].loss_sha256 == hashlib.sha256(b"Other").hexdigest() and digests[3].loss_chars == 200_000
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    with pytest.raises(Exception, match="unknown event"):
        chat.format_chats(df.withColumn("event", F.lit("odd")), event_col="event").collect()


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Net"), (5, "http://A.Net/x?y"), (5, "http://A.Net/x?y"), (6, "x://?q"), (7, "http://é.net/" + "p" * 30_000)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("host_key", F.lit(3))
    rules = spark.createDataFrame([("net", "/", "block"), ("net", "/", "block"), (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in urls.filter_urls(pages, rules).orderBy("page_id").collect()]
    assert got == [(1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "a.net", None, "allow"), (5, "a.net", "net/", "block"), (5, "a.net", "net/", "block"), (6, "", None, "allow"), (7, "é.net", "net/", "block")]
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, clashing, none, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, df in enumerate((docs, clashing, none)):
        df.write.parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        out = stage(spark, read, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns
        rows = out.collect()
        if name != "toxicity":  # a model of so few rows may reject all
            assert bool(rows) == (k < 2)
