"""Operators that SQL cannot express against plain re-statements, and the pipeline over awkward tables."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import DOCS, LONG, SF, awkward, brute_components, brute_hits, made_up

import corpus_pipeline
from learnlake.llm import quality, sharding, toxicity, warc
from learnlake.llm.common import numbered

M = 1 << 64


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def plain_place(row, total, seed):
    """One row number through six rounds of the network, again until it falls within the table."""
    a = math.isqrt(total - 1) + 1
    b = -(-total // a)
    while True:
        left, right = divmod(row, b)
        for i in range(6):
            key = mixed(((i + 1) * 0x9E3779B97F4A7C15 + seed) % M)
            if i % 2 == 0:
                left = (left + mixed((right + key) % M) % a) % a
            else:
                right = (right + mixed((left + key) % M) % b) % b
        row = left * b + right
        if row < total:
            return row


@pytest.mark.parametrize("shards, seed", [(3, 1), (16, 4)])
def test_shards_equal_a_plain_restatement(spark, shards, seed):
    docs, rows = awkward(spark, [f"text {k}" for k in range(40)])
    sizes = [(i, len((t or "").encode()) + 1, __import__("zlib").crc32((t or "").encode())) for i, t, *_ in rows]
    keyed = spark.createDataFrame(sizes, "doc_id long, size long, text_crc32 long").withColumn("h", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(4096)))
    low = lambda v: (v is not None, v or 0)
    order = sorted((r["h"], low(r["doc_id"]), r["size"], r["text_crc32"]) for r in keyed.collect())
    want = Counter()
    for n, (_, (_has, i), size, crc) in enumerate(order):
        place = plain_place(n, len(order), seed)
        want[(i if _has else None, size, crc, place % shards, place // shards)] += 1
    got = sharding.shard_documents(docs, shards, seed).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want


def test_numbers_take_any_column_names(spark):
    names = ["_n", "_bucket", "_size", "_lo", "_k", "_in", "_first", "_from", "a.b"]
    df = spark.createDataFrame([tuple(range(k, k + len(names))) for k in (1, 1, 2, 3)], names)
    got = numbered(df).collect()
    assert sorted(r["row_no"] for r in got) == [0, 1, 2, 3] and {r["n_rows"] for r in got} == {4} and set(names) < set(got[0].asDict())


BLOCK = set("p div br li ul h1 h2 table tr section title".split())


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.hidden, self.in_title = [], [], "", 0, False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.in_title |= tag == "title"
        if tag in BLOCK:
            self.text.append("\n")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(" ".join(dict(attrs)["href"].split()))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):  # what is hidden parts words
            self.hidden -= 1
            self.text.append(" ")
        self.in_title &= tag != "title"
        if tag in BLOCK:
            self.text.append("\n")

    def handle_comment(self, data):
        self.text.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden:
            self.text.append(data)


def test_derivatives_equal_what_a_parser_finds(spark):
    rng = random.Random(12)
    pages = []
    for k in range(60):
        parts = [f"<title>T{k} &amp; x</title>"]
        for _ in range(rng.randint(0, 30)):
            w = " ".join(rng.choices(["eins", "zwei", "a&lt;b", "é", "3"], k=rng.randint(1, 5)))
            parts.append(rng.choice([f"<p>{w}</p>", f"<b>{w}</b>", f" {w}\n", f"<script>var x = '<p>';</script>", "<br>", f'<a href="/{rng.randrange(9)}?a=1&amp;b">{w}</a>', f"<div class='a>b'>{w}</div>", "<!-- <p>no</p> -->", f"<ul><li>{w}</li></ul>"]))
        pages.append((k, f"http://h/{k}", "".join(parts)))
    got = defaultdict(dict)
    for r in warc.page_derivatives(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        got[r["page_id"]][r["warc_type"]] = r
    for k, url, html in pages:
        p = Page()
        p.feed(html)
        p.close()
        lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
        conv, meta = got[k]["conversion"], got[k]["metadata"]
        (_, block), = warc.parse_records(bytes(conv["record"]))
        assert block.decode() == "\n".join(x for x in lines if x)
        (_, fields), = warc.parse_records(bytes(meta["record"]))
        assert [x[9:] for x in fields.decode().split("\r\n") if x.startswith("outlink")] == list(dict.fromkeys(p.links))
        assert f"title: {p.title}" in fields.decode().split("\r\n")
        assert conv["payload_digest"] == meta["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert conv["refers_to"] == meta["refers_to"] and conv["target_uri"] == url and conv["block_length"] == len(block)


def test_scores_follow_from_the_weights(spark):
    rng = random.Random(1)
    weights = {b"vile ": 2.0, b"vile": 1.5, b"nasty": 0.7, b"\xc3\xa9cole": -1.0, b"good ": -3.0}
    model = toxicity.ToxicityModel(weights, -1.0, 0.1)
    texts = [None, "", LONG, "VILE", "vilely", "vil"] + [" ".join(rng.choices(["vile", "Vilest!", "nasty-y", "good", "goods", "école", "x"], k=rng.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(3, "VILE", "clash"), (None, "VILE", "clash")], "doc_id long, text string, score string")

    def plain(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = {w.encode() for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", lower)}
        has = {f for f in weights if any(w + b" " == f or (w.startswith(f) and 4 <= len(f) <= 8) for w in words)}
        return 1 / (1 + math.exp(-(-1.0 + sum(weights[f] for f in has))))

    got = toxicity.score_documents(df, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert abs(r["score"] - plain("VILE" if r["doc_id"] is None else texts[r["doc_id"]])) < 1e-12
    kept = toxicity.without_toxic(df, model)
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if plain(r["text"]) < 0.3)


def test_long_and_repeated_documents_are_learnt_from_too(spark):
    docs, labels, rows = made_up(spark, 400)
    long = "vilest " + " ".join(f"w{k}" for k in range(25_000))  # more distinct words than any bound there was
    more = [(10_001, long, "en", "src1", 1, None, None)] * 30
    ids = spark.createDataFrame([(10_001, 1, 1)], "doc_id long, quality int, toxic int")
    both, known = docs.unionByName(spark.createDataFrame(more, DOCS)), labels.unionByName(ids)
    sample = toxicity.sampled(both.select("doc_id", "text"), known.filter("toxic = 1").select("doc_id"), known.filter("toxic = 0").select("doc_id"))
    counted = Counter((r["is_toxic"], r["doc_id"]) for r in sample.collect())
    assert counted[True, 10_001] == 1 and max(counted.values()) == 1
    assert len(next(r for r in sample.collect() if r["doc_id"] == 10_001)["words"].split()) == 25_001
    assert toxicity.fit(both, known).score("nothing vilest here") > 0.3
    assert quality.fit(both, known).weights.shape == quality.fit(docs, labels).weights.shape


def plain_posteriors(own, sites, base):
    """The hierarchy of all documents, hosts and paths, shrunk by the spread of their shares."""

    def worth(groups):
        n = sum(k for k, _, _ in groups)
        between = max(sum(k * ((s / k - p) ** 2 - p * (1 - p) / k) for k, s, p in groups) / n, 0.0)
        return max(min(sum(k * p * (1 - p) for k, _, p in groups) / n / max(between, 1e-12) - 1, 1e6), 1.0)

    clip = lambda p: min(max(p, 0.001), 0.999)
    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for p, (h, q) in zip(own, sites):
        for table, key in ((hosts, h), (paths, (h, q))):
            table[key][0] += 1
            table[key][1] += p
    overall = clip(sum(own) / len(own))
    w = worth([(n, s, overall) for n, s in hosts.values()])
    host = {h: (s + w * overall) / (n + w) for h, (n, s) in hosts.items()}
    w = worth([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
    share = {k: clip((s + w * host[k[0]]) / (n + w)) for k, (n, s) in paths.items()}
    logit = lambda p: math.log(p / (1 - p))
    return [1 / (1 + math.exp(-(logit(p) - logit(base) + logit(share[k])))) for p, k in zip(own, sites)]


def test_quality_follows_from_the_evidence(spark):
    docs, labels, rows = made_up(spark, 300)
    model = quality.fit(docs, labels)
    odd, more = awkward(spark)
    every, rows = docs.unionByName(odd), rows + more
    own = model.probability([r[1] for r in rows])
    want = plain_posteriors(own.tolist(), [(r[3], r[2]) for r in rows], model.base)
    got = quality.classify(every, model, F.col("source"), F.col("lang")).collect()
    pairs = lambda xs: sorted((repr(i), round(o, 9), round(q, 7)) for i, o, q in xs)
    assert pairs((r["doc_id"], r["own"], r["quality"]) for r in got) == pairs((r[0], o, q) for r, o, q in zip(rows, own, want))


def write(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_the_pipeline_takes_awkward_and_empty_tables(spark, tmp_path):
    more = "doc_id long, text string, lang string, source string, n_chars long, Text2 string, row_no string, site_share double"
    base = [tuple(r) + (None, None, 0.5) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(*r, 0.1) for r in awkward(spark)[1]]
    near = " ".join(f"w{k}" for k in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    made = [(900_001, near + " end", "en", "s", 1, None, None, 0.0), (900_002, near + " eend", "en", "s", 1, None, None, 0.0), (900_002, "another text of its own with words enough", "en", "s", 1, None, None, 0.0), (None, near, "en", "s", 1, None, None, 0.0), (900_003, item, "en", "s", 1, None, None, 0.0)]
    rows = base + odd + made
    folder = write(spark, tmp_path / "odd", spark.createDataFrame(rows, more))
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = (before.collect(), docs.collect())
        if name != "best-fit packing":
            assert docs.columns == before.columns
    given, kept = seen["n-gram Jaccard join"]
    parts = Counter(c for _, n, c in brute_components([(k, r["text"]) for k, r in enumerate(given)], 5, 80) if n)
    wordless = sum(not (r["text"] or "").split() and r["doc_id"] is None for r in given) + len({(r["doc_id"], r["text"]) for r in given if not (r["text"] or "").split() and r["doc_id"] is not None})
    assert len(kept) == len(parts) + wordless
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    given, kept = seen["benchmark decontamination"]
    assert all(not brute_hits(r["text"], items, 10)[1] for r in kept)
    clean = Counter(repr(r) for r in given if not brute_hits(r["text"], items, 10)[1])
    assert not clean - Counter(map(repr, kept))
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(repr, pieces)).total() == len(seen["best-fit packing"][1])
    none = write(spark, tmp_path / "none", spark.createDataFrame([], more))
    assert corpus_pipeline.run(spark, none).count() == 0
