"""Corpus operators against brute force, exact round trips and held-out accuracy, with the awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from learnlake.llm import ann, common, decontaminate, lm_scoring, ngram_join, packing, quality, sharding, toxicity, url_graph, warc
from learnlake.llm.common import lower_words
from learnlake.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text2 string, row_no string"
LONG = "wort " * 30_000 + "ende"


def awkward(spark, more=()):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    texts = [None, "", "   \n\t", "a", "One two", "One two", LONG, LONG, "ÄÖ ß é 日本", "x" * 50_000, *more]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "src0", None, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id", "en", "src0", 5, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("total", [1, 2, 3, 16, 17, 1000, 65_537])
def test_permutation_is_a_bijection_with_an_inverse(total):
    p = sharding.Permutation(total, 9)
    x = np.arange(total)
    y = p.place(x)
    assert sorted(y) == list(x)
    assert (p.row(y) == x).all()


def test_shards_are_even_and_reproducible(spark):
    docs, rows = awkward(spark)
    got = sharding.shard_documents(docs, 3, 1).collect()
    again = sharding.shard_documents(docs.repartition(5), 3, 1).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    for r in got:
        assert sharding.row_at(r["shard"], r["slot"], len(rows), 3, 1) == r["row_no"]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_pieces_are_whole_documents_by_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    docs, rows = awkward(spark, ["It's 12,345  words\n\n of\ttext!?  ", "<|endoftext|> naïve \u00a0x", "tab\t\tend \n"])
    got = packing.pack_documents(docs, tokenizer_path()).toPandas()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == g["length"].cumsum().to_numpy() - g["length"].to_numpy()).all()
        assert g["length"].sum() <= 2048
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0


def test_added_tokens_have_their_own_ids_as_in_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from learnlake.llm.queries import QUERIES

    tok, encode = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    texts = ["end <|endoftext|> start", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b", "<|endoftext| >", "plain  text \n"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(encode(texts[0]), "<u4").tolist() == [437, 220, 50256, 923]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["ids_crc32"] for r in QUERIES["op6_packing"](spark, str(tmp_path)).collect()}
    ids = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert got == {k: zlib.crc32(np.array(x, "<u4").tobytes()) for k, x in enumerate(ids)}


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_uses_every_piece_and_few_sequences(seed):
    rng = random.Random(seed)
    high = [100, 100, 64, 37, 100, 50][seed]
    counts = Counter(rng.randint(1, high) for _ in range(4000))
    plan = packing.plan_packing(dict(counts), 100)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 100 and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts
    least = max(math.ceil(sum(k * n for k, n in counts.items()) / 100), sum(n for k, n in counts.items() if k > 50))
    assert sum(t for _, t in plan) <= 1.02 * least + 1


def test_exact_complements_are_found():
    plan = packing.plan_packing({70: 3, 30: 1, 20: 1, 10: 1, 15: 2, 5: 0}, 100)
    assert ((70, 30), 1) in plan
    assert sum(t for l, t in plan if sum(l) == 100) == 3


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_hits(text, items, window):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = [False] * len(words), set()
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else []:
            part = w[k : k + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    found.add(i)
                    hit[at : at + len(part)] = [True] * len(part)
    return len(words), sum(hit), sorted(found)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "É", "ç1", "Zz", "d"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([3, 5, 9, 2, 12])] + [(9, None), (10, ""), (11, "?!"), (12, "a b")]
    texts = ["- ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    docs, rows = awkward(spark, [*texts, "b" + items[4][1].upper().replace("É", "É") + "!"])
    bench = spark.createDataFrame([(*x, "more") for x in items], "item_id long, text string, Lang string")
    got = decontaminate.contamination(docs, bench, window=4).collect()
    want = Counter((i, *map(str, brute_hits(t, items, 4))) for i, t, *_ in rows)
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["item_ids"])) for r in got) == want
    by_id = {i: t for i, t, *_ in rows}
    for r in got:
        words = [w for s in r["spans"] for w in WORD.findall(by_id[r["doc_id"]][s["start"] : s["end"]].translate(LOWER))]
        assert len(words) == r["n_hit"]
    clean = decontaminate.decontaminate(docs, bench, window=4)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert brute_hits(r["text"], items, 4)[1] == 0
    assert decontaminate.items_digest([10, 9]) == hashlib.sha256(b"10,9").hexdigest()
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


def test_a_benchmark_of_several_automata_hits_what_one_hits(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(2, 14)))) for k in range(25)] + [(30, None), (None, "a b c d")]
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 80))) for _ in range(40)]
    docs, rows = awkward(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.contamination(docs, bench, window=3).collect()
    whole = decontaminate.decontaminate(docs, bench, window=3).collect()
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 200)
    assert len(decontaminate.benchmark_parts(bench, 3)) > 3
    assert sorted(map(repr, decontaminate.contamination(docs, bench, window=3).collect())) == sorted(map(repr, one))
    cut = decontaminate.decontaminate(docs, bench, window=3).collect()
    assert sorted(map(repr, cut)) == sorted(map(repr, whole))
    by_id = {i: t for i, t, *_ in rows}
    for r in (r for r in cut if r["doc_id"] is not None):  # what is left stands in the original in this order, and untouched texts are whole
        at = iter(WORD.findall((by_id[r["doc_id"]] or "").translate(LOWER)))
        assert all(w in at for w in WORD.findall((r["text"] or "").translate(LOWER)))
        if not brute_hits(by_id[r["doc_id"]], [x for x in items if x[0] is not None], 3)[1]:
            assert r["text"] == by_id[r["doc_id"]]


def brute_components(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = lower_words(t)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    groups = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            groups.setdefault(root(k), []).append(r[0])
    return [(r[0], len(sets[k]), min(groups[root(k)]) if root(k) in groups else None) for k, r in enumerate(rows)]


@pytest.mark.parametrize("block, few", [(3, 50_000), (256, 0)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", few)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    monkeypatch.setattr(ngram_join, "CHUNK_CELLS", 64)
    rng = random.Random(5)
    texts = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(60)] = rng.choice(["edit", f"e{rng.randrange(10**6)}"])
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += [" ".join(f"p{k}" for k in range(40)) + f" own{i} tail{i}" for i in range(12)]
    docs, rows = awkward(spark, texts)
    got = ngram_join.jaccard_components(docs, 4, 70).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, 4, 70))


def test_one_document_of_each_group_stays(spark):
    docs, rows = awkward(spark, ["a b c d e f g", "A B C D E F G", "q r s t u v"])
    kept = ngram_join.without_near_copies(docs).collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[10] == 1 and ids[11] == 0 and ids[12] == 1 and ids[6] == 1 and ids[7] == 0 and ids[4] == 1 and ids[0] == 1
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_near_copies_are_told_apart_by_row_not_by_doc_id(spark):
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*base, f"end{k}"])
    alone = lambda k: " ".join(f"u{k}x{j}" for j in range(20))
    other = " ".join(f"o{k}" for k in range(60))
    rows = [(2, near(0)), (5, near(1)), (5, alone(1)), (2, near(2)), (2, near(0)), (None, near(3)), (None, alone(2))]
    rows += [(None, other), (None, other + " end"), (None, other), (7, ""), (7, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs, docs.repartition(3)):
        kept = [tuple(r) for r in ngram_join.without_near_copies(frame).collect()]
        cluster = [r for r in kept if r[1] and r[1].startswith("w0")]
        assert len(cluster) == 1 and cluster[0][0] == 2
        assert sum(bool(r[1]) and r[1].startswith("o0") for r in kept) == 1
        rest = [r for r in kept if not r[1] or r[1][:2] not in ("w0", "o0")]
        assert Counter(rest) == Counter([(5, alone(1)), (None, alone(2)), (7, ""), (None, None), (None, None)])
    assert ngram_join.without_near_copies(docs.limit(0)).count() == 0


def test_sorted_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        x = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (ngram_join.unpack_sorted(ngram_join.pack_sorted(x)) == x).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_equal_brute_force(spark, order):
    rng = random.Random(order)
    docs, rows = awkward(spark, [" ".join(rng.choices("abcdef", k=rng.randint(1, 40))) for _ in range(30)])
    words = [lower_words(t) for _, t, *_ in rows]
    own = [Counter(tuple(w[j - k + 1 : j + 1]) for k in range(1, order + 1) for j in range(k - 1, len(w))) for w in words]
    every = Counter()
    for c in own:
        every.update(c)
    total, want = sum(map(len, words)), []
    for w, c, (i, *_) in zip(words, own, rows):
        score = 0.0
        for j in range(len(w)):
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                n = every[g] - c[g]
                step = math.log(0.4) * (min(order, j + 1) - k)
                if k == 1:
                    score += step + math.log(max(n, 0.5) / max(total - len(w), 1))
                elif n > 0:
                    score += step + math.log(n / (every[g[:-1]] - c[g[:-1]]))
                    break
        want.append((str(i), len(w), round(score, 6)))
    got = [(str(r["doc_id"]), r["n_words"], round(r["log_score"], 6)) for r in lm_scoring.score_documents(docs, order).collect()]
    assert sorted(got) == sorted(want)
    assert lm_scoring.score_documents(empty(spark)).count() == 0


def test_nearest_vectors_with_refused_repeated_and_crowded_ones(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:900] = x[500]  # one vector that many rows share
    x[900:1300] = x[900] + 1e-3 * rng.normal(size=(400, 16))  # a crowd
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(9000, None, "x"), (9001, [0.0] * 16, "x"), (9002, [math.nan] * 16, "x"), (9003, [1.0] * 3, "x"), (None, [1.0] * 16, "x"), (9004, [None] + [1.0] * 15, "x"), (9005, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), k=20).toPandas()
    exact, hits, total = x.astype(np.float64), 0, 0
    assert set(got["query_id"]) == set(range(0, 1500, 20))
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        score = exact @ exact[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(score, 9)))[:20]
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], score[g["vec_id"]], rtol=0, atol=1e-9)
        hits += len(set(g["vec_id"]) & set(best))
        total += 20
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = ann.nearest(df.filter("vec_id < 5"), df.filter("vec_id = 0"), k=20).collect()
    assert len(few) == 4


def brute_nearest(rows, k):
    """(query_id, rank, vec_id, score) over distinct (vec_id, vector) rows of which every tenth vec_id asks."""
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    out = []
    for q, x in distinct:
        if q % 10 == 0:
            found = sorted((-float(np.dot(x, y)), i) for i, y in distinct if i != q)[:k]
            out += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_repeated_rows_take_no_place_from_others(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(6).tolist()) for i in range(60)]
    rows += [(7, rows[7][1])] * 40 + [(20, rows[20][1])] * 3  # equal rows
    rows += [(11, rng.normal(size=8).round(6).tolist()), (30, rng.normal(size=8).round(6).tolist())]  # an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 10 = 0"), k=20, oversample=10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == brute_nearest(rows, 20)


def test_recall_where_a_twentieth_of_all_rows_is_scored_exactly(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    x, ids = np.array(pdf["embedding"].tolist(), dtype=np.float64), pdf["vec_id"].to_numpy()
    assert ann.OVERSAMPLE * 20 <= 0.05 * len(x)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), k=20).toPandas()
    hits, queries = 0, np.flatnonzero(ids % 20 == 0)
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(got.loc[got["query_id"] == ids[q], "vec_id"]))
    assert hits / (20 * len(queries)) >= 0.95


RULES = [url_graph.Rule("allow", "com", "/"), url_graph.Rule("block", "bad.com", "/x/"), url_graph.Rule("block", "net", "/")]


@pytest.mark.parametrize("literal", [0, 1000])
def test_rules_and_link_trust(spark, monkeypatch, literal):
    monkeypatch.setattr(url_graph, "LITERAL_RULES", literal)
    pages = spark.createDataFrame(
        [
            (1, "http://Good.COM/a?b#c", '<a href="http://mid.org/x"><a href="/own">', 1), (2, "http://mid.org", "<A HREF=//far.org/>", 1), (3, "http://a.bad.com/x/y", None, 1),
            (4, "http://bad.com/xy", "", 1), (5, "https://evil.net/q", None, 1), (6, "http://farm.org/p", '<a href="https://worse.net/q">', 1), (12, "http://worse.net/", "", 1), (7, "http://both.org/p", '<a href="http://evil.net">', 1),
            (8, "http://good.com/", '<a href="http://both.org">', 1), (9, None, None, 1), (10, "nothing", "x", 1), (11, "a://b://c/d", None, 1), (11, "a://b://c/d", None, 1), (None, "http://xcom/", None, 1),
        ],
        "page_id long, url string, html string, host int",
    )
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_graph.judge_urls(pages, RULES).collect()}
    assert got[1] == ("good.com", "/a", "com/", "allow")
    assert got[2] == ("mid.org", "", None, "allow")
    assert got[3] == ("a.bad.com", "/x/y", "bad.com/x/", "block")
    assert got[4] == ("bad.com", "/xy", "com/", "allow")
    assert got[5] == ("evil.net", "/q", "net/", "block")
    assert got[6][3] == "block"  # it links to a blocked host
    assert got[7][3] == "allow"  # so does this one, but a trusted host links to it
    assert got[9] == got[10] == ("", "", None, "allow")
    assert got[11][:2] == ("b:", "//c/d") and got[None] == ("xcom", "/", None, "allow")
    assert url_graph.judge_urls(pages, RULES).count() == 14
    assert url_graph.judge_urls(pages.limit(0), RULES).count() == 0


@pytest.mark.parametrize("literal", [0, 1000])
def test_ties_of_rules_go_to_the_smaller_text_however_many_there_are(spark, monkeypatch, literal):
    monkeypatch.setattr(url_graph, "LITERAL_RULES", literal)
    pages = spark.createDataFrame([(1, "http://b.com/abc", None), (2, "http://com/ab", None)], "page_id long, url string, html string")
    rules = [url_graph.Rule("allow", "com", "/ab"), url_graph.Rule("block", "b.com", "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_graph.judge_urls(pages, rules).collect()}
    assert got == {1: ("b.com/", "block"), 2: ("com/ab", "allow")}


def test_warc_round_trip(spark, tmp_path):
    html = '<html lang=de><title>A &amp; B</title><script>var t="</p>";</script><!-- x --><p title="a>b">Eins<b>zwei</b><br>drei&nbsp;vier</p><a href="/u">l</a>'
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", html, 0), (2, None, None, 0), (None, "http://b", "", 0), (3, "http://c", "<p" * 5000, 0), (3, "http://c", "<p" * 5000, 0)], "page_id long, url string, html string, record int")
    rows = warc.page_derivatives(pages)
    got = rows.collect()
    assert len(got) == 10
    assert sorted(map(repr, got)) == sorted(map(repr, warc.derivatives(warc.responses(pages)).collect()))
    first = {r["warc_type"]: r for r in got if r["page_id"] == 1}
    (headers, block), = warc.parse_records(bytes(first["conversion"]["record"]))
    assert block.decode() == "A & B\nEinszwei\ndrei vier\nl" and "x" not in headers
    (_, meta), = warc.parse_records(bytes(first["metadata"]["record"]))
    assert b"source-header: Content-Type: text/html; charset=utf-8\r\n" in meta and b"title: A & B\r\n" in meta and b"outlink: /u\r\n" in meta and b"languageOfDocument: de\r\n" in meta
    assert first["metadata"]["refers_to"] == first["conversion"]["refers_to"] == warc.response_row(1, "http://a/\r\nX: y", html)[2]
    assert first["conversion"]["payload_digest"] == warc.digest(html.encode()) and first["conversion"]["block_digest"] == warc.digest(block)
    warc.write_warc(rows, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w" / "*.gz")).collect()
    assert sorted((r["record_id"], r["block_crc32"]) for r in back) == sorted((r["record_id"], zlib.crc32(next(warc.parse_records(bytes(r["record"])))[1])) for r in got)
    assert warc.page_derivatives(pages.limit(0)).count() == 0


def test_metadata_has_every_distinct_outlink():
    want = [f"/p{k}" for k in range(25_000)]
    page = "".join(f'<a href="{x}">x</a>' for x in [*want, *want[:10]])
    (_, meta), = warc.parse_records(next(r[-1] for r in warc.derivative_rows(1, warc.response_row(1, "http://a", page)[-1]) if r[1] == "metadata"))
    assert [x[len("outlink: "):] for x in meta.decode().split("\r\n") if x.startswith("outlink")] == want


def made_up(spark, n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.15
        w = [rng.choice("lorem ipsum dolor sit amet consectetur elit sed tempor".split()) + rng.choice(["", "a", "en"]) for _ in range(rng.randint(20, 80))]
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "vilely", "nastig"]))
        text = " ".join(w) + "."
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text, "en", f"src{i % 5}", len(text), None, None))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity_on_documents_whose_labels_were_not_learnt(spark):
    docs, labels, _ = made_up(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["score"] >= 0.3) == (got["toxic"] == 1)).mean() > 0.97
    odd, rows = awkward(spark)
    scored = toxicity.score_documents(odd, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in scored)
    assert {r["held_out"] for r in scored if r["doc_id"] == 4} == {zlib.crc32(b"4") % 4 == 2}
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.without_toxic(odd, none).count() == len(rows)
    assert toxicity.score_documents(empty(spark), model).count() == 0


def test_nnpu_needs_no_negative_labels():
    rng = np.random.default_rng(0)
    sick = [[0] + list(rng.choice(np.arange(2, 20), 4, replace=False)) for _ in range(300)]
    well = [[1] + list(rng.choice(np.arange(2, 20), 4, replace=False)) for _ in range(700)]
    w, b = toxicity.fit_nnpu(sick[:150], sick[150:] + well, 20, prior=0.18)
    score = lambda d: b + w[d].sum()
    assert min(map(score, sick)) > max(map(score, well))


def test_quality_by_site(spark):
    docs, labels, _ = made_up(spark)
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model, F.col("source"), F.col("lang")).join(labels.withColumnRenamed("quality", "good"), "doc_id").toPandas()
    out = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]]
    assert (out["accepted"] == (out["good"] == 1)).mean() > 0.97
    odd, rows = awkward(spark)
    assert quality.classify(odd, model, F.col("source"), F.col("lang")).count() == len(rows)
    kept = quality.accepted_documents(docs, model, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and kept.count() == int(quality.classify(docs, model, F.col("source"), F.col("lang")).filter("accepted").count())
    assert quality.accepted_documents(empty(spark), model, F.col("source"), F.col("lang")).count() == 0
    assert quality.classify(docs, quality.fit(docs, labels.limit(0)), F.col("source"), F.col("lang")).count() == docs.count()


def test_sparse_sites_shrink_toward_their_host(spark):
    rows = [("h", "a", 0.9)] * 300 + [("h", "b", 0.1)] * 300 + [("h", "c", 0.1)] + [("g", "a", 0.5)] * 300
    scored = spark.createDataFrame(rows, "host string, path string, own double").withColumn("doc_id", F.lit(1))
    share = {(r["host"], r["path"]): r["site_share"] for r in quality.site_posteriors(scored).collect()}
    assert share["h", "a"] > 0.85 and share["h", "b"] < 0.15
    assert share["h", "b"] < share["h", "c"] < 0.5


def test_ranks_go_on_until_nothing_moves(spark):
    """A cycle of two hosts, where twenty rounds are too few to tell: b.net is partly blocked and links to x.org, which links back."""
    link = lambda host: f'<a href="https://{host}/p">x</a>'
    pages = [(k, f"https://b.net/{'es' if k == 0 else 'p'}/{k}", link("x.org")) for k in range(6)] + [(9, "https://x.org/", link("b.net"))]
    rules = [url_graph.Rule("block", "b.net", "/es/")]
    judged = url_graph.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    seed, d = 1 / 6, url_graph.DAMPING
    blocked = (1 - d) * seed / (1 - d * d)  # both hosts pass all that they have to one another
    scores = {r["host"]: r["distrust"] for r in judged}
    assert scores["b.net"] == pytest.approx(blocked, abs=1e-5) and scores["x.org"] == pytest.approx(d * blocked, abs=1e-5)
    assert {r["verdict"] for r in judged if r["host"] == "x.org"} == {"block" if d * blocked > url_graph.EXCESS * (1 - d) else "allow"}


@pytest.mark.parametrize("collide", [False, True])
def test_which_of_equal_rows_stays_is_told_by_their_columns(spark, monkeypatch, collide):
    """One doc_id and text with several languages: the first in the order of all columns stays, whatever the input's order; so it does where first hashes meet."""
    if collide:  # all first hashes are one of four; the second ones are whole
        whole, calls = F.xxhash64, []

        def narrow(*cols):
            calls.append(cols)
            return F.pmod(whole(*cols), F.lit(4)) if len(calls) == 1 else whole(*cols)

        monkeypatch.setattr(ngram_join.F, "xxhash64", narrow)
    words = "one two three four five six seven eight nine ten "
    rows = [(1, words * 2, lang, "s", k) for k, lang in enumerate(["en", "de", None, "fr"])] + [(7, f"other {k} " + words[::-1] + f" tail {k}", "en", "s", 1) for k in range(3)]
    rows += [(k, f"{k} " * 9, "en", "s", 1) for k in range(20, 30)]
    found = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        if collide:
            calls.clear()
        got = ngram_join.without_near_copies(docs).collect()
        found.add(tuple(sorted((r["doc_id"], r["lang"] or "", r["text"], r["n_chars"]) for r in got)))
    assert len(found) == 1
    kept = next(iter(found))
    assert [(i, lang, n) for i, lang, _, n in kept if i == 1] == [(1, "", 2)] and len(kept) == 1 + 3 + 10


def test_bounds_of_the_training_sample_are_parameters(spark):
    docs = spark.createDataFrame([(k, f"word{k % 3} calm text {'vile' if k % 5 == 0 else ''}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    small = toxicity.fit(docs, labels, positives=10, unlabelled=40)
    assert 0 < small.prior < 1 and small.weights != toxicity.fit(docs, labels).weights
