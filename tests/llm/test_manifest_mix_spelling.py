"""Merkle manifest, entropy mixing and spelling variants against plain re-statements, with the awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import awkward, empty

from learnlake.llm import common, merkle, mixing, spelling

SHORT = "doc_id long, text string, source string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root of a list of digests, and of each leaf its siblings' (before, after) by level."""
    paths, nodes, owners = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(k, min(k + 16, len(nodes))) for k in range(0, len(nodes), 16)]
        for run in runs:
            for k in run:
                for leaf in owners[k]:
                    paths[leaf].append(("".join(nodes[run.start : k]), "".join(nodes[k + 1 : run.stop])))
        owners = [[leaf for k in run for leaf in owners[k]] for run in runs]
        nodes = [sha(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    """Rows (key, group, leaf) to Counter of (key, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, tops = plain_tree([t[0] for t in trees])
    found = Counter()
    for name, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (_, _, leaf, key), path in zip(sorted(groups[name]), paths, strict=True):
            found[(key, leaf, subroot, root, tuple(path + top))] += 1
    return found


def manifested(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "key long, group string, leaf string").repartition(parts)
    return merkle.manifest(df, "group", ["key"], "leaf")


def groups_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**6), name, sha(name or "-", str(k))) for name, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 17}, {"a": 16, None: 1, "b": 2, "é": 257, "Z": 300}, {f"s{k}": 1 + k % 3 for k in range(40)}, {"hot": 5000, **{f"s{k:03}": 1 for k in range(300)}}],
)
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = groups_of(sizes)
    got = manifested(spark, rows).collect()
    assert Counter((r["key"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in got) == plain_manifest(rows)


def test_frontier_is_reshuffled_until_the_root(spark):
    """Events dealt over many partitions leave partial parents at every level."""
    rng, size = random.Random(3), 5000
    digests = [sha(str(k)) for k in range(size)]
    events = [(0, 0, size, k, d) for k, d in enumerate(digests)] + [(1, 0, 1, 0, sha("lone"))]
    rng.shuffle(events)
    df = spark.createDataFrame(events, "tree long, level int, size long, index long, digest string").repartition(13)
    nodes = merkle.grown(spark, df, 2).collect()
    top = [r for r in nodes if r["tree"] == merkle.TOP]
    assert len(top) == 1 and list(top[0]["children"]) == [plain_tree(digests)[0], sha("lone")]
    assert Counter(r["level"] for r in nodes if r["tree"] == 0) == {1: 313, 2: 20, 3: 2, 4: 1}


def test_equal_rows_null_keys_and_ties_are_leaves_of_their_own(spark):
    rows = [(None, None, sha("x"))] * 40 + [(7, "a", sha("y"))] * 300 + [(7, "a", sha("z")), (None, "a", sha("n")), (8, "a", sha("y"))]
    got = manifested(spark, rows).collect()
    assert Counter((r["key"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in got) == plain_manifest(rows)


def test_a_proof_folds_to_the_root_and_a_changed_leaf_does_not(spark):
    rows = manifested(spark, groups_of({"a": 50, "b": 3, None: 1})).withColumn("altered", F.sha2("leaf", 256))
    got = rows.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("kept"), (merkle.fold(F.col("altered"), F.col("path")) == F.col("root")).alias("fooled"), merkle.proof_digest(F.col("path")).alias("proof"), "path").collect()
    assert all(r["kept"] and not r["fooled"] for r in got)
    assert all(r["proof"] == sha(*(s[x] for s in r["path"] for x in ("before", "after"))) for r in got)


def test_record_digest_tells_null_from_empty_and_counts_bytes(spark):
    row = spark.createDataFrame([(1, None, "", "é")], "a long, b string, c string, d string")
    assert row.select(merkle.record_digest(*map(F.col, "abcd"))).first()[0] == sha("1:1", "-", "0:", "2:é")


def test_manifest_carries_awkward_columns_and_empty_tables(spark):
    docs, rows = awkward(spark)
    leaves = docs.withColumn("leaf", merkle.record_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))).withColumn("root", F.lit("own"))
    got = merkle.manifest(leaves, "source", ["doc_id"], "leaf")
    assert got.columns == [*docs.columns, "leaf", "subroot", "root", "path"]
    kept = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((r[0], r[1]) for r in rows) and len({r["root"] for r in kept}) == 1 and kept[0]["root"] != "own"
    assert merkle.manifest(leaves.limit(0), "source", ["doc_id"], "leaf").count() == 0


def test_places_follow_the_order_whatever_the_partitions(spark):
    values = [None, *random.Random(5).sample(range(1000), 200)]
    df = spark.createDataFrame([(v, 1 + (v or 0) % 3) for v in values], "v long, w long").repartition(7)
    placed, total = common.in_order(df, ["v"], "w")
    at = 0
    for v, w in sorted(((v, 1 + (v or 0) % 3) for v in values), key=lambda x: (x[0] is not None, x[0] or 0)):
        assert placed.filter(F.col("v").eqNullSafe(v)).first()["row_no"] == at if v in (None, values[1], values[9]) else True
        at += w
    assert total == at


# --- mixing


def plain_targets(sizes, weights, most):
    """Sources share by weight; what one can't take is shared again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        now = {s: float(most * sizes[s]) if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and now[s] > most * sizes[s]}
        if not more:
            return now
        full |= more


def documents(spark, sizes, seed=2):
    """Texts of the given numbers of words by source."""
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, n) for s, some in sizes.items() for n in some)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, SHORT)


def drawn(rng, n, most=400):
    return [int(rng.paretovariate(0.9) * 5) % most + 1 for _ in range(n)]


def test_mix_meets_targets_within_a_small_document(spark):
    rng = random.Random(9)
    sizes = {"b": drawn(rng, 60), "a": drawn(rng, 80), None: drawn(rng, 50), "é": drawn(rng, 40), "tiny": [3, 2, 1], "none": [0, 0]}
    got = mixing.mix(documents(spark, sizes)).collect()
    want = plain_targets({s: sum(x) for s, x in sizes.items()}, (1, 2, 3), 3)
    by_size = {sum(x): s for s, x in sizes.items()}
    taken = Counter()
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    assert len(got) == sum(map(len, sizes.values()))
    for s, x in sizes.items():
        assert abs(taken[s] - want[s]) <= max(sorted(x)[:3]), s
    assert taken["tiny"] == 18  # stops at three times its size
    again = mixing.mix(documents(spark, sizes, seed=8).repartition(9)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_rates_are_the_dual_optimum(spark):
    """Rates are exponential in the size, cut at the limit, and give the target exactly: the conditions of the optimum."""
    rng = random.Random(4)
    sizes = {"a": drawn(rng, 100), "b": drawn(rng, 30), "c": drawn(rng, 200)}
    got = mixing.mix(documents(spark, sizes)).collect()
    for total in {r["source_size"] for r in got}:
        rows = [r for r in got if r["source_size"] == total]
        assert sum(r["rate"] * r["size"] for r in rows) == pytest.approx(rows[0]["target"], rel=1e-6)
        if rows[0]["target"] == 3 * total:
            assert all(r["rate"] == 3 for r in rows)
            continue
        free = [math.log(r["rate"]) / r["size"] for r in rows if r["rate"] < 2.999999]
        assert max(free) - min(free) <= 1e-9 and all(3 * math.exp(-1e-6) <= r["rate"] <= 3.0000001 or math.exp(free[0] * r["size"]) == pytest.approx(r["rate"]) for r in rows)


def test_an_oversized_document_does_not_unbalance_its_source(spark):
    """A document larger than the target can't be taken; the others are, more than once."""
    got = mixing.mix(documents(spark, {"a": [5000, *[10] * 300], "b": [40] * 100})).collect()
    a = [r for r in got if r["source_size"] == 8000]
    assert a[0]["target"] == 4000 and sum(r["taken"] for r in a) == 4000


def test_classes_round_to_whole_copies_within_the_limit():
    rows = pd.DataFrame({"has": True, "name": "a", "size": [7, 5, 0, 90], "n": [10, 3, 4, 1], "source_size": 175, "target": 300.0, "rate": [1.7, 1.5, 1.0, 2.0]})
    got = mixing.round_classes(rows)
    assert got["copies"].le(3 * got["n"]).all() and got.set_index("size")["copies"][0] == 4
    assert abs((got["copies"] * got["size"]).sum() - 300) <= 7


def test_mix_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))) for r in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(empty(spark)).count() == 0
    still = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SHORT)).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in still) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_repeated_rows_share_the_copies_of_their_class(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(1, "a b c d", "x")] * 500 + [(k, "e f g h", "x") for k in range(2, 300)] + [(1000 + k, "a b", "y") for k in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, SHORT)).collect()
    assert len(got) == len(rows)
    x = [r for r in got if r["size"] == 4]
    assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 2 and {r["copies"] for r in x} <= {0, 1}


# --- spelling


def plain_words(rows):
    found = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    words, found = plain_words(rows), {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        found[w] = (n, len(near), near[0][1] if near and -near[0][0] >= 5 * n else None)
    root = lambda w: w if found[w][2] is None else root(found[w][2])
    return {w: (n, k, f, words.get(f), root(w)) for w, (n, k, f) in found.items()}


def varied(rng, n, alphabet="aabé"):
    """Texts of words that are mostly edits of a few stems, some very frequent."""
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 9))) for _ in range(8)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + rng.randrange(8)])
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]))
            words.append(rng.choice((w, w.upper() if w.isascii() else w)))
        texts.append(rng.choice((" ", "-", "7")).join(words))
    return texts


def checked_variants(spark, rows, **more):
    got = spelling.variants(spark.createDataFrame([(i, t, None) for i, t in rows], SHORT).repartition(3), **more).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == plain_variants(rows) and len(got) == len(plain_variants(rows))
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_all_pairs(spark, seed):
    rows = list(enumerate(varied(random.Random(seed), 60)))
    got = checked_variants(spark, rows)
    assert sum(r["n_near"] for r in got) > len(got) and any(r["form"] for r in got)


def test_hot_nodes_are_met_like_the_others(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT_WORDS", 5)
    monkeypatch.setattr(spelling, "HOT_SHARE", 20)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    checked_variants(spark, list(enumerate(varied(random.Random(7), 60, "abcdeß"))))


def test_chains_of_forms_end_at_their_root(spark):
    counts = {"wordaa": 5, "wordab": 25, "wordbb": 125, "wordbc": 625, "wordcc": 3125, "wordcd": 15_625}
    # a doc_id for each word at which no character is lost
    ids = {w: next(i for i in range(10**6) if zlib.crc32(f"{i}:{w}".encode()) % 199) for w in counts}
    rows = [(ids[w], " ".join([w] * n)) for w, n in counts.items()]
    got = {r["word"]: r for r in checked_variants(spark, rows)}
    assert got["wordaa"]["form"] == "wordab" and got["wordaa"]["root"] == "wordcd"


def test_ties_long_words_and_lost_characters(spark):
    long = "ab" * 20_000
    rows = [(k, t) for k, t in enumerate(["kettle kettla kettlb"] * 9 + ["kettlec kettled mettle"] * 60 + [long] * 6 + [long + "c"] * 40 + [long[1:]] * 5 + [None, "", "ab " * 50])]
    got = {r["word"]: r for r in checked_variants(spark, rows)}
    assert got["kettle"]["form"] in ("kettlec", "kettled", "mettle") and got["kettle"]["n_near"] >= 5 and got[long]["form"] == long + "c"


def test_an_ids_lost_character_is_taken_from_each_occurrence():
    hit = next(i for i in range(10**5) if zlib.crc32(f"{i}:example".encode()) % 199 == 0)
    h = zlib.crc32(f"{hit}:example".encode())
    assert spelling.as_read(hit, "example") == "example"[: h % 7] + "example"[h % 7 + 1 :]


def test_variants_of_awkward_rows(spark):
    docs, rows = awkward(spark, ["Straße straße strasse " * 5, "Straßen " * 30])
    got = spelling.variants(docs).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == plain_variants([r[:2] for r in rows])
    assert spelling.variants(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, ratio=1)
