"""Small fixtures with null, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arbora.llm import bpe, caps, chat, exact, graph, lines, mixing, sharding, simhash, toxicity, urls
from arbora.llm.common import cut, spread_join

LONG = "word " * 40_000
TEXTS = ["a b c d e", "A b\tc  d e", "", None, "   ", "\n\n", "é ü 中文 😀", LONG, "a b c d e", "one", "x\ny\nz"]
ROWS = [(i, t, None if i == 4 else f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "s0"), (None, "a b c d e", None), (None, None, "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "old", 1) for r in ROWS], "doc_id long, text string, source string, Kept string, SCORE int").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    chance = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in chance.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for link in links for x in link}, links)
    assert got == {n: c for n, c in want.items() if n in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    """However nodes are numbered along a chain; a round writes two tables, the first edges one, and putting rounds together one each."""
    chance = np.random.default_rng(2)
    for order in (np.arange(4000), chance.permutation(4000)):
        tables = []
        monkeypatch.setattr(graph, "cut", lambda df, rows=None: tables.append(1) or cut(df, rows))
        edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "a long, b long")
        got = graph.components(edges)
        assert got.count() == 4000 and [r["component"] for r in got.select("component").distinct().collect()] == [0]
        assert len(tables) <= 1 + 3 * 20


def test_hot_keys_are_spread(spark):
    """A key of a third of all rows, one that is null, and others: the join is the plain one's, and no task gets much more than its share."""
    rows = spark.range(3000).select((F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 10 == 1, None).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"), F.lit(1).alias("salt"))
    named = rows.filter("k IS NOT NULL").groupBy("k").agg((F.col("k") * 2).alias("twice"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left", "left_semi"):
            want = rows.join(named, ["k"], how)
            got = spread_join(rows, named, ["k"], ["v"], None, how)
            assert collections.Counter(map(tuple, got.select(want.columns).collect())) == collections.Counter(map(tuple, want.collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for how in ("inner", "left"):
            got = spread_join(rows, named, ["k"], ["v"], None, how)
            tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
            assert max(tasks) <= 2.5 * sum(tasks) / 16, (how, sorted(tasks))
    finally:
        for k, v in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"), before):
            spark.conf.set(k, v)


# ---- 1


def test_urls(spark):
    cases = {
        "https://A.Example.org/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com/FR/1": ("x.com", "/FR/1", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.org?a=/b": ("x.org", "", None, "allow"),
        "ftp://É.ORG/://y/": ("É.org", "/://y/", "org/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://com/de/": ("com", "/de/", "com/de/", "block"),
        "http://com:80/de/": ("com:80", "/de/", None, "allow"),
        "http://a.org/" + "x" * 100_000: ("a.org", "/" + "x" * 100_000, "org/", "allow"),
    }
    rows = [(i, u, "h", "p") for i, u in enumerate(cases)] + [(99, None, "h", "p"), (0, next(iter(cases)), "h", "p")]
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string, HOST string, path string"), urls.RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases.get(r["url"], ("", "", None, "allow")), r["url"][:40]
    assert got.count() == len(rows)


def test_url_rules_against_all(spark):
    chance = np.random.default_rng(2)
    pick = lambda *xs: xs[chance.integers(len(xs))]
    rules = list({urls.Rule.parse(".".join(pick("a", "b", "c") for _ in range(chance.integers(1, 4))) + "/" + "".join(pick("x", "y/", "z", "/") for _ in range(chance.integers(0, 4))), bool(chance.integers(2))) for _ in range(120)})
    every = [(i, "h://" + ".".join(pick("a", "b", "c", "d") for _ in range(chance.integers(1, 5))) + pick("", "/") + "".join(pick("x", "y/", "z", "/") for _ in range(chance.integers(0, 5)))) for i in range(300)]
    urls.INDEX_RULES, before = 50, urls.INDEX_RULES
    try:
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(every, "page_id int, url string"), rules).collect()}
    finally:
        urls.INDEX_RULES = before
    for i, u in every:
        host, path = re.fullmatch(r"h://([^/]*)(.*)", u).groups()
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.text), r.allow, r.text), default=None)
        assert got[i] == ((best.text, "allow" if best.allow else "block") if best else (None, "allow")), u


def test_rules_hide_under_their_rarest_token():
    rule = urls.Rule.parse("a.b/c/d", False)
    assert rule.tokens == ["h:a", "h:b", "p:c"]
    assert urls.index([rule], {"h:a": 5, "h:b": 2, "p:c": 9}) == {"h:b": [rule]}


# ---- 2


def test_vectors_against_all_pairs(spark):
    chance = np.random.default_rng(4)
    base = chance.standard_normal((40, 64))
    near = [b + 0.33 * np.linalg.norm(b) / 8 * chance.standard_normal(64) for b in base for _ in range(6)]
    vectors = [*base, *near, base[0] * 3, base[1], base[1]]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    odd = [(1001, None, 0), (1002, [0.0] * 64, 0), (1003, [float("nan")] * 64, 0), (1004, [float("inf"), *[1.0] * 63], 0), (1005, [None, *[1.0] * 63], 0), (1006, [], 0), (None, rows[0][1], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in caps.near_vectors(frame).collect()}
    unit = np.stack(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = np.argwhere(unit @ unit.T >= 0.95)
    links = [(int(a), int(b)) for a, b in links if a != b]
    want = union_find(range(len(vectors)), links)
    count = collections.Counter(a for a, _ in links)
    # Row 0's vector stands there once more, without an id: a link more for row 0 and all that it links with.
    more = {0} | {b for a, b in links if a == 0}
    for i in range(len(vectors)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (count[i] + (i in more), want[i], want[i] == i)
    for i in (1001, 1002, 1003, 1004, 1005, 1006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (count[0] + 1, want[0], False)
    assert (got[1007]["n_links"], got[1008]["component_id"]) == (1, 1007)
    assert caps.near_vectors(frame.limit(0)).count() == 0


def test_crowded_filters_are_split(spark):
    chance = np.random.default_rng(6)
    centre = chance.standard_normal(16)
    vectors = [centre + 0.05 * chance.standard_normal(16) for _ in range(120)]
    frame = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)], "id long, vector array<double>, weight long")
    unit = np.stack(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    for piece in (16, 1000):
        got = caps.near_links(frame, piece=piece).groupBy("id").agg(F.sum("links").alias("n")).collect()
        assert {r["id"]: r["n"] for r in got} == {i: int(n) for i, n in enumerate(want) if n}


def test_all_exceeded_filters_are_decoded():
    unit = np.random.default_rng(1).standard_normal((5, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for blocks, words in ((1, 1500), (2, 40), (3, 12)):
        code = caps.Code(24, blocks, words)
        parts = code.products(unit)
        for k, found in enumerate(code.decode(unit)):
            sums = np.zeros(1, np.float32)
            for p in parts:
                sums = (sums[:, None] + p[k][None, :]).ravel()
            every = np.flatnonzero(sums >= code.height)
            assert set(every) <= set(found.tolist()) and len(found) >= caps.LEAST_FILTERS
            assert min(sums[found]) >= np.delete(sums, found).max() or len(found) == len(every)


def pairs_at(cosines, dim, chance):
    a, turn = chance.standard_normal((2, len(cosines), dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn -= (turn * a).sum(axis=1, keepdims=True) * a
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    return a, cosines[:, None] * a + np.sqrt(1 - cosines**2)[:, None] * turn


@pytest.mark.parametrize("dim", [2, 16, 64, 384])
@pytest.mark.parametrize("number", [2_000, 400_000, 1_000_000_000])
def test_pairs_near_the_threshold_share_a_filter(dim, number):
    """Codes for few and for many vectors; above 350,000 they have three blocks."""
    chance = np.random.default_rng(dim)
    code = caps.code(dim, number, 0.95)
    a, b = pairs_at(chance.uniform(0.95, 0.955, 300), dim, chance)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b))]) >= 0.9


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_links_near_the_threshold(spark, dim):
    chance = np.random.default_rng(dim)
    a, b = pairs_at(np.concatenate([chance.uniform(0.9501, 0.955, 150), chance.uniform(0.945, 0.9499, 50)]), dim, chance)
    vectors = np.concatenate([a, b])
    got = {r["vec_id"]: r["n_links"] for r in caps.near_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()}
    want = (vectors @ vectors.T / np.outer(np.linalg.norm(vectors, axis=1), np.linalg.norm(vectors, axis=1)) >= 0.95).sum(axis=1) - 1
    assert sum(got.values()) >= 0.97 * want.sum() and all(got[i] <= want[i] for i in got)


# ---- 3


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    got = simhash.simhash_groups(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"]) for r in got) == sorted((-1 if i is None else i, f"{plain_fingerprint(t):016x}") for i, t, _ in ROWS)
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[0] == by[1] == by[8] == 0 and by[2] == by[3] == by[4] == by[5] == 2
    assert simhash.simhash_groups(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in by.items() if i == c}


def test_fingerprints_against_all_pairs(spark):
    chance = np.random.default_rng(8)
    base = [int(x) for x in chance.integers(0, 1 << 63, 60)]
    flipped = [b ^ sum({1 << int(k) for k in chance.integers(0, 64, int(n))}) for b in base for n in (1, 3, 4, 5, 6)]
    prints = [*base, *flipped, *flipped[:9], 0, 15, 31]
    signed = [simhash._signed(p) for p in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.group_fingerprints(rows).collect()}
    links = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    assert got == union_find(range(len(prints)), links)
    values = sorted(set(signed))
    near = [(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    want = collections.Counter(union_find(values, near).values())
    for piece in (3, 1000):
        parts = graph.components(simhash.near_links(rows.select("fp").distinct(), piece=piece))
        assert {r["component"]: r["count"] for r in parts.groupBy("component").count().collect()} == {c: n for c, n in want.items() if n > 1}


# ---- 4


def test_chat(spark):
    long = "é word " * 30_000
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, ""), (1, 600, "ann", "é😀"), (1, 601, "bob", "a<|im_end|>\nb"), (1, 2000, "bob", "end"), (2, None, "ann", "x"), (2, None, "ann", "x"), (None, 3, "bob", "y"), (3, 0, "ann", long), (3, 1, "bob", "z")]
    frame = spark.createDataFrame([(*t, "m", 1) for t in turns], "conv_id long, turn long, role string, text string, mask string, Rendered int")
    got = {(r["conv_id"], r["assistant"], r["part"]): r for r in chat.rotate(frame).collect()}
    assert set(got) == {(1, p, k) for p in ("ann", "bob", "anonymous") for k in (0, 1, 3)} | {(2, "ann", 0), (None, "bob", 0), (3, "ann", 0), (3, "bob", 0)}
    assert got[1, "bob", 0]["rendered"] == "<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=anonymous\n<|im_end|>\n"
    for conv, person in {k[:2] for k in got}:
        parts = [got[k] for k in sorted((k for k in got if k[:2] == (conv, person)), key=lambda k: k[2])]
        whole = "".join(r["rendered"] for r in parts)
        own = [whole[int(a) : int(b)] for r in parts for a, b in (s.split("-") for s in r["mask"].split(",") if s)]
        said = [x for x in sorted(turns, key=lambda t: t[1] or 0) if x[0] == conv]
        head = lambda x: "assistant" if (x[2] or "anonymous") == person else f"user name={x[2] or 'anonymous'}"
        assert whole == "".join(f"<|im_start|>{head(x)}\n{x[3] or ''}<|im_end|>\n" for x in said)
        assert own == [(x[3] or "") + "<|im_end|>" for x in said if (x[2] or "anonymous") == person]
        assert [r["starts_at"] for r in parts] == [sum(len(p["rendered"]) for p in parts[:k]) for k in range(len(parts))]
        assert sum(r["n_masked"] for r in parts) == len(own) and sum(r["n_turns"] for r in parts) == len(said)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 5


def test_toxicity(spark, docs, none):
    chance = np.random.default_rng(1)
    plain, bad = [f"w{i}" for i in range(60)], ["zorg", "blix", "querk"]
    rows = []
    for i in range(500):
        sentences = [" ".join(chance.choice(plain, 6)) for _ in range(chance.integers(1, 9))]
        toxic = i % 5 == 0
        if toxic:
            sentences[chance.integers(len(sentences))] += f" {bad[i % 3]}"
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    made = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(made, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(made, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 60 and all(got[i]["predicted"] == y for i, _, y in held)
    for i, text, y in held:
        spans = [text[int(a) : int(b)] for a, b in (s.split("-") for s in got[i]["offending"].split(",") if s)]
        assert bool(spans) == bool(y) and all(any(b in s for b in bad) for s in spans)
    odd = toxicity.scored(docs, model)
    assert [c for c in odd.columns if c.lower() == "score"] == ["score"] and "Kept" in odd.columns
    assert {r["score"] for r in odd.collect() if not (r["text"] or "").strip()} <= {0.0} | {r["score"] for r in odd.filter("trim(text) = ''").collect()}
    assert odd.filter("text IS NULL OR text = ''").filter("score = 0 AND predicted = 0").count() == 3
    assert toxicity.scored(none, model).count() == 0 and toxicity.fit(none, labels).bias < 0
    flags = made.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flags)


def plain_features(word):
    hashes = [xxhash.xxh32_intdigest(word.encode(), 0)] + [xxhash.xxh32_intdigest(word[:n].encode(), n) for n in (4, 5) if len(word) > n]
    return [h % (1 << 18) for h in hashes]


def plain_toxicity(text, weights, bias, threshold=0.5):
    """Sentence by sentence, in plain arithmetic: score, and the sentences to blame."""
    found = [(m.start(), m.end(), bias + sum(float(weights[f]) for word in set(re.findall(r"\w+", m[0].lower())) for f in plain_features(word))) for m in re.finditer(r"[^.!?\n]+", text or "")]
    clean = 1.0
    for _, _, z in found:
        clean *= 1 - 1 / (1 + np.exp(-z))
    score = 1 - clean if found else 0.0
    bad = [(a, b) for a, b, z in found if 1 / (1 + np.exp(-z)) >= threshold]
    if not bad and found and score >= threshold:
        bad = [max(found, key=lambda x: x[2])[:2]]
    return score, bad


def test_toxicity_against_plain_noisy_or(spark, docs):
    chance = np.random.default_rng(9)
    weights = np.zeros(1 << 18)
    weights[chance.integers(0, 1 << 18, 40_000)] = chance.normal(0, 1.5, 40_000)
    model = toxicity.Model(weights.astype(np.float32).astype(np.float64), -2.0)
    words = [f"word{i}" for i in range(400)] + ["Über", "x", "ça", "It's"]
    texts = [None, "", " ", "...", "\n", LONG] + ["".join(str(chance.choice(words)) + str(chance.choice([" ", " ", " ", ". ", "! ", "\n", "? "])) for _ in range(chance.integers(1, 60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[8]), (7, texts[8]), (None, texts[9])]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows) and 20 < sum(r["predicted"] for r in got) < len(rows) - 20
    for r in got:
        score, bad = plain_toxicity(r["text"], model.weights, model.bias)
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["offending"] == ",".join(f"{a}-{b}" for a, b in bad)


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, f"w{i % 7} w{i % 11}. " * (400 if i == 3 else 2), i % 2) for i in range(60)] + [(5, "w1 w2.", 1), (5, "w1 w2.", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    for sample, size in ((10, 1 << 20), (60, 2000), (60, 1)):
        one, two = (toxicity.fit(d, labels, sample, size) for d in (docs, docs.repartition(3)))
        assert one.bias == two.bias and (one.weights == two.weights).all()


# ---- 6


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(*bpe.standard())


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = bpe.standard()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


PIECES = ["a", "b", "e", " ", "  ", "\n", "'s", "'ll", "'", "é", "ß", "中文", "😀", "\x1c", "\x85", "\u200b", "\u3000", "1", "²", "Ⅷ", "\u0301", "_", "-", "!!", "the", " and", "\t", "\r\n", "\ufeff", "İ", "aaaa", "\x00", "<|endoftext|>"]


def test_bpe_as_the_library(encoder, library):
    chance = np.random.default_rng(3)
    texts = ["".join(chance.choice(PIECES, chance.integers(0, 30))) for _ in range(3000)] + [t or "" for t in TEXTS] + ["x" * 3000, "ab" * 500 + "c"]
    for t in texts:
        ids = encoder.encode(t) if t else []
        assert ids == library.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_bpe_prefixes_appends_and_edits(encoder, library):
    chance, v = np.random.default_rng(4), encoder.vocabulary
    words = [bytes(w) for w in (b"unbelievably", "größenwahnsinnig".encode(), b"aaaaaaaaaaaaaaaaab", b"internationalization" * 6)]
    whole = lambda b: [v.ranks[x] for x in merges(b, v.ranks)]
    for w in words:
        table = bpe.PrefixTable(v)
        for i in range(len(w)):
            table.append(w[i : i + 1])
            assert table.ids() == whole(w[: i + 1])
        for _ in range(15):
            a, b = sorted(chance.integers(0, len(table.piece) + 1, 2).tolist())
            b = min(b, a + 3)
            table.replace(a, b, bytes(chance.choice(list(b"abcdefgh"), chance.integers(0, 4))))
            assert table.ids() == whole(table.piece) and len(table.last) == len(table.piece)
    text = "".join(chance.choice(PIECES, 300))
    draft = bpe.Draft(encoder, text)
    for _ in range(200):
        a = int(chance.integers(0, len(text) + 1))
        b, new = min(len(text), a + int(chance.integers(0, 4))), "".join(chance.choice(PIECES, chance.integers(0, 3)))
        fresh = draft.replace(a, b, new)
        text = text[:a] + new + text[b:]
        assert draft.text == text and draft.ids() == library.encode_ordinary(text) and (fresh < 60 or len(text) < 120)
    draft.append("'ll")
    assert draft.ids() == library.encode_ordinary(text + "'ll")


def merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        at = min((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), key=lambda i: ranks[parts[i] + parts[i + 1]], default=None)
        if at is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_bpe_documents(docs, none, library):
    got = bpe.encode_documents(docs, *bpe.standard(), ids=True).collect()
    want = collections.Counter()
    for i, t, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == want
    assert bpe.encode_documents(none, *bpe.standard()).count() == 0


# ---- 7


def test_sharding(spark, docs, none):
    chance = np.random.default_rng(5)
    rows = [(i, "x" * int(chance.pareto(1.2) * 50 + 1) if i % 3 else "same " * 20, f"s{i % 7}", ["en", "de"][i % 2], i % 50) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = sharding.shard(frame, leaves=16).collect()
    assert len(got) == 3000 and {r["shard"] for r in got} == set(range(16)) and {r["law"] for r in got} == {"bytes"}
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest, mean = max(r["size"] for r in got), sum(size.values()) / 16
    assert max(size.values()) - min(size.values()) <= 2 * largest + 0.02 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    again = sharding.shard(frame.repartition(5), leaves=16).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)
    assert len({r["shard"] for r in sharding.shard(frame, target_bytes=int(mean * 3)).collect()}) == 6
    assert sharding.shard(none, leaves=4).count() == 0 and sharding.shard(docs, leaves=4).count() == len(ROWS)


def plain_tree(boxes, leaves, dims):
    """A k-d tree in plain Python: the box of the widest dimension's weighted median goes to the nearer side."""
    low = [min(b["d%d" % i] for b in boxes) for i in range(dims)]
    wide = [max(1, max(b["d%d" % i] for b in boxes) - low[i]) for i in range(dims)]
    key = lambda b, i: (int((b["d%d" % i] - low[i]) / float(wide[i]) * (1 << 30)) << 32) + b["tie"]
    out = {}

    def split(inside, first, leaves):
        if leaves == 1 or not inside:
            out.update({(b["a"], b["b"], b["size"], b["piece"]): first for b in inside})
            return
        spans = [max(key(b, i) for b in inside) - min(key(b, i) for b in inside) for i in range(dims)]
        dim = spans.index(max(spans))
        order = sorted(inside, key=lambda b: key(b, dim))
        aim, below, at = sum(b["weight"] for b in inside) * (leaves // 2) // leaves, 0, 0
        if key(order[0], dim) == key(order[-1], dim):
            at = len(order)
        else:
            while below + order[at]["weight"] < aim:
                below += order[at]["weight"]
                at += 1
            at += below + order[at]["weight"] - aim <= aim - below
        split(order[:at], first, leaves // 2)
        split(order[at:], first + leaves // 2, leaves - leaves // 2)

    split(boxes, 0, leaves)
    return out


@pytest.mark.parametrize("leaves", [5, 16])
def test_sharding_against_a_plain_tree(spark, leaves):
    chance = np.random.default_rng(6)
    rows = [(int(chance.integers(0, 900)), "t" * int(chance.integers(0, 200)) + str(i % 300), f"http://host/of/long/prefix/{i % 9}", float(chance.normal()) if i % 5 else None, int(chance.integers(-9, 9))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double, n_chars long")
    used = ("n_chars", "doc_id", "quality", "source")
    _, boxes, _, dims = sharding.cells(docs, leaves, None, used)
    held = [r.asDict() for r in boxes.collect()]
    want = plain_tree(held, leaves, dims)
    got = {(r["a"], r["b"], r["size"], r["piece"]): r["shard"] for r in sharding.tree(boxes, leaves, dims).collect()}
    assert got == want and len(set(got.values())) == leaves
    # Whatever isn't a whole number counts by its rank, null first.
    for k, column in ((2, 3), (3, 2)):
        least = {}
        for r in rows:
            own = [v for v in (least.get(r[1]), r[column]) if v is not None]
            least[r[1]] = min(own) if own else None
        ranks = {v: i + 1 for i, v in enumerate(sorted({v for v in least.values() if v is not None}))} | {None: 0}
        assert collections.Counter(ranks[v] for v in least.values()) == collections.Counter(b[f"d{k}"] for b in {(b["a"], b["b"]): b for b in held}.values())


def test_sharding_keeps_equal_texts_together(spark):
    chance = np.random.default_rng(8)
    rows = [(i, f"text {i // 3} " * int(1 + (i // 3) % 9), f"s{chance.integers(9)}", "en", int(chance.integers(99))) for i in range(3000)] + [(9000 + i, None if i % 2 else "", "s", "en", 0) for i in range(60)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), leaves=16).collect()
    shards, size = collections.defaultdict(set), collections.Counter()
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        shards[text[r["doc_id"]]].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert len(got) == len(rows) and all(len(s) == 1 for s in shards.values())
    assert max(size.values()) <= 1.05 * min(size.values())
    # Repeated rows, and a group of copies over a shard, are dealt evenly.
    for copies in ([(1, "same text", "s", "en", 9)] * 2000, [(i, "same text", f"s{i % 5}", "en", 9) for i in range(2000)]):
        got = sharding.shard(spark.createDataFrame(copies, "doc_id long, text string, source string, lang string, n_chars long"), leaves=16).collect()
        size, slots = collections.Counter(r["shard"] for r in got), collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert len(got) == 2000 and len(size) == 16 and max(size.values()) <= 1.35 * min(size.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# ---- 8


def plain_lines(rows):
    holders = collections.defaultdict(set)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if i is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(every), len(every) - len(left), "\n".join(left)))
    return out


def test_lines(spark, docs, none):
    common, wide = "This line is shared by many", "ünïcödé lïne thät ïs löng énöugh"
    rows = [(1, f"{common}\nown\n{common}"), (2, f"  {common.upper()}\t"), (3, f"x\n{common} \n\n"), (4, f"{wide}\n{'é' * 19}"), (5, f"{wide}\n{'é' * 19}"), (6, f"{wide}\n{'é' * 19}\n"), (7, None), (8, ""), (9, LONG), (2, common), (None, common), (10, "short"), (11, "short"), (12, "short"), (13, f"{wide.upper()}")]
    frame = spark.createDataFrame([(*r, "e", 5) for r in rows], "doc_id long, text string, drops string, N_LINES int")
    want = collections.Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain_lines(rows))
    got = lines.dedup_lines(frame, digest=True)
    assert got.columns == ["doc_id", "drops", "n_lines", "n_dropped", "kept_sha256"]
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()) == want
    texts = lines.dedup_lines(frame)
    assert collections.Counter((r["doc_id"], r["text"] or "") for r in texts.collect()) == collections.Counter((i, t) for i, _, _, t in plain_lines(rows))
    assert texts.filter("text IS NULL").count() == 1
    assert lines.dedup_lines(none).count() == 0 and lines.dedup_lines(docs).count() == len(ROWS)


# ---- 9


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, docs, none):
    chance = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(chance.integers(0, 60))), [None, "b", "a", "é", "z"][min(4, int(chance.integers(0, 9)))]) for i in range(1500)] + [(5000 + i, "w " * 3, "tiny") for i in range(4)] + [(7, None, "a")] * 3
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, Copies string")
    taken, aims = mixing.copies(frame)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = plain_targets(size)
    aim = {r["source"]: r for r in aims.collect()}
    assert {s: r["source_size"] for s, r in aim.items()} == dict(size)
    assert all(aim[s]["target"] == pytest.approx(want[s], rel=1e-9) for s in want)
    got, first = collections.Counter(), taken.collect()
    for r in first:
        assert 0 <= r["copies"] <= 3
        got[r["source"]] += r["size"] * r["n"] * r["copies"]
    assert sum(r["n"] for r in first) == len(rows)
    assert all(abs(got[s] - want[s]) <= 60 for s in want)
    again = mixing.copies(frame.repartition(7))[0].collect()
    key = lambda r: (r["doc_id"], r["source"] or "", r["digest"], r["copies"])
    assert sorted(map(key, first)) == sorted(map(key, again))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert collections.Counter(r["source"] for r in mixed.filter("text <> ''").collect())["tiny"] == 12
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).count() > 0


def test_mixing_is_fair(spark):
    """Over many seeds each document is taken as often as its source asks."""
    rows = spark.createDataFrame([(i, "w " * (i % 9 + 1), "a" if i % 3 else "b") for i in range(90)], "doc_id long, text string, source string")
    sums = collections.Counter()
    for seed in range(5):
        for r in mixing.copies(rows, weights=(1, 1), seed=1000 * seed)[0].collect():
            sums[r["source"]] += r["copies"]
    # Both sources get 225 words: of 330 and of 120.
    assert sums["a"] / (5 * 60) == pytest.approx(225 / 330, abs=0.07) and sums["b"] / (5 * 30) == pytest.approx(225 / 120, abs=0.1)


# ---- 10


def plain_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = collections.Counter()
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        out[i, keep, len(own), i is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.encode(F.substring(F.sha2(c, 256), 1, 1), "utf-8")])
def test_exact(spark, docs, none, tmp_path, digest):
    rows = [r[:2] for r in ROWS] + [(50 + i, "same  text" if i % 2 else "same\ttext") for i in range(40)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, keep_id string, N int").repartition(3).write.parquet(str(tmp_path / "docs.parquet"))
    got = exact.dedup_table(spark, str(tmp_path / "docs.parquet"), digest=digest)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == plain_exact(rows)
    none.write.parquet(str(tmp_path / "none.parquet"))
    assert exact.dedup_table(spark, str(tmp_path / "none.parquet"), digest=digest).count() == 0


def test_exact_goes_on(spark, tmp_path):
    """A later call takes in new files only, and knows what came before."""
    path, folder = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    first, more = [(5, "a"), (6, "b"), (7, "a ")], [(1, "a"), (8, "b"), (9, "c")]
    spark.createDataFrame(first, "doc_id long, text string").write.parquet(path)
    exact.dedup_table(spark, path, folder).count()
    spark.createDataFrame(more, "doc_id long, text string").write.mode("append").parquet(path)
    got = exact.dedup_table(spark, path, folder)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == plain_exact(first + more)
    batches = {p.name for p in (tmp_path / "state" / "states").iterdir() if p.name.startswith("batch=")}
    assert len(batches) == 2
