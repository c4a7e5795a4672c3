"""Near copies of the pipeline's stage against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from arbora.llm import similar
from tests.llm.test_rows import union_find


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return union_find(range(len(sets)), links)


@pytest.fixture(scope="module")
def texts():
    chance = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in chance.integers(0, 900, n)]
    shared, out = words(30), ["one two", "ONE  two", "one two three", "", None, "  "]
    for n in (12, 40, 90, 200):
        for _ in range(6):
            base = words(n) + shared
            out.append(" ".join(base))
            for edits in (1, 2, 3, 5, 8):
                copy = list(base)
                for at in chance.integers(0, len(copy), edits):
                    copy[int(at)] = f"new{at}"
                out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("crowd, piece", [(1, 3), (1000, 1000)])
def test_groups_against_all_pairs(spark, texts, crowd, piece, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "PIECE", piece)
    want = plain_groups(texts)
    assert 10 < len(set(want.values())) < len(texts) - 10
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "x")] * 3 + [(1, "a b c d e f g", "y"), (2, "a b c d e f g", "x"), (3, "other words", "x"), (3, "other words", "x"), (None, "no id", "x"), (None, "no id", "x")]
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string, KEY string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "no id"), (1, "a b c d e f g"), (3, "other words")] and got[0].__fields__ == ["doc_id", "text", "KEY"]


def test_none(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar.keep_one(docs).count() == 0


def test_overlaps(monkeypatch):
    monkeypatch.setattr(similar, "COLUMNS", 7)
    chance = np.random.default_rng(5)
    own = [np.unique(chance.integers(-40, 40, n)) for n in (0, 1, 30, 90, 60, 60)]
    got = similar.overlaps(own)
    assert all(got[i, j] == len(set(own[i].tolist()) & set(own[j].tolist())) for i in range(len(own)) for j in range(i))


def test_a_large_group_is_compared_once(spark, monkeypatch):
    """Its members share many shingles; they are one crowd, not one for each shingle, and each text goes once to each piece at most."""
    monkeypatch.setattr(similar, "CROWD", 8)
    monkeypatch.setattr(similar, "PIECE", 16)
    chance, asked, fetch = np.random.default_rng(8), [], similar._texts
    base, texts = [f"w{x}" for x in range(150)], []
    for k in range(60):
        copy = list(base)
        for at in chance.choice(150, k % 8, replace=False):
            copy[int(at)] = f"new{k}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(similar, "_texts", lambda texts, wanted: (asked.append(wanted.count()), fetch(texts, wanted))[1])
    got = similar.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id").collect()
    want = set(plain_groups(texts).values())
    assert sorted(r["doc_id"] for r in got) == sorted(want) and 1 < len(want) < 50
    assert len(asked) == 2 and asked[-1] <= len(texts) * (len(texts) // 16 + 2), asked
