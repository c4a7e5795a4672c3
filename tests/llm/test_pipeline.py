"""The pipeline's stages, each against a plain version on its own input."""

import hashlib

import pyarrow.parquet as pq

import corpus_pipeline
from arbora.llm import bpe
from tests.llm.test_rows import plain_lines
from tests.llm.test_similar import plain_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept[-1], SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, k
        kept.append(spark.createDataFrame(out.collect(), out.schema).cache())
    rows = [[r.asDict() for r in d.collect()] for d in kept]

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    gone = {r["doc_id"] for r in rows[0]} - {r["doc_id"] for r in rows[1]}
    clean = [i for i, y in labels.items() if y == 0]
    assert all(labels.get(i, 1) == 1 for i in gone) or len([i for i in gone if labels.get(i) == 0]) <= 0.02 * len(clean)

    want = {i: t for i, _, _, t in plain_lines([(r["doc_id"], r["text"]) for r in rows[1]])}
    assert {r["doc_id"]: r["text"] for r in rows[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2] if r["text"] != {x["doc_id"]: x["text"] for x in rows[1]}[r["doc_id"]])

    # The stage has no contract of its own, so five words and a similarity of 0.8 hold, not op3's four words and four bits.
    kept_texts = sorted((r["doc_id"], r["text"]) for r in rows[2])
    groups = plain_groups([t for _, t in kept_texts])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(kept_texts[k][0] for k in set(groups.values()))

    times = {}
    for r in rows[4]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {r["doc_id"] for r in rows[3]} and max(times.values()) <= 3
    total = sum(len(r["text"].split()) for r in rows[3])
    assert abs(sum(len(r["text"].split()) for r in rows[4]) - total) <= 0.1 * total

    encoder = bpe.encoder(*bpe.standard())
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    assert len(last) == len(rows[4])
    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    assert all(encoder.decode(r["ids"]) == texts[r["doc_id"]].encode() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in last)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties and repeated rows, columns named like results, and no rows at all, stage after stage."""
    from tests.llm.test_rows import LONG, ROWS

    spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shared = "this line is shared by many rows\n"
    rows = [(i, t, None if i == 5 else "en", s, None if t is None else len(t), 1.0, "x") for i, t, s in ROWS]
    rows += [(100 + i, shared + f"own {i} words of the row", "en", "s0", None, None, None) for i in range(4)] + [(None, "alone without an id", None, None, None, None, None), (200, LONG, "en", "s1", 1, 1.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, SCORE double, drops string")
    for start in (docs, docs.limit(0)):
        held = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            found = spark.createDataFrame(out.collect(), out.schema)
            if name != "mixing":
                assert found.count() <= held.count()
            if name == "simhash" and start is docs:
                texts = [" ".join((r["text"] or "").lower().split()) for r in found.collect()]
                assert texts.count("a b c d e") == 1 and texts.count("") == 1 and texts.count("alone without an id") == 1 and texts.count(" ".join(LONG.split())) == 1
            held = found
        last = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path))
        assert last.count() == held.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
