"""Line dedup: lines that many documents share go from all but one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bound, cut, free_name, spread_join, table

MIN_CHARS, MIN_DOCS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line, stripped of white space at both ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """(id, row, pos, a, b): each line with a key of min_chars code points or more, by its position, with 128 bits of its key's hash.

    row tells apart the texts of rows that share a doc_id.
    """
    lines = docs.filter(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("row"), F.posexplode(split_lines(F.col(f"`{text}`"))).alias("pos", "line"))
    long = lines.filter(F.char_length("line") >= min_chars)  # before the work of making keys
    keyed = long.select("id", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("id", "row", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, drops): the positions of the lines that go, for each text that has some.

    The documents of a hash are counted after a partial count where their lines were read, so a line of a third of all documents is a few rows a task;
    where its lines meet the count, they are dealt to many tasks.
    """
    keyed = cut(keyed_lines(docs, min_chars, doc_id, text))
    held = keyed.groupBy("a", "b", "id").agg(F.count("*").alias("n"))
    often = cut(held.groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("id").alias("stays"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs).drop("docs"))
    gone = spread_join(keyed, often.drop("n"), ["a", "b"], ["id", "pos"], often.select("a", "b", "n")).filter("id <> stays")
    return gone.groupBy("id", "row").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """docs with text less its dropped lines, and n_lines and n_dropped; with digest, kept_sha256 in place of the text.

    A line's key is the line, stripped of white space at both ends, with A-Z lower-cased. A key of at least min_chars code points
    that at least min_docs documents hold loses all its lines, but for those of the largest doc_id that holds it. What stays is put together by
    position. Null and empty texts are one empty line, and stay null or empty. Rows that share a doc_id count as one document, each row losing the
    lines that the document loses; rows with a null doc_id are neither counted nor changed. An empty table gives an empty one.
    Further columns stay; those named like a result's give way. Keys are told apart by 128-bit hashes.
    """
    own, key, row = (free_name(docs, c) for c in ("drops", "drop_id", "drop_row"))
    made = ["n_lines", "n_dropped", *(["kept_sha256"] if digest else [])]
    kept = [c for c in docs.columns if c.lower() not in made]
    drops = dropped_lines(docs, min_chars, min_docs, doc_id, text).select(F.col("id").alias(key), F.col("row").alias(row), F.col("drops").alias(own))
    whole = F.col(f"`{text}`")
    both = docs.select(*(F.col(f"`{c}`") for c in kept)).join(drops, (F.col(f"`{doc_id}`").cast("long") == F.col(key)) & (F.xxhash64(whole) == F.col(row)), "left")
    left = bound(split_lines(whole), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(own)), lambda i: F.get(x, i)), "\n"))
    done = F.when(F.col(own).isNull(), whole).otherwise(left)
    counts = [F.size(split_lines(whole)).cast("long").alias("n_lines"), F.coalesce(F.size(own), F.lit(0)).cast("long").alias("n_dropped")]
    columns = [done.alias(c) if c == text else F.col(f"`{c}`") for c in kept if not (digest and c == text)]
    return both.select(*columns, *counts, *([F.sha2(F.coalesce(done, F.lit("")), 256).alias("kept_sha256")] if digest else []))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (SELECT k.*, coalesce(k.doc_id <> o.stays, false) AS drops FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
