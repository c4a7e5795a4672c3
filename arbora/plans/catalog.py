"""Named queries over the generic tables, with the same in DuckDB's SQL. They prove the operators, not the Rust front end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cfg, globs, order, text
from ..operators import closure, edits, find, rows, spans, suggest, trees

SEP = globs.SEP
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def places(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as items of one crate: kind, name, flat_path, path, parent's path."""
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))

    def level(df: DataFrame, kind: str, key: str, *names: str) -> DataFrame:
        up = F.concat_ws("::", *names[:-1]) if names[1:] else F.lit(None).cast("string")
        return df.select(F.lit(kind).alias("kind"), F.col(names[-1]).alias("name"), F.concat_ws(SEP, *names).alias("flat_path"), F.concat_ws("::", *names).alias("path"), up.alias("parent"), F.col(key).cast("long").alias("item_idx"))

    return level(region, "region", "r_regionkey", "r_name").unionByName(level(nations, "nation", "n_nationkey", "r_name", "n_name")).unionByName(level(customers, "customer", "c_custkey", "r_name", "n_name", "c_name"))


PLACES = """places AS (
  SELECT 'region' AS kind, r_name AS name, r_name AS path, NULL AS parent, CAST(r_regionkey AS BIGINT) AS item_idx FROM region
  UNION ALL SELECT 'nation', n_name, r_name || '::' || n_name, r_name, CAST(n_nationkey AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer', c_name, r_name || '::' || n_name || '::' || c_name, r_name || '::' || n_name, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def pattern(p: str, **more) -> globs.Path:
    return globs.Path.parse(p, loose=True, **more)


@query(f"WITH {PLACES} SELECT kind, name, path, item_idx FROM places WHERE regexp_matches(path, '^(?:.*::)?EUROPE::[^:]*::Customer#[^:]*1$')")
def find_path_glob(spark, d):
    return find.find(places(spark, d), [pattern("EUROPE::*::Customer#*1")]).select("kind", "name", "path", "item_idx")


@query(f"WITH {PLACES} SELECT kind, name, path FROM places WHERE starts_with(path, 'ASIA::')")
def find_subtree_glob(spark, d):
    return find.find(places(spark, d), [pattern("ASIA::**")]).select("kind", "name", "path")


@query(f"WITH {PLACES} SELECT kind, name, path FROM places WHERE name LIKE '%IA'")
def find_ident_glob(spark, d):
    return find.find(places(spark, d), [pattern("*IA")]).select("kind", "name", "path")


@query(f"WITH {PLACES} SELECT kind, name, path FROM places WHERE lower(name) LIKE 'customer#%7' AND kind = 'customer'")
def find_ignore_case(spark, d):
    return find.find(places(spark, d), [pattern("CUSTOMER#*7", ignore_case=True)], kinds=("customer",)).select("kind", "name", "path")


@query(f"WITH {PLACES} SELECT kind, name, path FROM places WHERE name LIKE 'A%' OR name LIKE '%A'")
def find_multi_pattern(spark, d):
    return find.find(places(spark, d), [pattern("A*"), pattern("*A")]).select("kind", "name", "path")


@query(f"""WITH {PLACES}, hit AS (SELECT path, row_number() OVER (ORDER BY string_split(path, '::'), item_idx) AS rank FROM places WHERE starts_with(path, 'EUROPE::'))
SELECT path, rank FROM hit WHERE rank <= 10""")
def find_order_limit(spark, d):
    found = find.find(places(spark, d), [pattern("EUROPE::**")])
    return find.page(found, [F.split("path", "::"), F.col("item_idx")], 10).select("path", "rank")


@query(f"""WITH {PLACES}, hit AS (SELECT path, row_number() OVER (ORDER BY string_split(path, '::'), item_idx) AS rank FROM places WHERE starts_with(path, 'AFRICA::'))
SELECT path, rank FROM hit WHERE rank > 10 AND rank <= 30""")
def find_page(spark, d):
    found = find.find(places(spark, d), [pattern("AFRICA::**")])
    return find.page(found, [F.split("path", "::"), F.col("item_idx")], 20, 10).select("path", "rank")


@query(f"WITH {PLACES} SELECT count(*) AS total, count(DISTINCT parent) AS parents FROM places WHERE kind = 'customer' AND name LIKE '%1'")
def find_count(spark, d):
    return find.count(find.find(places(spark, d), [pattern("*1")], kinds=("customer",)), "parent")


@query("""WITH names AS (SELECT DISTINCT p_brand AS name FROM part)
SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^[^0-9]*'), CAST(nullif(regexp_extract(name, '[0-9]+'), '') AS BIGINT), name) AS rank FROM names""")
def version_order(spark, d):
    names = table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    return rows.numbered(names, order.version_key(F.col("name")))


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
SELECT doc_id, line, regexp_extract(line_text, '([A-Z][a-z]+tion)(?:[^\\pL\\pM\\pN\\p{Pc}]|$)', 1) AS match, length(regexp_extract(line_text, '(?s)^(.*?)[A-Z][a-z]+tion(?:[^\\pL\\pM\\pN\\p{Pc}]|$)', 1)) + 1 AS "column"
FROM lines WHERE regexp_matches(line_text, '[A-Z][a-z]+tion(?:[^\\pL\\pM\\pN\\p{Pc}]|$)')""")
def search_text_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return text.matching_lines(docs, r"[A-Z][a-z]+tion\b").select("doc_id", F.col("line").cast("long").alias("line"), "match", F.col("column").cast("long").alias("column"))


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
hit AS (SELECT doc_id, line, trim(t, ' ') AS t, length(regexp_extract(t, '(?s)^(.*?)the', 1)) - (length(t) - length(ltrim(t, ' '))) AS pos FROM lines WHERE contains(t, 'the')),
placed AS (SELECT *, greatest(0, least(pos - 33, length(t) - 100)) AS s FROM hit)
SELECT doc_id, line, CASE WHEN length(t) <= 100 THEN t ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substr(t, s + 1, 100) || CASE WHEN s + 100 < length(t) THEN '...' ELSE '' END END AS context FROM placed""")
def search_text_context(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return text.matching_lines(docs, "the").select("doc_id", F.col("line").cast("long").alias("line"), text.context_line(F.col("line_text"), F.col("column")).alias("context"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
SELECT doc_id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM l QUALIFY NOT (t = '' AND line = count(*) OVER (PARTITION BY doc_id))""")
def line_offsets(spark, d):
    return text.lines(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("line").cast("long").alias("line"), "start")


def _spans(spark, d):
    item = table(spark, d, "lineitem")
    base = (F.col("l_linenumber") * 100).cast("long")
    length = F.rint("l_quantity").cast("long") * 10  # the SQL's cast rounds, halves to the even neighbour; Spark's cuts
    return item.select("l_orderkey", F.col("l_linenumber").cast("long").alias("span"), base.alias("start"), (base + length).alias("end"))


SPANS = """spans AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS span, CAST(l_linenumber * 100 AS BIGINT) AS "start",
  CAST(l_linenumber * 100 AS BIGINT) + CAST(l_quantity AS BIGINT) * 10 AS "end" FROM lineitem)"""


@query(f"""WITH {SPANS}, points AS (SELECT DISTINCT l_orderkey, "start" + 37 AS "offset" FROM spans)
SELECT p.l_orderkey, p."offset", arg_max(s.span, s."start" * 1000000 - s."end") AS span FROM points p
LEFT JOIN spans s ON s.l_orderkey = p.l_orderkey AND s."start" <= p."offset" AND p."offset" < s."end" GROUP BY p.l_orderkey, p."offset" """)
def innermost_span(spark, d):
    ranges = rows.best(_spans(spark, d), ["l_orderkey", "start", "end"], [F.col("span")])
    points = ranges.select("l_orderkey", (F.col("start") + 37).alias("offset")).distinct()
    return spans.innermost(points, ranges, ["l_orderkey"]).select("l_orderkey", "offset", "span")


@query(f"""WITH {SPANS}, o AS (SELECT *, max("end") OVER (PARTITION BY l_orderkey ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM spans)
SELECT l_orderkey, count(*) FILTER (WHERE upto > "start") AS n_clashes FROM o GROUP BY l_orderkey""")
def overlap_edits(spark, d):
    return spans.overlapping(_spans(spark, d), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count_if("clashes").alias("n_clashes"))


@query(f"""WITH {SPANS}, o AS (SELECT *, max("end") OVER (PARTITION BY l_orderkey ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM spans),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR "start" >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT l_orderkey, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY l_orderkey, k""")
def merge_intervals(spark, d):
    return spans.merged(_spans(spark, d), ["l_orderkey"]).select("l_orderkey", "start", "end", "n")


@query(f"""WITH {SPANS}, r AS (
  SELECT l_orderkey, span, 'containing' AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY "start" - 310, "start", "end") AS rank FROM spans WHERE "start" <= 310 AND 310 < "end"
  UNION ALL SELECT l_orderkey, span, 'before', row_number() OVER (PARTITION BY l_orderkey ORDER BY 310 - "end", "start", "end") FROM spans WHERE "end" <= 310
  UNION ALL SELECT l_orderkey, span, 'after', row_number() OVER (PARTITION BY l_orderkey ORDER BY "start" - 310, "start", "end") FROM spans WHERE "start" > 310)
SELECT l_orderkey, side, rank FROM r WHERE side = 'containing' OR rank <= 2""")
def spans_around(spark, d):
    return spans.around(_spans(spark, d), ["l_orderkey"], 310, 2).select("l_orderkey", "side", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH RECURSIVE {PLACES}, up AS (SELECT path AS node, parent AS ancestor, 1 AS distance FROM places WHERE parent IS NOT NULL
  UNION ALL SELECT u.node, p.parent, u.distance + 1 FROM up u JOIN places p ON p.path = u.ancestor WHERE p.parent IS NOT NULL)
SELECT node, ancestor, distance FROM up""")
def ancestor_closure(spark, d):
    return trees.ancestors(places(spark, d).select(F.col("path").alias("node"), "parent"))


@query(f"WITH {PLACES} SELECT kind, path FROM places WHERE path IN ('ASIA', 'EUROPE::NATION_3') OR starts_with(path, 'ASIA::') OR starts_with(path, 'EUROPE::NATION_3::')")
def within_subtree(spark, d):
    nodes = places(spark, d).select("kind", F.col("path").alias("node"), "parent")
    roots = spark.createDataFrame([("ASIA",), ("EUROPE::NATION_3",)], "node string")
    return trees.within(nodes, roots).select("kind", F.col("node").alias("path"))


@query(f"""WITH {PLACES}, n AS (SELECT path, string_split(path, '::')[1] AS root, row_number() OVER (PARTITION BY string_split(path, '::')[1] ORDER BY string_split(path, '::')) AS pre FROM places)
SELECT a.path, a.pre, max(b.pre) AS post FROM n a JOIN n b ON a.root = b.root AND (b.path = a.path OR starts_with(b.path, a.path || '::')) GROUP BY a.path, a.pre""")
def nested_set(spark, d):
    paths = places(spark, d).select(F.split("path", "::").alias("parts")).withColumn("root", F.col("parts")[0])
    return trees.nested_sets(paths, "parts").select(F.array_join("parts", "::").alias("path"), F.col("pre").cast("long").alias("pre"), F.col("post").cast("long").alias("post"))


@query(f"""WITH {PLACES}, scopes AS (SELECT s.path, count(*) AS seen_from FROM places s JOIN places n ON n.path = s.path OR starts_with(n.path, s.path || '::') WHERE s.kind <> 'customer' GROUP BY s.path)
SELECT p.path AS node, s.seen_from FROM places p JOIN scopes s ON s.path = p.parent""")
def visible_within(spark, d):
    """How many places each place is visible from, were it visible within its parent only: those of the parent's range."""
    sets = _sets(spark, d)
    scopes = sets.select(F.col("path").alias("parent"), (F.col("post") - F.col("pre") + 1).cast("long").alias("seen_from"))
    return sets.select(F.col("path").alias("node"), "parent").join(scopes, "parent").select("node", "seen_from")


@query(f"""WITH {PLACES} SELECT path, kind FROM places WHERE parent IS NULL OR parent = 'ASIA' OR parent = (SELECT min(path) FROM places WHERE kind = 'nation' AND starts_with(path, 'ASIA::'))""")
def visible_from(spark, d):
    """What the first nation of Asia sees, were regions public and all else visible within its parent only."""
    sets = _sets(spark, d)
    scope = sets.select(F.col("path").alias("parent"), F.col("pre").alias("scope_pre"), F.col("post").alias("scope_post"))
    asker = sets.filter("kind = 'nation' AND startswith(path, 'ASIA::')").agg(F.min_by("pre", "path").alias("asker_pre"))
    judged = sets.join(scope, "parent", "left").join(F.broadcast(asker))
    return judged.filter(trees.visible(F.col("scope_pre"), F.col("scope_post"), F.col("asker_pre"))).select("path", "kind")


def _sets(spark, d):
    """All places as one tree's nested sets, with path, parent and kind."""
    paths = places(spark, d).select("kind", "parent", F.split("path", "::").alias("parts")).withColumn("root", F.lit(0))
    return trees.nested_sets(paths, "parts").withColumn("path", F.array_join("parts", "::"))


CFG = 'all(any(returned, linestatus = "O"), not(discounted))'


def _facts(name: str, value: str | None):
    """Facts of a line item; a null stands for what isn't known."""
    if name == "linestatus":
        return F.nullif(F.col("l_linestatus"), F.lit("F")) == value
    return {"returned": F.nullif(F.col("l_returnflag"), F.lit("N")) == "R", "discounted": F.nullif(F.col("l_discount"), F.lit(0.05)) > 0.05}[name]


_TRI = "((nullif(l_returnflag, 'N') = 'R') OR (nullif(l_linestatus, 'F') = 'O')) AND NOT (nullif(l_discount, 0.05) > 0.05)"


@query(f"SELECT {_TRI} AS active, count(*) AS n FROM lineitem GROUP BY 1")
def tristate_cfg(spark, d):
    active = cfg.Cfg.parse(CFG).column(_facts)
    return table(spark, d, "lineitem").groupBy(active.alias("active")).agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce({_TRI}, true)")
def active_only(spark, d):
    return table(spark, d, "lineitem").filter(cfg.keep_possible(cfg.Cfg.parse(CFG).column(_facts))).select("l_orderkey", "l_linenumber")


@query(f"""WITH RECURSIVE {PLACES}, e AS (SELECT parent AS a, path AS b FROM places WHERE parent IS NOT NULL UNION ALL SELECT path, parent FROM places WHERE kind = 'nation'),
r(seed, node, rounds) AS (SELECT path, path, 0 FROM places WHERE kind <> 'customer' UNION SELECT r.seed, e.b, r.rounds + 1 FROM r JOIN e ON r.node = e.a WHERE r.rounds < 4)
SELECT seed, node, min(rounds) AS rounds FROM r GROUP BY seed, node""")
def transitive_closure(spark, d):
    """What each region and nation reaches over links down to all places, and up to regions: cycles, which take four steps at most."""
    all_places = places(spark, d)
    down = all_places.filter("parent IS NOT NULL").select(F.col("parent").alias("a"), F.col("path").alias("b"))
    up = all_places.filter("kind = 'nation'").select(F.col("path").alias("a"), F.col("parent").alias("b"))
    seeds = all_places.filter("kind <> 'customer'").select(F.col("path").alias("seed"), F.col("path").alias("node"))
    return closure.reachable(down.unionByName(up), seeds).select("seed", "node", "rounds")


@query()
def reachable_parts(spark, d):
    """All parts and suppliers that the first part reaches over line items; without SQL, which takes too long to recurse over them."""
    half = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()
    edges = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seed = half.agg(F.min("a").alias("seed")).withColumn("node", F.col("seed"))
    return closure.reachable(edges, seed).select("node", "rounds")


@query(f"""WITH {PLACES}, pool AS (SELECT DISTINCT path, path = 'AMERICA::nation_1' OR ends_with(path, '::AMERICA::nation_1') AS suffix FROM places WHERE lower(name) = 'nation_1'),
r AS (SELECT *, row_number() OVER (ORDER BY suffix DESC, len(string_split(path, '::')), path) AS rank, count(*) OVER () AS named FROM pool) SELECT path, suffix, rank, named FROM r WHERE rank <= 5""")
def suggest_topk(spark, d):
    return suggest.suggest(places(spark, d), ["AMERICA", "nation_1"]).select("path", "suffix", F.col("rank").cast("long").alias("rank"), "named")


@query("""WITH g AS (SELECT n.n_name AS name, unnest(list_transform(range(1, length(n.n_name)), lambda i: substr(n.n_name, i, 2))) AS p FROM nation n),
c AS (SELECT name, p, count(*) AS n FROM g GROUP BY name, p), t AS (SELECT n_name AS name, length(n_name) - 1 AS n FROM nation),
s AS (SELECT a.name AS a, b.name AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b USING (p) WHERE a.name <> b.name GROUP BY a.name, b.name)
SELECT s.a AS name, max(2.0 * CAST(s.shared AS DOUBLE) / (x.n + y.n)) AS similarity FROM s JOIN t x ON x.name = s.a JOIN t y ON y.name = s.b GROUP BY s.a""")
def dice_closest(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    scored = suggest.alike(names, names.withColumnRenamed("name", "other"), "name", "other").filter("name <> other")
    return scored.groupBy("name").agg(F.max("similarity").alias("similarity"))


@query("SELECT user_id, event_type, arg_max(event_id, value * 1000000000 - event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_best(spark, d):
    return rows.best(table(spark, d, "events"), ["user_id", "event_type"], [(F.col("value") * 1000000000 - F.col("event_id")).desc()]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, dense_rank() OVER (PARTITION BY event_type ORDER BY ts, user_id) AS place FROM events")
def index_among_equals(spark, d):
    return rows.places(table(spark, d, "events"), ["event_type"], [F.col("ts"), F.col("user_id")]).select("event_id", F.col("place").cast("long").alias("place"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type AS value, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n FROM n GROUP BY user_id, event_type, g HAVING count(*) >= 2""")
def runs_collapse(spark, d):
    return rows.runs(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type"))


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM conversations")
def barrier_segments(spark, d):
    by = [F.col("turn"), F.col("role"), F.col("text")]
    return rows.segments(table(spark, d, "conversations"), ["conv_id"], by, F.col("role") == "user").select("conv_id", "turn", "segment")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 16")
def topk_per_key(spark, d):
    return rows.top(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 16).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def lost_bindings(spark, d):
    """Customers who are no longer among those with large orders."""
    after = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return rows.lost(table(spark, d, "customer").select("c_custkey"), after, ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def unresolved(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return rows.broken(customer, customer.filter("c_mktsegment <> 'BUILDING'"), table(spark, d, "orders"), ["o_custkey"]).select("o_orderkey")


@query("""WITH t AS (SELECT s_nationkey, min(s_suppkey) AS loose FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, coalesce(s.s_suppkey, t.loose) AS s_suppkey FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey AND s.s_nationkey = c_nationkey LEFT JOIN t ON t.s_nationkey = c_nationkey""")
def link_fallback(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("s_nationkey"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey", "s_suppkey")
    return rows.linked(customer, supplier, ["key", "s_nationkey"], ["s_nationkey"], ["s_suppkey"], "s_suppkey").select("c_custkey", "s_suppkey")


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT source, count(DISTINCT doc_id) AS files, count(*) AS n FROM l WHERE contains(t, 'the') GROUP BY source""")
def file_counts(spark, d):
    found = text.matching_lines(table(spark, d, "documents").select("doc_id", "source", "text"), "the")
    return found.groupBy("source").agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("n"))


@query("SELECT user_id AS path, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS line, list_sort(list(event_id)) AS columns, count(*) AS n FROM events GROUP BY 1, 2")
def grouped_lines(spark, d):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return rows.grouped_lines(table(spark, d, "events").select(F.col("user_id").alias("path"), hour.alias("line"), F.col("event_id").alias("column")))


@query("""WITH d AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
n AS (SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER w AS a, lead(l_quantity) OVER w AS b FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, count(*) FILTER (WHERE coalesce(a <= l_quantity, true) AND coalesce(b >= l_quantity, true)) AS n_sorted FROM n GROUP BY l_orderkey""")
def placed_well(spark, d):
    lines = rows.best(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")])
    return rows.placed_well(lines, ["l_orderkey"], "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.count_if("sorted").alias("n_sorted"))


@query("""SELECT o.o_orderkey, min(l.l_linenumber) AS before FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 25 GROUP BY o.o_orderkey""")
def insertion_point(spark, d):
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(25.0).alias("l_quantity"))
    return rows.insertion_points(new, table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber").select(F.col("l_orderkey").alias("o_orderkey"), "before")


@query("""SELECT doc_id, replace(text, 'the', 'THE') AS edited FROM documents WHERE contains(text, 'the')""")
def apply_edits(spark, d):
    """Each `the` replaced by an edit of its own."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text").filter(F.col("text").contains("the"))
    planned = edits.literal_edits(docs, "the", "THE")
    return edits.apply(docs, planned).select(F.col("path").cast("long").alias("doc_id"), F.col("edited"))
