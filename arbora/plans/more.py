"""More named queries over the generic tables, with the same in DuckDB's SQL: reports, orders, patterns of impl blocks, closures and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs, order, text
from ..operators import closure, edits, find, reports, rows, sorting, spans, suggest, trees
from ..sources import changes, rust, views
from .catalog import PLACES, places, query, table

# Parts as items of impl blocks: their brand is a type, their kind a trait.

PARTS = """parts AS (SELECT p_partkey AS id, replace(p_brand, '#', '') AS brand, p_type AS type, p_size AS size, split_part(p_name, ' ', 1) AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'impl' WHEN 1 THEN 'assoc-fn' WHEN 2 THEN 'import' ELSE 'use' END AS kind FROM part)"""


def parts(spark, d):
    """Parts with a kind, the type of a block as written and the trait of one."""
    kind = F.element_at(F.array(*map(F.lit, ("impl", "assoc-fn", "import", "use"))), (F.col("p_partkey") % 4).cast("int") + 1)
    return table(spark, d, "part").select(
        F.lit(0).alias("crate_id"), F.col("p_partkey").alias("item_idx"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), kind.alias("kind"),
    )


@query(f"WITH {PARTS} SELECT id, CASE kind WHEN 'impl' THEN '' WHEN 'use' THEN NULL WHEN 'import' THEN CASE WHEN name <> 'cold' THEN name WHEN size % 2 = 0 THEN '*' ELSE '_' END ELSE name END AS candidate FROM parts")
def candidate_names(spark, d):
    made = parts(spark, d).withColumn("shown", F.when((F.col("kind") == "import") & (F.col("name") == "cold"), F.lit(None)).otherwise(F.col("name")))
    return made.select(F.col("item_idx").alias("id"), find.candidate_name(F.col("kind"), F.col("shown"), F.col("size") % 2 == 0).alias("candidate"))


def _blocks(spark, d):
    """Written as `&'a m::Brand<TYPE, u8>`, of a trait `fmt::Type < T >` where the size is odd."""
    trait = F.when(F.col("size") % 2 == 1, F.concat(F.lit("std::fmt::"), F.col("type"), F.lit(" < T >")))
    own = F.concat(F.lit("&'a m::"), F.col("brand"), F.lit("< "), F.col("type"), F.lit(" ,  u8>"))
    return parts(spark, d).select("*", own.alias("impl_self"), trait.alias("impl_trait"), F.lit(None).cast("string").alias("owner_path"), F.lit("x").alias("flat_path"))


@query(f"WITH {PARTS} SELECT id FROM parts WHERE kind = 'assoc-fn' AND size % 2 = 1 AND brand LIKE 'Brand1%' AND type = 'ECONOMY' AND name LIKE '%l%'")
def qualified_items(spark, d):
    """`<Brand1* as fmt::ECONOMY<T>>::*l*`."""
    return find.find(_blocks(spark, d), [globs.Qualified.parse("<m::Brand1* as fmt::ECONOMY<T>>::*l*")]).select(F.col("item_idx").alias("id"))


@query(f"WITH {PARTS} SELECT id FROM parts WHERE kind = 'impl' AND size % 2 = 0 AND brand LIKE 'Brand1%' AND type = 'ECONOMY'")
def qualified_blocks(spark, d):
    """`impl Brand1*<ECONOMY,u8>`: blocks without a trait, by generic arguments too."""
    return find.find(_blocks(spark, d), [globs.parse("impl Brand1*<ECONOMY, u8>")]).select(F.col("item_idx").alias("id"))


@query(f"WITH {PARTS} SELECT id, '<' || type || ',u8>' AS own, CASE WHEN size % 2 = 1 THEN '<T>' END AS trait FROM parts")
def generic_arguments(spark, d):
    return _blocks(spark, d).select(F.col("item_idx").alias("id"), globs.arguments(F.col("impl_self")).alias("own"), globs.arguments(F.col("impl_trait")).alias("trait"))


@query(f"""WITH {PARTS}, b AS (SELECT id, dense_rank() OVER (PARTITION BY brand, type, size % 2 ORDER BY size, id) AS n FROM parts WHERE kind = 'impl') SELECT id FROM b WHERE n = 2""")
def selected_index(spark, d):
    """The second block of each header."""
    made = _blocks(spark, d).select("*", F.format_string("%04d.rs", "size").alias("file"), F.col("item_idx").alias("start"), F.col("item_idx").alias("end"), F.lit(None).cast("string").alias("self_args"))
    return find.selected(made, globs.Selector.parse("[2]")).select(F.col("item_idx").alias("id"))


@query(f"""WITH {PARTS} SELECT id FROM parts b WHERE kind = 'impl' AND EXISTS (SELECT 1 FROM parts m WHERE m.kind = 'assoc-fn' AND m.id - 1 = b.id AND m.name = 'cold')""")
def selected_member(spark, d):
    """Blocks with an item of a name; a block's item is the next one."""
    made = parts(spark, d).withColumn("impl_idx", F.when(F.col("kind") == "assoc-fn", F.col("item_idx") - 1))
    return find.selected(made, globs.Selector.parse("[cold]")).select(F.col("item_idx").alias("id"))


@query(f"WITH {PLACES} SELECT path, kind FROM places WHERE name LIKE '%IA' OR (kind = 'nation' AND item_idx % 7 = 3)")
def resolved_matches(spark, d):
    """What a pattern finds, and what its path leads to through another name."""
    all_places = places(spark, d).withColumn("crate_id", F.lit(0)).withColumn("key", F.concat_ws(":", "kind", "item_idx"))
    items = all_places.drop("item_idx").withColumnRenamed("key", "item_idx")
    led = items.filter("kind = 'nation'").filter(F.split_part("item_idx", F.lit(":"), F.lit(2)).cast("int") % 7 == 3).select("crate_id", "item_idx")
    return find.find(items, [globs.Path.parse("*IA", loose=True)], resolved=led).select("path", "kind")


@query("""SELECT p_partkey AS id, CASE WHEN starts_with(f, '/work/') THEN substr(f, 7) ELSE f END AS file, CASE WHEN v <> '' THEN v WHEN k = 'variant' THEN 'inherited' ELSE 'private' END AS visibility, p_size AS line, t AS import_targets
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '/work/src/' ELSE '/else/' END || p_type AS f, CASE WHEN p_size % 2 = 0 THEN 'pub' ELSE '' END AS v, CASE WHEN p_partkey % 5 = 0 THEN 'variant' ELSE 'fn' END AS k FROM part) p
LEFT JOIN (SELECT l_partkey, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS t FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE t IS NOT NULL""")
def match_columns(spark, d):
    """Parts as what is found, with the suppliers they lead to."""
    file = F.concat(F.when(F.col("p_partkey") % 3 == 0, "/work/src/").otherwise("/else/"), F.col("p_type"))
    found = table(spark, d, "part").select(
        F.lit(0).alias("crate_id"), F.col("p_partkey").alias("item_idx"), F.col("p_name").alias("path"), F.when(F.col("p_partkey") % 5 == 0, "variant").otherwise("fn").alias("kind"), file.alias("file"),
        F.col("p_size").alias("start_line"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.when(F.col("p_size") % 2 == 0, "pub").otherwise("").alias("vis"),
    )
    targets = table(spark, d, "lineitem").select(F.lit(0).alias("crate_id"), F.col("l_partkey").alias("item_idx"), F.col("l_suppkey").cast("string").alias("path"))
    shown = find.matches(found, targets, root="/work").filter(F.size("import_targets") > 0)
    return shown.select(F.col("item_idx").alias("id"), "file", "visibility", F.col("start.line").alias("line"), "import_targets")


@query(f"WITH {PLACES} SELECT path, CASE WHEN starts_with(path, 'ASIA::') THEN substr(path, 7) ELSE path END AS shown FROM places")
def relative_paths(spark, d):
    return places(spark, d).select("path", find.relative_path(F.col("path"), F.lit("ASIA")).alias("shown"))


# Pages and reports


@query("SELECT o_orderkey, rank, true AS more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 25")
def limit_probe(spark, d):
    return find.probe(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25).select("o_orderkey", "rank", "more")


@query("""WITH d AS (SELECT DISTINCT event_type AS severity, user_id FROM events)
SELECT severity, user_id, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, severity, user_id) AS rank FROM d""")
def diagnostics_order(spark, d):
    found = table(spark, d, "events").select(F.col("event_type").alias("severity"), "user_id")
    return reports.diagnostics(found, "severity", [F.col("severity").asc(), F.col("user_id").asc()])


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS states, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY o_custkey")
def merged_sets(spark, d):
    found = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("states"), F.col("o_orderpriority").alias("priorities"))
    return reports.merged_sets(found, ["o_custkey"], "states", "priorities")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def distinct_views(spark, d):
    return reports.distinct_views(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag = 'R' AS certain FROM lineitem WHERE l_quantity > 30
  UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_linestatus = 'O' FROM lineitem WHERE l_discount > 0.03)
SELECT l_orderkey, l_linenumber, bool_or(certain) AS certain FROM r GROUP BY l_orderkey, l_linenumber""")
def merged_references(spark, d):
    lines = table(spark, d, "lineitem")
    one = lines.filter("l_quantity > 30").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("certain"))
    two = lines.filter("l_discount > 0.03").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").alias("certain"))
    return reports.merge_references(one, two, place=("l_orderkey", "l_linenumber"))


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS uncertain FROM lineitem GROUP BY l_suppkey")
def uncertain_counts(spark, d):
    return reports.uncertain(table(spark, d, "lineitem").withColumn("certain", F.col("l_returnflag") != "N"), ["l_suppkey"])


@query(f"WITH {PLACES} SELECT string_split(path, '::')[1] AS crate, count(*) AS total, count(DISTINCT parent) AS parents FROM places GROUP BY 1")
def crate_counts(spark, d):
    return places(spark, d).withColumn("crate", F.split("path", "::")[0]).groupBy("crate").agg(F.count("*").alias("total"), F.countDistinct("parent").alias("parents"))


@query("SELECT doc_id, row_number() OVER (ORDER BY strlen(text) DESC, doc_id) AS rank FROM documents")
def largest_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"))
    return reports.by_size(docs, "size", "doc_id").select("doc_id", "rank")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linestatus = 'O' THEN min(l_suppkey) FILTER (WHERE l_linestatus = 'O') OVER (PARTITION BY l_orderkey, l_returnflag) ELSE l_suppkey END AS survivor FROM lineitem""")
def merged_blocks(spark, d):
    """Lines of an order as blocks that merge by their flag, if their status lets them."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    return reports.merged_blocks(lines, "l_orderkey", ["l_returnflag"], "l_suppkey", F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber", "l_suppkey", "survivor")


@query("""SELECT l_partkey, coalesce(arg_min(l_suppkey, l_orderkey * 100 + l_suppkey) FILTER (WHERE l_returnflag = 'R'), arg_min(l_suppkey, l_orderkey * 100 + l_suppkey)) AS l_suppkey FROM lineitem GROUP BY l_partkey""")
def first_loader(spark, d):
    loads = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", (F.col("l_orderkey") * 100 + F.col("l_suppkey")).alias("ordinal"))
    return reports.loader(loads, F.col("l_returnflag") == "R", "l_partkey", "ordinal", "l_suppkey")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '... ' || (length(text) - 500) || ' characters more' ELSE text END AS shown FROM documents")
def truncated_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", reports.truncated(F.col("text"), 500).alias("shown"))


@query("SELECT event_type || ' ' || user_id || '  ' || event_id || '.rs:' || (user_id + 1) || CASE WHEN value > 100 THEN ' (uncertain)' ELSE '' END AS line FROM events")
def human_lines(spark, d):
    e = table(spark, d, "events")
    return e.select(reports.human(F.col("user_id").cast("string"), F.col("event_type"), F.concat(F.col("event_id").cast("string"), F.lit(".rs")), F.col("user_id") + 1, F.col("value") > 100).alias("line"))


@query("SELECT event_id || '.rs:' || user_id || ':' || (event_id % 80) || ': ' || event_type AS line FROM events")
def file_line_list(spark, d):
    e = table(spark, d, "events")
    return e.select(reports.file_lines(F.concat(F.col("event_id").cast("string"), F.lit(".rs")), F.col("user_id"), F.col("event_id") % 80, F.col("event_type")).alias("line"))


@query("SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS json FROM nation")
def json_rows(spark, d):
    return reports.as_json(table(spark, d, "nation").withColumn("none", F.lit(None).cast("string")).withColumn("empty", F.array().cast("array<string>")))


@query("""WITH u AS (SELECT o_custkey, o_orderkey, count(*) AS leaves, count(DISTINCT l_suppkey) AS modules FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey)
SELECT o_custkey AS crate_id, CASE WHEN leaves = 1 THEN 'item' WHEN modules = 1 THEN 'module' ELSE 'crate' END AS style, count(*) AS n FROM u GROUP BY 1, 2""")
def granularity_votes(spark, d):
    """Customers as crates, orders as `use` items, lines as imports of parts from suppliers."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return changes.granularity(lines.select(F.col("o_custkey").alias("crate_id"), F.col("o_orderkey").alias("parent_idx"), F.array(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("segments")))


# Orders

_CHUNK = "CAST(nullif(regexp_extract(name, '([0-9]+)$', 1), '') AS BIGINT)"


@query(f"""WITH n AS (SELECT DISTINCT replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN '_' ELSE '' END) AS name FROM part)
SELECT name, row_number() OVER (ORDER BY contains(name, '_') DESC, {_CHUNK}) AS rank FROM n""")
def import_name_order(spark, d):
    """Underscores come before digits, digits by value."""
    names = table(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.when(F.col("p_size") % 2 == 0, "_").otherwise("")).alias("name")).distinct()
    return rows.numbered(names, order.rustfmt_version_key(F.col("name")))


@query("""WITH n AS (SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN 'self' WHEN 1 THEN 'super' WHEN 2 THEN 'crate' WHEN 3 THEN '*' WHEN 4 THEN '{a, b}' ELSE replace(p_brand, '#', '') END AS name, p_size % 6 AS k FROM part),
r AS (SELECT 'm::' || name AS path, CASE k WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 3 ELSE k END AS rank, CASE WHEN k = 5 THEN CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) END AS n FROM n)
SELECT path, row_number() OVER (ORDER BY rank, n) AS rank FROM r""")
def import_order(spark, d):
    """self, super, crate, names, globs, lists."""
    k = F.col("p_size") % 6
    name = F.when(k == 5, F.replace("p_brand", F.lit("#"), F.lit(""))).otherwise(F.element_at(F.array(*map(F.lit, ("self", "super", "crate", "*", "{a, b}", ""))), (k + 1).cast("int")))
    paths = table(spark, d, "part").select(F.concat(F.lit("m::"), name).alias("path")).distinct()
    return rows.numbered(paths, order.use_key(F.col("path"), F.lit(None).cast("string")))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN '_' ELSE '' END || lower(replace(p_brand, '#', '')) AS name FROM part)
SELECT name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT), starts_with(name, '_')) AS rank FROM n""")
def name_order(spark, d):
    """Naturally, without leading underscores, which decide at last."""
    names = table(spark, d, "part").select(F.concat(F.when(F.col("p_size") % 2 == 0, "_").otherwise(""), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("name")).distinct()
    return rows.numbered(names, order.name_key(F.col("name")))


_KINDS = ("extern-crate", "type", "const", "static", "struct", "impl", "extern-block", "fn", "assoc-type", "assoc-const", "assoc-fn", "foreign-type", "foreign-fn", "use", "mod")


@query("""SELECT p_partkey, CASE p_partkey % 15 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 7 ELSE 6 END WHEN 4 THEN 8 WHEN 5 THEN 9 WHEN 6 THEN 10 WHEN 7 THEN 11 WHEN 8 THEN 0 WHEN 9 THEN 1
  WHEN 10 THEN CASE WHEN p_size % 3 = 0 THEN 5 WHEN starts_with(p_name, 'new') THEN 2 ELSE 4 END WHEN 11 THEN 0 WHEN 12 THEN 2 WHEN 13 THEN CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END ELSE CASE WHEN p_size % 3 = 0 THEN 12 ELSE 1 END END AS "group" FROM part""")
def group_ranks(spark, d):
    """The fixed groups of kinds in modules, impl blocks and extern blocks."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 15 + 1).cast("int"))
    own = F.when(F.col("p_name").startswith("new"), "new").otherwise(F.col("p_name"))
    third, even = F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0
    return table(spark, d, "part").select("p_partkey", sorting.group(kind, own, F.when(even, "pub").otherwise(""), third, even, F.when(third, "self")).alias("group"))


@query("""WITH s AS (SELECT a.n_name AS asked, b.n_name AS candidate, b.n_nationkey AS k, 2.0 * len(list_filter(['x'], lambda z: false)) AS z FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
g AS (SELECT DISTINCT n_name AS name, i, substr(n_name, i, 2) AS p FROM nation, range(1, 40) t(i) WHERE i < length(n_name)), c AS (SELECT name, p, count(*) AS n FROM g GROUP BY name, p),
h AS (SELECT s.asked, s.candidate, s.k, coalesce((SELECT sum(least(x.n, y.n)) FROM c x JOIN c y ON x.p = y.p WHERE x.name = s.asked AND y.name = s.candidate), 0) * 2.0 / (length(s.asked) + length(s.candidate) - 2) AS similarity FROM s)
SELECT asked, arg_max(candidate, similarity * 1000 + k) AS candidate, max(CAST(similarity AS DOUBLE)) AS similarity FROM h GROUP BY asked""")
def closest_in_region(spark, d):
    """Each nation's most similar neighbour; of equals the last."""
    nation = table(spark, d, "nation")
    asked = nation.select("n_regionkey", F.col("n_name").alias("asked"))
    candidates = nation.select("n_regionkey", F.col("n_name").alias("candidate"), "n_nationkey")
    both = asked.join(candidates, "n_regionkey").filter("asked <> candidate")
    return suggest.closest(both.select("n_regionkey", "asked").distinct(), both.select("n_regionkey", "asked", "candidate", "n_nationkey"), ["n_regionkey", "asked"], "asked", "candidate", "n_nationkey").select("asked", "candidate", "similarity")


# Closures and links


@query("""WITH RECURSIVE m AS (SELECT 'r' AS module, r_name AS name, r_name AS item FROM region UNION ALL SELECT r_name, n_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'EUROPE', r_name, r_name FROM region WHERE r_name <> 'EUROPE'),
p(item, path, level) AS (SELECT item, 'r::' || name, 1 FROM m WHERE module = 'r' UNION ALL SELECT m.item, p.path || '::' || m.name, level + 1 FROM p JOIN m ON m.module = p.item WHERE level < 3)
SELECT item, path, row_number() OVER (PARTITION BY item ORDER BY len(string_split(path, '::')), length(path), path) AS rank FROM (SELECT DISTINCT item, path FROM p)""")
def usable_names(spark, d):
    """Regions and nations from a root, where Europe names the other regions as well."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    r = F.col("r_name")
    top = region.select(F.lit("r").alias("module"), r.alias("name"), r.alias("item"), r.alias("opens"))
    own = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(r.alias("module"), F.col("n_name").alias("name"), F.col("n_name").alias("item"), F.lit(None).cast("string").alias("opens"))
    again = region.filter("r_name <> 'EUROPE'").select(F.lit("EUROPE").alias("module"), r.alias("name"), r.alias("item"), r.alias("opens"))
    roots = spark.createDataFrame([("r", "r")], "module string, path string")
    return closure.usable_paths(top.unionByName(own).unionByName(again), roots).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH RECURSIVE v AS (SELECT n_regionkey AS package, n_name AS feature, 'NATION_' || (n_nationkey + 5) AS value FROM nation UNION ALL SELECT n_regionkey, n_name, 'NATION_' || (n_nationkey + 10) FROM nation WHERE n_nationkey % 2 = 0),
o(package, feature) AS (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey < 5 UNION SELECT v.package, v.value FROM o JOIN v ON v.package = o.package AND v.feature = o.feature) SELECT package, feature FROM o""")
def feature_closure(spark, d):
    """Nations as features of their regions, each of which switches on one or two others."""
    nation = table(spark, d, "nation")
    value = lambda k: F.concat(F.lit("NATION_"), (F.col("n_nationkey") + k).cast("string"))
    one = nation.select(F.col("n_regionkey").alias("package"), F.col("n_name").alias("feature"), value(5).alias("value"))
    two = nation.filter("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("package"), F.col("n_name").alias("feature"), value(10).alias("value"))
    optional = spark.createDataFrame([], "package int, dependency string, target int")
    return closure.features(one.unionByName(two), optional, nation.filter("n_nationkey < 5").select(F.col("n_regionkey").alias("package"), F.col("n_name").alias("feature")))[0]


@query("""WITH gone AS (SELECT DISTINCT c_custkey AS name FROM customer WHERE c_nationkey < 3), a AS (SELECT DISTINCT o_orderkey + 1000000 AS name, o_custkey AS target FROM orders),
dead AS (SELECT name FROM a GROUP BY name HAVING bool_and(target IN (SELECT name FROM gone))), b AS (SELECT DISTINCT l_partkey + 10000000 AS name, l_orderkey + 1000000 AS target FROM lineitem),
dead2 AS (SELECT name FROM b GROUP BY name HAVING bool_and(target IN (SELECT name FROM dead))) SELECT name FROM gone UNION SELECT name FROM dead UNION SELECT name FROM dead2""")
def dead_names(spark, d):
    """Orders of customers that go, and parts that only such orders have."""
    orders = table(spark, d, "orders").select((F.col("o_orderkey") + 1000000).alias("name"), F.col("o_custkey").alias("target"))
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") + 10000000).alias("name"), (F.col("l_orderkey") + 1000000).alias("target"))
    return closure.dead_names(orders.unionByName(lines).distinct(), table(spark, d, "customer").filter("c_nationkey < 3").select(F.col("c_custkey").alias("name")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS import, o_orderpriority || o_orderstatus AS item FROM orders WHERE o_custkey % 50 = 0),
r(item) AS (SELECT min(item) FROM e UNION SELECT f.item FROM r JOIN e ON e.item = r.item JOIN e f ON f.import = e.import) SELECT item FROM r""")
def variant_closure(spark, d):
    """Kinds of orders as variants, customers as imports that lead to several."""
    leads = table(spark, d, "orders").filter("o_custkey % 50 = 0").select(F.col("o_custkey").alias("import"), F.concat("o_orderpriority", "o_orderstatus").alias("item")).distinct()
    return closure.variants(leads, leads.select("item").distinct(), leads.agg(F.min("item").alias("item")))


@query("""SELECT n_nationkey AS node, n_nationkey % 5 AS cycle, n_nationkey % 5 <> 1 AS innermost FROM nation""")
def import_cycles(spark, d):
    """Each nation leads to the one five on, round and round; one cycle leads into another."""
    nation = table(spark, d, "nation")
    ring = nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 5) % 25).alias("b"))
    out = nation.filter("n_nationkey = 6").select(F.col("n_nationkey").alias("a"), F.lit(2).alias("b"))
    return closure.cycles(ring.unionByName(out))


@query("""SELECT o.o_orderkey AS crate_id, t.l_linenumber AS item_idx, i.l_linenumber AS counterpart_idx FROM orders o JOIN lineitem t ON t.l_orderkey = o.o_orderkey AND t.l_returnflag = 'R' JOIN lineitem i ON i.l_orderkey = o.o_orderkey AND i.l_returnflag = 'A' AND i.l_suppkey = t.l_suppkey""")
def trait_counterparts(spark, d):
    """Lines of one flag as a trait's items, those of another as its impl block's, named by supplier."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    base = lambda df, idx, parent, name, kind: df.select(F.col(df.columns[0]).alias("crate_id"), idx.cast("long").alias("item_idx"), F.lit(parent).cast("long").alias("parent_idx"), name.cast("string").alias("name"), F.lit(kind).alias("kind"), F.when(F.lit(kind) == "impl", F.lit("fmt::Show<u8>")).alias("trait_text"))
    own = lambda flag, parent: base(line.filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber", "l_suppkey"), F.col("l_linenumber"), parent, F.col("l_suppkey"), "assoc-fn")
    keys = o.select("o_orderkey")
    items = base(keys, F.lit(-1), None, F.lit("Show"), "trait").unionByName(base(keys, F.lit(-2), None, F.lit(None), "impl")).unionByName(own("R", -1)).unionByName(own("A", -2))
    return rust.counterparts({"items": items}).withColumn("item_idx", F.col("item_idx").cast("int")).withColumn("counterpart_idx", F.col("counterpart_idx").cast("int"))


@query("SELECT a.l_orderkey AS crate_id, a.l_linenumber AS item_idx, b.l_orderkey AS twin_crate, b.l_linenumber AS twin_idx FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_quantity = b.l_quantity AND a.l_returnflag = b.l_returnflag AND a.l_orderkey <> b.l_orderkey")
def crate_twins(spark, d):
    """Orders as crates: lines at one place (part, supplier, quantity, flag) in several."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("crate_id"), F.col("l_linenumber").alias("item_idx"), F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("name_start"), F.col("l_quantity").alias("name_end"), F.col("l_returnflag").alias("kind"))
    return rust.twins(lines)


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def foreign_keys(spark, d):
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT l_suppkey AS target, list_sort(list(DISTINCT l_orderkey)) AS importers FROM lineitem GROUP BY l_suppkey")
def importers(spark, d):
    """The reverse of a links' table."""
    return reports.merged_sets(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_orderkey").alias("importers")), ["target"], "importers")


@query("""WITH n AS (SELECT c_nationkey AS module_idx, c_mktsegment AS name, c_custkey FROM customer) SELECT a.module_idx, a.name, a.c_custkey FROM n a
WHERE a.name = 'BUILDING' AND EXISTS (SELECT 1 FROM n b WHERE b.module_idx = a.module_idx AND b.c_custkey % 100 = 0)""")
def name_collisions(spark, d):
    """What stands in the way of a new name, in modules where the renamed items are bound."""
    customer = table(spark, d, "customer")
    bound = customer.select(F.lit(0).alias("crate_id"), F.col("c_nationkey").alias("module_idx"), F.col("c_mktsegment").alias("name"), F.lit("type").alias("space"), F.col("c_custkey").alias("target_idx"))
    items = customer.filter("c_custkey % 100 = 0").select(F.lit(0).alias("crate_id"), F.col("c_custkey").alias("item_idx"))
    return rust.collisions({"bindings": bound}, items, "BUILDING").select("module_idx", "name", F.col("target_idx").alias("c_custkey"))


@query("SELECT o_orderkey, 'first' AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'more' FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 3 = 0")
def adopted_rows(spark, d):
    orders = table(spark, d, "orders")
    first = orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("first").alias("source"))
    return rows.adopted(first, orders.filter("o_custkey % 3 = 0").select("o_orderkey", F.lit("more").alias("source")), ["o_orderkey"])


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS start, min(l_suppkey) AS seq FROM lineitem GROUP BY 1, 2")
def merged_edits(spark, d):
    """Two plans that agree in most edits, as one."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"), F.lit("x").alias("replacement"), F.col("l_suppkey").alias("seq"))
    return edits.merge(line, line.filter("start > 2")).select("path", "start", "seq")


# Texts


@query("""SELECT doc_id, p AS "offset", length(left(text, p)) - length(replace(left(text, p), chr(10), '')) + 1 AS line, length(regexp_extract(left(text, p), '([^\\n]*)$', 1)) + 1 AS "column"
FROM (SELECT doc_id, text, CAST(floor(length(text) / 2) AS BIGINT) AS p FROM documents WHERE text IS NOT NULL)""")
def text_positions(spark, d):
    """Line and column of the middle of each text."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.floor(F.char_length("text") / 2).cast("long").alias("offset"))
    line, column = text.position(F.col("text"), F.col("offset"))
    return docs.select("doc_id", "offset", line.cast("long").alias("line"), column.cast("long").alias("column"))


@query("""SELECT doc_id, coalesce(list_sum(list_transform(string_split(text, chr(10))[1:1], lambda x: length(x) + 1)), 0) + least(4, length(string_split(text, chr(10))[2])) AS "offset" FROM documents WHERE contains(text, chr(10))""")
def text_offsets(spark, d):
    """Where column 5 of line 2 is, or that line's end before it."""
    docs = table(spark, d, "documents").filter(F.contains("text", F.lit("\n")))
    return docs.select("doc_id", text.offset(F.col("text"), F.lit(2), F.lit(5)).cast("long").alias("offset"))


@query("SELECT doc_id, decode(encode(text)[11:30]) AS piece FROM documents WHERE strlen(text) = length(text) AND length(text) > 40")
def text_slices(spark, d):
    docs = table(spark, d, "documents").filter((F.octet_length("text") == F.char_length("text")) & (F.char_length("text") > 40))
    return docs.select("doc_id", views.source(F.col("text"), F.lit(10), F.lit(30)).alias("piece"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, a, b, a <= 45 AND 45 < b AS holds, a < 60 AND 30 < b AS meets FROM r""")
def range_tests(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).alias("b"))
    return line.select("l_orderkey", "a", "b", spans.contains(F.col("a"), F.col("b"), F.lit(45)).alias("holds"), spans.overlaps(F.col("a"), F.col("b"), F.lit(30), F.lit(60)).alias("meets"))


@query("SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'pub' WHEN 1 THEN 'pub(in a::b)' WHEN 2 THEN 'private' ELSE 'inherited' END AS shown FROM nation")
def visibility_names(spark, d):
    k = F.col("n_nationkey") % 4
    vis = F.when(k == 0, "pub").when(k == 1, "pub(in  a::b)").otherwise("")
    return table(spark, d, "nation").select("n_name", find.visibility(vis, F.when(k == 3, "variant").otherwise("fn")).alias("shown"))


@query(f"""WITH {PLACES}, t AS (SELECT *, string_split(path, '::') AS parts FROM places) SELECT path, CASE WHEN kind = 'customer' THEN parts[2] ELSE parts[1] END AS module FROM t""")
def nearest_module(spark, d):
    """The last name but one of each path, or its own: by ancestors."""
    nodes = places(spark, d)
    up = trees.ancestors(nodes.select(F.col("path").alias("node"), "parent")).filter("distance = 1")
    named = nodes.select(F.col("path").alias("ancestor"), F.col("name").alias("module"))
    return nodes.join(up.join(named, "ancestor"), F.col("path") == F.col("node"), "left").select("path", F.coalesce("module", "name").alias("module"))


@query("SELECT p_partkey FROM part WHERE starts_with(p_name, 'cold') OR ends_with(p_name, 'ring') OR contains(p_name, 'll w') OR p_name = 'blue rod'")
def ident_forms(spark, d):
    """Names by their start, end, middle, and whole."""
    forms = (globs.Ident.starts_with("cold"), globs.Ident.ends_with("ring"), globs.Ident.contains("ll w"), globs.Ident.exact("blue rod"))
    name = F.col("p_name")
    return table(spark, d, "part").filter(forms[0].matches(name) | forms[1].matches(name) | forms[2].matches(name) | forms[3].matches(name)).select("p_partkey")


@query(f"WITH {PLACES} SELECT path FROM places WHERE (starts_with(path, 'EUROPE::') AND kind = 'nation') OR (starts_with(path, 'ASIA::') AND kind = 'customer' AND name LIKE '%5') OR path = 'AFRICA'")
def anchored_patterns(spark, d):
    """`crate::*` in the selected crate, `::ASIA::*::*5` from a crate's root, and a name anywhere."""
    items = places(spark, d).withColumn("selected", F.split("path", "::")[0] == "EUROPE")
    made = [globs.Path.parse(p, loose=True) for p in ("crate::*", "::ASIA::*::*5", "AFRICA")]
    found = find.find(items, made)
    return found.filter("kind <> 'customer' OR startswith(path, 'ASIA')").select("path")


@query("SELECT o_orderkey AS item_idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def unresolved_links(spark, d):
    """Orders as imports, lines of large amounts as what they lead to."""
    items = table(spark, d, "orders").select(F.lit(0).alias("crate_id"), F.col("o_orderkey").alias("item_idx"), F.lit("import").alias("kind"))
    targets = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.lit(0).alias("crate_id"), F.col("l_orderkey").alias("item_idx"))
    return rust.unresolved_imports({"items": items, "targets": targets}).select("item_idx")


@query("""WITH s AS (SELECT l_orderkey AS file, l_linenumber AS item_idx, l_linenumber * 3 AS a, l_linenumber * 3 + CAST(l_quantity AS BIGINT) % 20 AS b FROM lineitem),
u AS (SELECT file, a, b, min(item_idx) AS item_idx FROM s GROUP BY file, a, b), p AS (SELECT DISTINCT file, 12 AS line FROM s)
SELECT p.file, p.line, arg_max(u.item_idx, u.a * 1000 - u.b) AS item_idx FROM p LEFT JOIN u ON u.file = p.file AND u.a <= p.line AND p.line <= u.b GROUP BY p.file, p.line""")
def items_at_lines(spark, d):
    """Lines of orders as items of a file, which hold line 12 or don't."""
    line = table(spark, d, "lineitem")
    a = F.col("l_linenumber") * 3
    items = line.select(F.lit(0).alias("crate_id"), F.col("l_linenumber").alias("item_idx"), F.lit("x").alias("path"), F.col("l_orderkey").alias("file"), a.alias("start_line"), (a + F.col("l_quantity").cast("long") % 20).alias("end_line"), F.col("l_linenumber").alias("start"))
    return rust.at_lines(items, items.select("file").distinct().withColumn("line", F.lit(12))).select("file", "line", "item_idx")


@query("""SELECT o_orderkey, lead_from, lead_to FROM (SELECT o_orderkey, o_custkey AS lead_from, lead(o_custkey) OVER (ORDER BY o_orderkey) AS lead_to FROM orders) WHERE lead_from > lead_to""")
def crossed_neighbours(spark, d):
    """Orders whose next one has a lesser customer: neighbours in a whole table's order, found by ranks and an equi-join."""
    ranked = rows.numbered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey").asc()])
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col("o_custkey").alias("lead_to"))
    return ranked.join(after, "rank").filter("o_custkey > lead_to").select("o_orderkey", F.col("o_custkey").alias("lead_from"), "lead_to")
