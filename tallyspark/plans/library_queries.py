"""Library operators on part: title is the name, platform the brand, difficulty from the size, topics the name's words; names make canonical groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import search_normal
from tallyspark.operators import library as L
from tallyspark.operators.ordering import numbered
from tallyspark.plans.base import Registry

R = Registry()
LEVEL = "CASE p_size % 5 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Hard' WHEN 3 THEN 'Unknown' ELSE 'Basic' END"
LIB = f"l AS (SELECT p_partkey AS id, 'k' || p_partkey AS key, p_partkey AS pos, p_name AS title, p_brand AS platform, {LEVEL} AS difficulty, string_split(p_name, ' ') AS topics, p_size % 4 = 0 AS is_premium, CASE WHEN p_partkey % 3 > 0 THEN 'q_' || p_name END AS canonical_id, CASE WHEN p_partkey % 3 > 0 THEN p_name || ' (canonical)' END AS canonical_title, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS frequency FROM part)"
SOLVED = "SELECT 'k' || l_partkey AS key FROM lineitem WHERE l_quantity > 48"
G = "coalesce(canonical_id, key)"


def lib(t):
    return t("part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.col("p_brand").alias("platform"), F.expr(LEVEL).alias("difficulty"),
        F.split("p_name", " ").alias("topics"), (F.col("p_size") % 4 == 0).alias("is_premium"), F.expr("CASE WHEN p_partkey % 3 > 0 THEN concat('q_', p_name) END").alias("canonical_id"), F.expr("CASE WHEN p_partkey % 3 > 0 THEN concat(p_name, ' (canonical)') END").alias("canonical_title"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END").alias("frequency"),
    )


def solved(t):
    return t("lineitem").filter("l_quantity > 48").select(F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("key"))


def word(t):
    return "a"


@R.add("f02_library_filter", f"WITH {LIB} SELECT id FROM l WHERE difficulty = 'Easy' AND NOT is_premium AND platform IN (SELECT p_brand FROM part WHERE p_size = 1)")
def f02(t):
    return L.filter_library(lib(t), accounts=t("part").filter("p_size = 1").select(F.col("p_brand").alias("platform")), difficulty="Easy", access="free").select("id")


@R.add("f19_platform_enabled", f"WITH {LIB} SELECT platform, count(*) AS n FROM l WHERE platform IN (SELECT p_brand FROM part WHERE p_size = 2) GROUP BY 1")
def f19(t):
    return L.filter_library(lib(t), accounts=t("part").filter("p_size = 2").select(F.col("p_brand").alias("platform"))).groupBy("platform").agg(F.count("*").alias("n"))


NORMAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@R.add("f03_text_filter", f"WITH {LIB} SELECT id FROM l WHERE (contains({NORMAL.format('title')}, 'e') AND contains({NORMAL.format('title')}, 'an')) OR (contains({NORMAL.format('canonical_title')}, 'e') AND contains({NORMAL.format('canonical_title')}, 'an'))")
def f03(t):
    return L.filter_library(lib(t), query="e an").select("id")


@R.add("f05_workspace_filter", f"WITH {LIB} SELECT id FROM l WHERE contains(lower(title), 'e') AND list_contains(topics, topics[1]) AND id % 2 = 0")
def f05(t):
    rows = lib(t).withColumn("lists", F.when(F.col("id") % 2 == 0, F.array(F.lit("saved"))).otherwise(F.array().cast("array<string>")))
    return rows.filter(L.text_match(F.array(F.concat_ws(" ", "title", F.array_join("topics", " "))), "e") & F.array_contains("lists", "saved")).select("id")


@R.add("j06_status_solved", f"WITH {LIB}, g AS (SELECT DISTINCT {G} AS g FROM l WHERE key IN ({SOLVED})) SELECT id, {G} IN (SELECT g FROM g) AS done FROM l")
def j06(t):
    yes = L.filter_library(lib(t), status="solved", solved=solved(t)).select("id", F.lit(True).alias("done"))
    return yes.unionByName(L.filter_library(lib(t), status="unsolved", solved=solved(t)).select("id", F.lit(False).alias("done")))


REL = f"CASE WHEN {NORMAL.format('title')} = 'red' OR CAST(id AS VARCHAR) = 'red' THEN 0 WHEN {NORMAL.format('title')} LIKE 'red%' THEN 1 WHEN {NORMAL.format('title')} LIKE '%red%' THEN 2 ELSE 4 END"


@R.add("k01_relevance", f"WITH {LIB} SELECT id, rel, row_number() OVER (ORDER BY rel, platform, pos) AS rn FROM (SELECT *, {REL} AS rel FROM l)")
def k01(t):
    rows = lib(t).withColumn("rel", L.relevance(F.col("title"), F.col("id").cast("string"), "red"))
    return numbered(rows.select("id", "rel", "platform", "pos"), [F.asc("rel"), F.asc("platform"), F.asc("pos")]).select("id", "rel", "rn")


@R.add("k02_difficulty_sort", f"WITH {LIB} SELECT id, row_number() OVER (ORDER BY CASE difficulty WHEN 'Unknown' THEN 5 WHEN 'Basic' THEN 0 WHEN 'Easy' THEN -1 WHEN 'Medium' THEN -2 ELSE -3 END, title, pos) AS rn FROM l")
def k02(t):
    return numbered(lib(t).select("id", "difficulty", "title", "pos"), [L.difficulty_rank(F.col("difficulty"), True), F.asc("title"), F.asc("pos")]).select("id", "rn")


@R.add("k02_natural_title", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 100, c_custkey) AS rn FROM customer")
def k02_natural(t):
    title = F.concat(F.lit("Problem "), (F.col("c_custkey") % 100).cast("string"))
    return numbered(t("customer").select("c_custkey", title.alias("title")), [L.natural_key(F.col("title")), F.asc("c_custkey")]).select("c_custkey", "rn")


@R.add("k10_paging", f"WITH {LIB} SELECT id, rn FROM (SELECT id, row_number() OVER (ORDER BY title, pos) AS rn FROM l) WHERE rn > 100 AND rn <= 150")
def k10(t):
    return L.page(lib(t), 3, 50, [F.asc("title"), F.asc("pos")]).select("id", F.col("rn").cast("long").alias("rn"))


@R.add("a09_collapse", f"WITH {LIB} SELECT arg_min(id, pos) AS id, arg_min(platform, pos) AS platform, arg_min(coalesce(canonical_title, title), pos) AS title, min(pos) AS pos, array_to_string(list_sort(list_distinct(flatten(list(topics)))), ',') AS topics, max(frequency) AS frequency, count(frequency) AS n_sources, count(*) AS n_versions FROM l GROUP BY coalesce(canonical_id, 'row:' || pos)")
def a09(t):
    return L.collapse(lib(t)).withColumn("topics", F.array_join("topics", ","))


@R.add("a10_difficulty_facets", f"WITH {LIB} SELECT difficulty, count(DISTINCT {G}) AS n FROM l GROUP BY 1")
def a10(t):
    return L.difficulty_facets(lib(t))


@R.add("a11_topic_facets", f"WITH {LIB} SELECT topic, count(DISTINCT g) AS n FROM (SELECT {G} AS g, unnest(topics) AS topic FROM l WHERE difficulty = 'Hard') GROUP BY 1")
def a11(t):
    return L.topic_facets(L.filter_library(lib(t), difficulty="Hard"))


@R.add("a12_list_counts", f"WITH {LIB} SELECT topic AS list, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM l) GROUP BY 1")
def a12(t):
    return L.list_counts(lib(t), "topics")


@R.add("a28_solve_links", f"WITH {LIB} SELECT canonical_id, platform, arg_min(key, (CASE WHEN difficulty = 'Hard' THEN 0 ELSE 1 END, pos)) AS key, bool_or(key IN ({SOLVED})) AS done FROM l WHERE canonical_id IS NOT NULL GROUP BY 1, 2")
def a28(t):
    rows = lib(t).filter("canonical_id IS NOT NULL").join(solved(t).distinct().withColumn("done", F.lit(True)), "key", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return L.solve_links(rows.withColumn("matched", F.col("difficulty") == "Hard"))


@R.add("a29_row_actions", f"WITH {LIB} SELECT {G} AS grp, bool_or(key IN ({SOLVED})) AS solved, bool_or(id % 10 = 0) AS starred, count(DISTINCT difficulty) AS lists FROM l GROUP BY 1")
def a29(t):
    return L.row_actions(lib(t), solved(t), F.col("id") % 10 == 0, F.col("difficulty"))


@R.add("a31_results_by_source", f"WITH {LIB}, c AS (SELECT platform, count(*) AS n FROM l WHERE difficulty = 'Hard' GROUP BY 1) SELECT platform, n, row_number() OVER (ORDER BY n DESC, platform) AS rank FROM c")
def a31(t):
    return numbered(L.by_source(lib(t).filter("difficulty = 'Hard'")), [F.desc("n"), F.asc("platform")], "rank")


@R.add("a32_corpus_counts", f"WITH {LIB} SELECT count(*) AS total, count(DISTINCT {G}) AS unique_questions, count(DISTINCT platform) AS platforms FROM l")
def a32(t):
    return L.corpus_counts(lib(t))


@R.add("f18_j05_attach_catalog", f"WITH {LIB}, v AS (SELECT canonical_id, key, title, platform, id FROM l WHERE canonical_id IS NOT NULL), g AS (SELECT canonical_id FROM v GROUP BY 1 HAVING count(*) >= 2 AND bool_and(id % 97 <> 5 AND platform <> 'Brand#11')) SELECT l.key, CASE WHEN l.canonical_id IN (SELECT canonical_id FROM g) THEN l.canonical_id END AS canonical_id FROM l")
def f18(t):
    rows = lib(t).select(F.col("key").alias("source_id"), "platform", F.when(F.col("id") % 97 == 5, F.concat("title", F.lit(" renamed"))).otherwise(F.col("title")).alias("title"))
    versions = lib(t).filter("canonical_id IS NOT NULL").select("canonical_id", F.col("key").alias("source_id"), "title")
    verified = lib(t).select("platform").distinct().filter("platform <> 'Brand#11'")
    return L.attach_catalog(rows, versions, verified).select(F.col("source_id").alias("key"), "canonical_id")


@R.add("p46_platform_order", "SELECT p_brand AS platform, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#23' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END, p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def p46(t):
    saved = F.array(F.lit("Brand#23"), F.lit("Brand#12"), F.lit("gone"))
    order = t("part").agg(F.array_sort(F.collect_set("p_brand")).alias("d")).select(F.posexplode(L.ordered_platforms(saved, F.col("d"))).alias("p", "platform"))
    return order.select("platform", (F.col("p") + 1).cast("long").alias("place"))


@R.add("p47_state_migration", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'saved' WHEN p_size % 3 = 1 THEN 'saved,custom' ELSE '' END AS lists FROM part")
def p47(t):
    given = F.expr("CASE p_size % 3 WHEN 1 THEN array('saved', 'gone', 'custom', 'saved') WHEN 2 THEN array('gone') END")
    return t("part").select("p_partkey", F.array_join(L.migrated_lists(given, F.array(F.lit("saved"), F.lit("custom"))), ",").alias("lists"))


@R.add("p48_question_defaults", f"WITH {LIB} SELECT id, coalesce(CASE WHEN id % 5 > 0 THEN difficulty END, 'Unknown') AS difficulty, len(list_distinct(topics)) AS n_topics FROM l")
def p48(t):
    rows = L.with_defaults(lib(t).withColumn("difficulty", F.when(F.col("id") % 5 > 0, F.col("difficulty"))))
    return rows.select("id", "difficulty", F.size("topics").cast("long").alias("n_topics"))


@R.add("s02_library_scan", f"WITH {LIB} SELECT id, {NORMAL.format('title')} AS normal, difficulty FROM l WHERE platform LIKE 'Brand#1%' AND title IS NOT NULL")
def s02(t):
    return lib(t).filter("platform LIKE 'Brand#1%' AND title IS NOT NULL").select("id", search_normal(F.col("title")).alias("normal"), "difficulty")


@R.add("s03_popup_scan", "SELECT page_id, url FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def s03(t):
    return L.complete(t("pages"), "url", "html").select("page_id", "url")


@R.add("s01_corpus_scan", "SELECT 'part' AS source, CAST(p_partkey AS BIGINT) AS id, p_name AS title FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def s01(t):
    return L.corpus({"part": t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "supplier": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))})


@R.add("k12_random_pick", f"WITH {LIB} SELECT id, title FROM l WHERE id <> 7 ORDER BY md5('11|' || id), id LIMIT 1")
def k12(t):
    return L.random_pick(lib(t), "id", "11", 7).select("id", "title")


@R.add("ks03_runtime_projection", f"WITH {LIB} SELECT canonical_id, count(*) AS versions FROM l WHERE canonical_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def ks03(t):
    return L.runtime_projection(lib(t))


@R.add("ks02_check_mode", "SELECT count(*) AS differing FROM ((SELECT p_partkey, p_name FROM part EXCEPT ALL SELECT p_partkey, p_name FROM part WHERE p_size > 0) UNION ALL (SELECT p_partkey, p_name FROM part WHERE p_size > 0 EXCEPT ALL SELECT p_partkey, p_name FROM part))")
def ks02(t):
    from tallyspark.sources.manifest import differing

    rows = t("part").select("p_partkey", "p_name")
    return differing(rows, t("part").filter("p_size > 0").select("p_partkey", "p_name"))


@R.add("ts16_list_checks", "SELECT lower(p_brand) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def ts16(t):
    """List names must be unique, case aside: the names that break it."""
    return L.clashing_names(t("part"), "p_brand")