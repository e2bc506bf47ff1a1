"""Catalog operators on documents: platform is the language, title the first six words, description the text; labels act as reviews and ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import statements as P
from tallyspark.functions import text as T
from tallyspark.operators import catalog as C
from tallyspark.operators.graphs import cut
from tallyspark.plans.base import Registry
from tallyspark.plans.text_queries import CLEAN, KEY, TITLE

R = Registry()
URL = "'https://codeforces.com/contest/' || (doc_id % 50) || '/problem/A'"
V = f"""v AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE lang WHEN 'en' THEN 'codeforces' ELSE lang END AS platform, {TITLE} AS title, doc_id % 50 AS contest, {CLEAN.format('text')} AS description FROM documents),
w AS (SELECT *, sha256(description) AS fp, CASE WHEN platform = 'codeforces' THEN {KEY.format(f'''regexp_replace(lower({CLEAN.format('title')}), '^[a-z]\\.\\s+', '')''')} ELSE {KEY.format(f'lower({CLEAN.format("title")})')} END AS title_key FROM v)"""
LONG = "length(description) >= 80 AND len(regexp_extract_all(description, '[\\p{L}\\p{N}]+')) >= 15 AND NOT regexp_matches(description, '(?i)\\b(?:for|note|example|input|output)\\s*:?\\s*$|(?:\\.\\.\\.|…)\\s*$') AND NOT regexp_matches(title, '(?i)\\b(easy|medium|hard|version|subtask|dataset|interactive|output.only|small|large)\\b')"


def versions(t):
    d = t("documents")
    title = F.array_join(F.slice(F.split("text", " ", 7), 1, 6), " ")
    platform = F.when(F.col("lang") == "en", "codeforces").otherwise(F.col("lang"))
    clean = T.clean_text(F.col("text"))
    out = d.select(F.col("doc_id").cast("string").alias("id"), platform.alias("platform"), title.alias("title"), F.concat(F.lit("https://codeforces.com/contest/"), (F.col("doc_id") % 50).cast("string"), F.lit("/problem/A")).alias("url"), clean.alias("description"))
    return out.withColumn("fingerprint", F.sha2("description", 256)).withColumn("title_key", T.title_key(F.col("title"), F.col("platform"))).withColumn("review_fingerprint", F.sha2(F.concat_ws("|", "title", "fingerprint"), 256))


def nobody(t):
    return t("documents").limit(0).select(F.col("doc_id").cast("string").alias("id"))


def no_pairs(t):
    return nobody(t).select(F.col("id").alias("left"), F.col("id").alias("right"))


EXACT = f"""{V}, b AS (SELECT fp, title_key, min(id) AS grp FROM w GROUP BY 1, 2 HAVING count(*) > 1 AND bool_and({LONG}) AND count(*) FILTER (platform = 'codeforces') = count(DISTINCT CASE WHEN platform = 'codeforces' THEN contest END)), g AS (SELECT w.id, b.grp FROM w JOIN b USING (fp, title_key))"""


@R.add("a18_exact_groups", f"WITH {EXACT} SELECT id, grp FROM g")
def a18(t):
    return C.exact_groups(versions(t), no_pairs(t), nobody(t))


@R.add("p41_merge_blockers", f"""WITH {V} SELECT a.id AS left_id, b.id AS right_id, (a.title_key <> b.title_key)::INT + (NOT (length(a.description) >= 80 AND len(regexp_extract_all(a.description, '[\\p{{L}}\\p{{N}}]+')) >= 15))::INT + regexp_matches(a.description, '(?i)\\b(?:for|note|example|input|output)\\s*:?\\s*$|(?:\\.\\.\\.|…)\\s*$')::INT + regexp_matches(a.title || ' ' || b.title, '(?i)\\b(easy|medium|hard|version|subtask|dataset|interactive|output.only|small|large)\\b')::INT + (a.platform = 'codeforces' AND b.platform = 'codeforces' AND a.contest = b.contest)::INT + (a.platform = 'codeforces' AND b.platform = 'codeforces' AND (regexp_matches(a.title, '(?i)^[a-z]\\d+\\.') OR regexp_matches(b.title, '(?i)^[a-z]\\d+\\.')))::INT AS reasons FROM w a JOIN w b ON a.fp = b.fp AND a.id < b.id""")
def p41(t):
    v = cut(C.judged(versions(t)))  # a version is read once, whatever the number of its copies
    v = v.join(v.groupBy("fingerprint").agg(F.count("*").alias("copies")).filter("copies > 1"), "fingerprint")
    pairs = v.alias("a").join(v.alias("b"), (F.col("a.fingerprint") == F.col("b.fingerprint")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.size(C.merge_blockers()).alias("reasons"))


@R.add("j23_pairs_in_groups", f"WITH {EXACT} SELECT a.id AS left_id, b.id AS right_id FROM g a JOIN g b ON a.grp = b.grp AND a.id < b.id")
def j23(t):
    return C.grouped_pairs(a18(t))


@R.add("f01_quarantine", "SELECT page_id, CASE WHEN url LIKE '%?%' THEN 'query' WHEN url NOT LIKE 'https://%' THEN 'unsafe' END AS reason FROM pages")
def f01(t):
    good, bad = C.quarantine(t("pages").select("page_id", "url"), {"query": F.col("url").contains("?"), "unsafe": ~F.col("url").startswith("https://")})
    return good.select("page_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("page_id", "reason"))


@R.add("j01_text_join", "SELECT source, count(DISTINCT text) AS texts, count(*) AS n FROM documents GROUP BY source")
def j01(t):
    rows, texts = C.interned(t("documents").select("source", "text"), "text")
    return C.with_texts(rows, texts).groupBy("source").agg(F.countDistinct("text").alias("texts"), F.count("*").alias("n"))


@R.add("j10_reviewed_groups", "SELECT 'g' || (doc_id % 20) AS group_id, CAST(doc_id AS VARCHAR) AS member, bool_or(toxic = 1) OVER (PARTITION BY doc_id % 20) AS stale FROM labels")
def j10(t):
    now = t("labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("review_fingerprint"))
    groups = t("labels").select(F.concat(F.lit("g"), (F.col("doc_id") % 20).cast("string")).alias("group_id"), F.col("doc_id").cast("string").alias("member"), F.when(F.col("toxic") == 1, "old").otherwise("p").alias("pin"))
    return C.reviewed_groups(groups, now).select("group_id", "member", "stale")


@R.add("a19_build_stats", f"WITH {EXACT} SELECT (SELECT count(*) FROM w) AS versions, (SELECT count(*) FROM w) - (SELECT count(*) - count(DISTINCT grp) FROM g) AS questions, (SELECT count(DISTINCT grp) FROM g) AS exact_groups, (SELECT count(DISTINCT description) FROM w) AS texts, (SELECT count(*) FROM w WHERE description = '') AS missing")
def a19(t):
    v = cut(C.judged(versions(t)))
    grouped = v.join(C.buckets_of(v, no_pairs(t)), "id", "left")
    # a text has one fingerprint, so texts are counted without moving them
    return grouped.agg(F.count("*").alias("versions"), (F.count_if(F.col("grp").isNull()) + F.countDistinct("grp")).alias("questions"), F.countDistinct("grp").alias("exact_groups"), F.countDistinct("fingerprint").alias("texts"), F.count_if("missing").alias("missing"))


@R.add("i02_claim_ids", "WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS grp FROM part), g AS (SELECT grp, min(id) AS least FROM m GROUP BY 1) SELECT grp, CASE WHEN grp < 'c' THEN 'e_' || grp ELSE 'q_' || left(sha256(least), 32) END AS question_id FROM g")
def i02(t):
    m = t("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("grp"), F.when(F.col("p_name") < "c", F.concat(F.lit("e_"), "p_name")).alias("explicit"))
    return C.claim_ids(m, m.limit(0).select("id", F.col("grp").alias("old_id")))


@R.add("i02_claim_old_ids", "WITH m AS (SELECT p_name AS grp, min(CAST(p_partkey AS VARCHAR)) AS least FROM part GROUP BY 1) SELECT grp, CASE WHEN row_number() OVER (PARTITION BY left(grp, 1) ORDER BY least) = 1 THEN 'old_' || left(grp, 1) ELSE 'q_' || left(sha256(least), 32) END AS question_id FROM m")
def i02_old(t):
    m = t("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("grp"), F.lit(None).cast("string").alias("explicit"))
    return C.claim_ids(m, m.select("id", F.concat(F.lit("old_"), F.substring("grp", 1, 1)).alias("old_id")))


CHAINS = """WITH RECURSIVE m AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS id, CAST(l_suppkey AS VARCHAR) AS grp, 'o' || (l_partkey % 97) AS old FROM lineitem),
g AS (SELECT grp, min(id) AS least, list_sort(list(DISTINCT old)) AS olds FROM m GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY least) AS i FROM g),
c AS (SELECT 0::BIGINT AS i, '' AS grp, '' AS q, []::VARCHAR[] AS taken UNION ALL SELECT o.i, o.grp, x.q, list_append(c.taken, x.q) FROM c JOIN o ON o.i = c.i + 1, LATERAL (SELECT coalesce(list_filter(o.olds, lambda z: NOT list_contains(c.taken, z))[1], 'q_' || left(sha256(o.least), 32)) AS q) x)
SELECT grp, q AS question_id FROM c WHERE i > 0"""


@R.add("i02_claims_in_order", CHAINS)
def i02_chains(t):
    """Suppliers as groups of line items, old ids by part: every claim may hang on the ones before it."""
    lines = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("grp"), F.concat(F.lit("o"), (F.col("l_partkey") % 97).cast("string")).alias("old_id"))
    return C.claim_ids(lines.select("grp", "id", F.lit(None).cast("string").alias("explicit")), lines.select("id", "old_id"))


@R.add("i03_question_titles", "SELECT p_brand, arg_min(p_name, (p_size, p_partkey)) AS title FROM part GROUP BY 1")
def i03(t):
    members = t("part").select(F.col("p_brand").alias("grp"), F.col("p_name").alias("title"), "p_size", "p_partkey")
    return C.question_titles(members, ["p_size", "p_partkey"]).withColumnRenamed("grp", "p_brand")


@R.add("i04_alias_union", "SELECT p_brand, string_agg(a, ',' ORDER BY a) AS aliases FROM (SELECT DISTINCT p_brand, unnest([p_name, p_type]) AS a FROM part) GROUP BY 1")
def i04(t):
    return C.aliases(t("part").withColumn("grp", F.col("p_brand")), "p_name", "p_type").select(F.col("grp").alias("p_brand"), F.array_join("aliases", ",").alias("aliases"))


BEFORE = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS old_id, CASE WHEN p_brand < 'Brand#3' THEN p_type ELSE 'n' || left(p_brand, 7) END AS question_id FROM part"


def moves(t):
    p = t("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("old_id"), F.when(F.col("p_brand") < "Brand#3", F.col("p_type")).otherwise(F.concat(F.lit("n"), F.substring("p_brand", 1, 7))).alias("question_id"))
    return p.select("id", "old_id"), p.select("id", "question_id")


@R.add("i05_redirects", f"SELECT old_id, CASE WHEN count(DISTINCT question_id) = 1 THEN min(question_id) END AS target FROM ({BEFORE}) GROUP BY 1")
def i05(t):
    return C.redirects(*moves(t))


@R.add("i06_ambiguous_aliases", "SELECT p_name AS alias, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def i06(t):
    return C.ambiguous(t("part"), "p_name", "p_brand")


@R.add("j19_redirect_chains", "WITH RECURSIVE r AS (SELECT n_nationkey AS old_id, n_nationkey // 2 AS target FROM nation WHERE n_nationkey > 1), c AS (SELECT old_id, target FROM r UNION ALL SELECT c.old_id, r.target FROM c JOIN r ON c.target = r.old_id) SELECT old_id, min(target) AS target FROM c GROUP BY 1")
def j19(t):
    return C.resolve(t("nation").filter("n_nationkey > 1").select(F.col("n_nationkey").alias("old_id"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("target")))


@R.add("j21_variant_edges", "WITH e AS (SELECT CAST(l.doc_id % 30 AS VARCHAR) AS a, CAST(l.doc_id % 7 AS VARCHAR) || 'x' AS b FROM labels l WHERE quality = 0) SELECT a, b FROM e UNION SELECT b, a FROM e")
def j21(t):
    low = t("labels").filter("quality = 0")
    pairs = low.select(F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("left"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("right"), F.lit("variant").alias("relation"))
    after = low.select(F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("id"), (F.col("doc_id") % 30).cast("string").alias("question_id")).unionByName(low.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"), F.concat((F.col("doc_id") % 7).cast("string"), F.lit("x")).alias("question_id")))
    return C.variant_edges(pairs, after)


AUDIT = "a AS (SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'removed-source' WHEN l.doc_id IS NULL THEN 'new-source' WHEN d.doc_id % 9 = 0 THEN 'changed-source' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS state FROM (SELECT doc_id FROM documents WHERE doc_id % 10 > 0) d FULL JOIN labels l USING (doc_id))"


def ledger(t):
    now = t("documents").filter("doc_id % 10 > 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, "new").otherwise("same").alias("pin"))
    return C.audit(now, t("labels").select(F.col("doc_id").alias("id"), F.lit("same").alias("pin"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("status")))


@R.add("f17_j11_audit_status", f"WITH {AUDIT} SELECT id, state FROM a")
def f17(t):
    return ledger(t)


@R.add("a22_audit_counters", f"WITH {AUDIT} SELECT state, count(*) AS n FROM a GROUP BY 1")
def a22(t):
    return ledger(t).groupBy("state").agg(F.count("*").alias("n"))


@R.add("p24_topic_aliases", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'red' THEN 'Array' WHEN 'blue' THEN 'Array' ELSE x END))), ',') AS topics FROM part")
def p24(t):
    return t("part").select("p_partkey", F.array_join(P.topic_aliases(F.split("p_name", " "), {"red": "Array", "blue": "Array"}), ",").alias("topics"))


@R.add("p45_contract_equality", "SELECT o_orderkey, CASE WHEN coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END, 'base') = 'base' THEN 'equivalent' ELSE 'platform-variant' END AS relationship FROM orders")
def p45(t):
    contract = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", P.relationship(contract, F.lit(None).cast("string")).alias("relationship"))


@R.add("u03_distinct_union", "SELECT s_nationkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1")
def u03(t):
    return C.names_of(t("supplier"), "s_nationkey", "s_name").withColumn("names", F.array_join("names", ","))


@R.add("s04_input_hashes", None)
def s04(t):
    """Hash and size of each input file; rows-only, since SQL has no file hash."""
    from tallyspark.sources.manifest import file_hashes

    df = t("nation")
    return file_hashes(df.sparkSession, df.inputFiles()[0]).select("bytes", "sha256")


@R.add("f16_schema_checks", "SELECT count(*) FILTER (o_totalprice < 0 OR o_orderkey IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P')) AS bad, count(*) AS n FROM orders")
def f16(t):
    return C.schema_faults(t("orders"), {"price": F.col("o_totalprice") >= 0, "id": F.col("o_orderkey").isNotNull(), "status": F.col("o_orderstatus").isin("F", "O", "P")})