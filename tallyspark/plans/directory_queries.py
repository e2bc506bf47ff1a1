"""Organizations, contests, imports and harvested sources: suppliers as organizations, line items as question links, orders as contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import companies as K
from tallyspark.functions import statements as P
from tallyspark.operators import contests as C
from tallyspark.operators import directory as D
from tallyspark.operators.ordering import numbered
from tallyspark.plans.base import Registry
from tallyspark.sources import feeds, incremental

R = Registry()
WINDOW = "CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN '30d' WHEN l_shipdate >= TIMESTAMP '1997-01-01' THEN '6m' ELSE 'all' END"
LEVEL = "CASE p_size % 4 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Hard' ELSE 'Ninja' END"
NOW = "1996-06-01 12:00:00"
now = lambda: F.lit(NOW).cast("timestamp")


def links(t):
    return t("lineitem").select(F.col("l_suppkey").alias("company_id"), F.expr(WINDOW).alias("window"), F.col("l_partkey").alias("question"), F.col("l_quantity").alias("frequency"))


LINKS = f"k AS (SELECT l_suppkey AS company_id, {WINDOW} AS win, l_partkey AS question, l_quantity AS frequency FROM lineitem)"


@R.add("p22_company_slug", "SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'seven' ELSE regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END AS id FROM supplier")
def p22(t):
    seven = t("supplier").filter("s_suppkey = 7").select(K.slug(F.col("s_name")).alias("s")).first()
    return t("supplier").select("s_suppkey", K.canonical_id(F.col("s_name"), {seven.s: "seven"} if seven else {}).alias("id"))


@R.add("p23_split_tags", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Amazon,Microsoft,' || p_brand WHEN 1 THEN p_brand ELSE '' END AS companies, CASE p_partkey % 4 WHEN 0 THEN 'Arrays' WHEN 1 THEN 'Arrays,Graph' WHEN 2 THEN 'Graph' ELSE 'Graph,Zzz' END AS topics FROM part")
def p23(t):
    topics = F.expr("CASE p_partkey % 4 WHEN 0 THEN array('Arrays', 'Amazon Microsoft', p_brand) WHEN 1 THEN array('Arrays', p_brand, 'Graph', 'FAANG', 'Arrays') WHEN 2 THEN array('Graph', ' ') ELSE array('Graph', 'Zzz') END")
    explicit = F.expr("CASE WHEN p_partkey % 4 = 3 THEN array('unknown') END")
    kept, named = K.split_tags(topics, explicit)
    return t("part").select("p_partkey", F.array_join(named, ",").alias("companies"), F.array_join(kept, ",").alias("topics"))


@R.add("p25_category", "SELECT s_suppkey, coalesce(r_name, 'Other') AS category FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 3 > 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def p25(t):
    dim = t("nation").filter("n_nationkey % 3 > 0").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("grp"), F.col("r_name").alias("category"))
    return D.categories(t("supplier").withColumn("grp", F.col("s_nationkey")), dim).select("s_suppkey", "category")


@R.add("j02_company_index", f"WITH {LINKS} SELECT company_id, win AS \"window\", count(*) AS n FROM k JOIN part ON question = p_partkey AND p_size > 10 GROUP BY 1, 2")
def j02(t):
    library = t("part").filter("p_size > 10").select(F.col("p_partkey").alias("question"))
    return D.company_index(links(t), library).groupBy("company_id", "window").agg(F.count("*").alias("n"))


@R.add("j03_alias_dictionary", "SELECT coalesce(s_suppkey, 1000000 + p) AS company_id, count(*) AS n FROM (SELECT DISTINCT p_partkey % 300 AS p FROM part) LEFT JOIN supplier ON s_suppkey = p GROUP BY 1")
def j03(t):
    tags = t("part").select((F.col("p_partkey") % 300).alias("record")).distinct().select("record", F.col("record").alias("name"), F.col("record").alias("slug"))
    known = t("supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_suppkey").alias("company_id"))
    named = D.tagged(tags, known).join(t("supplier").select(F.col("s_suppkey").alias("company_id"), F.lit(True).alias("old")), "company_id", "left")
    return named.groupBy(F.when(F.col("old"), F.col("company_id")).otherwise(F.col("company_id") + 1000000).alias("company_id")).agg(F.count("*").alias("n"))


@R.add("j04_company_associations", "SELECT l_partkey AS question, string_agg(s, ',' ORDER BY s) AS companies FROM (SELECT DISTINCT l_partkey, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS s FROM lineitem) GROUP BY 1")
def j04(t):
    named = t("lineitem").select(F.col("l_partkey").alias("question"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("company_id"))
    return D.associations(named).withColumn("companies", F.array_join("companies", ","))


@R.add("a07_company_counts", f"WITH {LINKS} SELECT company_id, count(*) AS total, count(*) FILTER (d = 'Easy') AS easy, count(*) FILTER (d = 'Medium') AS medium, count(*) FILTER (d = 'Hard') AS hard FROM (SELECT DISTINCT company_id, question, {LEVEL} AS d FROM k JOIN part ON question = p_partkey WHERE win = 'all') GROUP BY 1")
def a07(t):
    rows = D.company_index(links(t), t("part").select(F.col("p_partkey").alias("question"), F.expr(LEVEL).alias("difficulty")))
    return D.counts(rows, "all")


@R.add("a08_company_summary", f"WITH {LINKS} SELECT count(DISTINCT question) AS questions, count(DISTINCT company_id) AS companies FROM k WHERE win = '30d'")
def a08(t):
    return D.summary(links(t), "30d")


@R.add("a30_company_questions", f"WITH {LINKS} SELECT company_id, question, max(frequency) AS frequency FROM k WHERE win = '6m' GROUP BY 1, 2")
def a30(t):
    return D.questions(links(t), "6m")


@R.add("a33_company_topics", f"WITH {LINKS} SELECT DISTINCT company_id, unnest(string_split(p_name, ' ')) AS topic FROM k JOIN part ON question = p_partkey")
def a33(t):
    return D.topics(links(t), t("part").select(F.col("p_partkey").alias("question"), F.split("p_name", " ").alias("topics")))


@R.add("j24_solved_scope", f"WITH {LINKS} SELECT count(DISTINCT question) AS n FROM k WHERE question IN (SELECT o_orderkey FROM orders UNION SELECT c_custkey FROM customer)")
def j24(t):
    done = D.solved_scope(links(t), t("orders").select(F.col("o_orderkey").alias("question")), t("customer").select(F.col("c_custkey").alias("question")))
    return done.agg(F.countDistinct("question").alias("n"))


@R.add("k03_frequency_sort", f"WITH {LINKS}, f AS (SELECT question, max(CASE WHEN question % 3 > 0 THEN frequency END) AS frequency FROM k WHERE company_id = 1 GROUP BY 1) SELECT question, frequency, row_number() OVER (ORDER BY frequency DESC NULLS LAST, question) AS rn FROM f")
def k03(t):
    f = links(t).filter("company_id = 1").groupBy("question").agg(F.max(F.when(F.col("question") % 3 > 0, F.col("frequency"))).alias("frequency"))
    return numbered(f, D.by_frequency(f))


@R.add("k13_category_companies", f"WITH {LINKS} SELECT s_nationkey AS category, s_name, n, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, s_name) AS rn FROM (SELECT company_id, count(*) AS n FROM k GROUP BY 1) JOIN supplier ON s_suppkey = company_id")
def k13(t):
    n = links(t).groupBy("company_id").agg(F.count("*").alias("n")).join(t("supplier"), F.col("company_id") == F.col("s_suppkey"))
    return D.ranked_in_category(n.select(F.col("s_nationkey").alias("category"), F.col("s_name").alias("name"), "n")).withColumnRenamed("name", "s_name")


@R.add("f06_company_directory", f"WITH {LINKS} SELECT s_suppkey FROM supplier WHERE lower(s_name) LIKE '%1%' AND s_nationkey < 12 AND s_suppkey IN (SELECT company_id FROM k)")
def f06(t):
    hit = D.named(t("supplier").filter(F.col("s_nationkey") < 12), "1", [F.col("s_name")])
    return hit.join(links(t).select(F.col("company_id").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey")


@R.add("ks09_company_sink", f"WITH {LINKS} SELECT company_id, string_agg(win || '=' || n, ',' ORDER BY win) AS windows FROM (SELECT company_id, win, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY 1")
def ks09(t):
    return D.windows_sink(links(t))


@R.add("s06_company_snapshot", "SELECT s_suppkey, CAST(rtrim(CAST(s_suppkey % 101 AS VARCHAR) || '%', '%') AS DOUBLE) AS frequency FROM supplier")
def s06(t):
    return t("supplier").select("s_suppkey", D.percentage(F.concat((F.col("s_suppkey") % 101).cast("string"), F.lit("%"))).alias("frequency"))


CON = "c AS (SELECT o_orderkey AS id, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 14 + 1 AS INT)) AS e, o_orderstatus AS platform FROM orders)"


def contests(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 14 + 1 AS INT))").alias("end"), F.col("o_orderstatus").alias("platform"), F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")).alias("url"))


@R.add("f07_active_contests", f"WITH {CON} SELECT id FROM c WHERE e > TIMESTAMP '{NOW}'")
def f07(t):
    return C.active(contests(t), now()).select("id")


@R.add("f08_retained_contests", f"WITH {CON} SELECT id FROM c WHERE e >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND e > s")
def f08(t):
    return C.retained(contests(t), now()).select("id")


for _platform, _key in (("leetcode", "s29a"), ("codeforces", "s29b"), ("atcoder", "s29c")):

    @R.add(f"{_key}_schedule_{_platform}", f"SELECT '{_platform}-c' || o_custkey AS id, arg_max('Round ' || o_orderkey, o_orderkey) AS title, arg_max(o_orderdate, o_orderkey) AS start FROM orders WHERE o_orderkey % 20 BETWEEN 1 AND 14 GROUP BY o_custkey")
    def _schedule(t, platform=_platform):
        s = F.unix_seconds("o_orderdate")
        rows = t("orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("slug"), F.concat(F.lit("Round "), F.col("o_orderkey").cast("string")).alias("title"), s.alias("start_s"), (s + (F.col("o_orderkey") % 20) * 86400).alias("end_s"), F.col("o_orderkey").alias("pos"))
        return C.normalize(rows, platform).select("id", "title", "start")


@R.add("f09_contest_validity", "SELECT count(*) FILTER (o_orderkey % 20 BETWEEN 1 AND 14) AS good, count(*) AS n FROM orders")
def f09(t):
    s = F.unix_seconds("o_orderdate")
    rows = t("orders").select(F.col("o_orderkey").cast("string").alias("slug"), F.lit("x").alias("title"), s.alias("start_s"), (s + (F.col("o_orderkey") % 20) * 86400).alias("end_s"), F.col("o_orderkey").alias("pos"))
    return C.normalize(rows, "codechef").agg(F.count("*").alias("good")).crossJoin(rows.agg(F.count("*").alias("n")))


@R.add("f10_source_fresh", f"WITH {CON} SELECT id FROM c WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(s) <= 21600000000 AND platform <> 'P'")
def f10(t):
    sources = contests(t).select("id", F.col("start").alias("updated_at"), F.when(F.col("platform") == "P", "down").alias("error"), F.lit(False).alias("needs_access"))
    return C.fresh(sources, now()).select("id")


@R.add("f20_connected_scope", f"WITH {CON} SELECT platform, count(*) AS n FROM c WHERE platform IN ('F', 'O') GROUP BY 1")
def f20(t):
    accounts = t("orders").filter("o_orderstatus IN ('F', 'O')").select(F.col("o_orderstatus").alias("platform"))
    return C.connected(contests(t), accounts).groupBy("platform").agg(F.count("*").alias("n"))


@R.add("j14_reminders", f"WITH {CON}, r AS (SELECT id, m AS minutes, s - to_minutes(m) AS due FROM c, (VALUES (60), (10)) v(m) WHERE e > TIMESTAMP '{NOW}') SELECT id, minutes FROM r WHERE due > TIMESTAMP '{NOW}' AND NOT (id % 5 = 0 AND minutes = 60)")
def j14(t):
    c = contests(t)
    sent = c.filter("id % 5 = 0").select(F.concat_ws(":", F.lit("contest"), F.col("id").cast("string"), F.unix_millis("start").cast("string"), F.lit("60")).alias("name"))
    return C.reminders(c, sent, now()).select("id", "minutes")


@R.add("ts11_deliverable", f"WITH {CON} SELECT id FROM c WHERE s <= TIMESTAMP '{NOW}' AND s + INTERVAL 5 DAY >= TIMESTAMP '{NOW}'")
def ts11(t):
    return C.deliverable(contests(t).withColumn("due", F.col("start")), now(), 5 * 1440).select("id")


@R.add("ts10_contest_refresh", f"WITH {CON} SELECT id FROM c WHERE (id % 2 = 0 AND e <= TIMESTAMP '{NOW}' AND id % 3 > 0) OR id % 3 = 0")
def ts10(t):
    c = contests(t)
    return C.refresh(c.filter("id % 2 = 0"), c.filter("id % 3 = 0"), now()).select("id")


@R.add("ts12_reconcile", f"WITH {CON} SELECT id, 'create' AS action FROM c WHERE s > TIMESTAMP '{NOW}' AND id % 4 > 0 UNION ALL SELECT id, 'drop' FROM c WHERE s <= TIMESTAMP '{NOW}' AND id % 4 = 0")
def ts12(t):
    return D.reconciled(contests(t).filter(F.col("start") > now()), contests(t).filter("id % 4 = 0"))


@R.add("k14_calendar_cells", f"WITH {CON}, d AS (SELECT *, CAST((s AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS DATE) AS day FROM c) SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY s, id) AS place, greatest(count(*) OVER (PARTITION BY day) - 3, 0) AS more FROM d QUALIFY place <= 3")
def k14(t):
    return C.calendar_cells(contests(t), "Asia/Kolkata").select("day", "id", F.col("place").cast("long").alias("place"), F.col("more").cast("long").alias("more"))


@R.add("j15_calendar_grid", f"WITH {CON}, g AS (SELECT CAST(unnest(generate_series(DATE '1996-04-28', DATE '1996-06-01', INTERVAL 1 DAY)) AS DATE) AS day) SELECT g.day, count(c.id) AS n FROM g LEFT JOIN c ON CAST(c.s AS DATE) = g.day GROUP BY 1")
def j15(t):
    from tallyspark.functions.times import month_days

    grid = t("region").limit(1).select(F.explode(month_days(F.lit("1996-05-01").cast("date"))).alias("day"))
    return grid.join(contests(t).select(F.to_date("start").alias("day"), "id"), "day", "left").groupBy("day").agg(F.count("id").alias("n"))


@R.add("a34_next_contest", f"WITH {CON} SELECT arg_min(id, (s, id)) AS id, greatest(count(*) - 1, 0) AS remaining FROM c WHERE s > TIMESTAMP '{NOW}'")
def a34(t):
    return C.next_contest(contests(t), now())


@R.add("j12_s24_import", "SELECT CASE WHEN page_id % 7 = 0 THEN 'unresolved' WHEN page_id % 5 = 0 THEN 'duplicate' ELSE 'new' END AS state, count(*) AS n FROM pages GROUP BY 1")
def j12(t):
    from tallyspark.functions import urls

    url = F.when(F.col("page_id") % 7 == 0, F.lit("https://leetcode.com/u/someone")).otherwise(F.concat(F.lit("https://leetcode.com/problems/p"), F.col("page_id").cast("string"), F.lit("/description")))
    rows = t("pages").select("page_id", urls.import_url(url).alias("url")).withColumn("key", urls.problem_key(F.lit("leetcode"), F.col("url")))
    solved = t("pages").filter("page_id % 5 = 0").select(F.concat(F.lit("leetcode:p"), F.col("page_id").cast("string")).alias("k")).distinct()
    seen = rows.join(solved, F.col("key") == F.col("k"), "left")
    return seen.groupBy(F.when(F.col("url").isNull(), "unresolved").when(F.col("k").isNotNull(), "duplicate").otherwise("new").alias("state")).agg(F.count("*").alias("n"))


@R.add("j13_known_ids", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j13(t):
    known = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return D.unknown(t("orders"), known, "o_custkey").select("o_orderkey")


@R.add("j17_title_lookup", "SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def j17(t):
    titles = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"))
    return D.titled(t("orders"), titles, "o_custkey").select("o_orderkey", "title")


METADATA = """WITH p AS (SELECT l_partkey AS id, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS contest FROM lineitem GROUP BY 1) SELECT p.id, p_name AS title, contest AS contest_id, CASE WHEN p_size > 20 THEN CAST(round(p_retailprice) AS BIGINT) END AS difficulty, CASE WHEN p_size < 10 THEN p_type ELSE '' END AS description
FROM p JOIN part ON p.id = p_partkey JOIN orders ON o_orderkey = contest WHERE epoch(o_orderdate) + 7200 <= epoch(TIMESTAMP '1996-01-01')"""


@R.add("j20_s28_metadata_merge", METADATA)
def j20(t):
    part = t("part").select(F.col("p_partkey").alias("id"), "p_name", "p_size", "p_type", "p_retailprice")
    problems = t("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("contest_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).join(part.select("id", F.col("p_name").alias("title")), "id")
    contests_ = t("orders").select(F.col("o_orderkey").alias("contest_id"), F.col("o_orderdate").alias("start"), F.lit(7200).alias("seconds"))
    models = part.filter("p_size > 20").select("id", F.col("p_retailprice").alias("difficulty"))
    previous = part.filter("p_size < 10").select("id", F.col("p_type").alias("description"), F.lit("c").alias("constraints"))
    return D.merged_metadata(problems, contests_, models, previous, F.lit("1996-01-01").cast("timestamp")).select("id", "title", "contest_id", "difficulty", "description")


@R.add("j22_current_record", "SELECT p.page_id, min(q.page_id) AS record FROM pages p JOIN pages q ON regexp_replace(p.url, '[?#].*$', '') = regexp_replace(q.url, '[?#].*$', '') GROUP BY 1")
def j22(t):
    return D.current_record(t("pages"))


@R.add("s27_a26_recovery", "SELECT CASE WHEN doc_id % 3 > 0 THEN 'present' WHEN doc_id % 2 = 0 THEN 'not-found' WHEN length(text) < 80 THEN 'insufficient-statement' ELSE 'recovered' END AS outcome, count(*) AS n, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 2 = 1 AND length(text) >= 80 OR doc_id % 3 > 0) AS described FROM documents GROUP BY 1")
def s27(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, "x").otherwise(" ").alias("description"))
    answers = t("documents").filter("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    return D.recovered(rows, answers).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.trim("description") != "").alias("described"))


@R.add("s31_problem_list", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part WHERE p_size <> 1")
def s31(t):
    p = t("part").select(F.col("p_partkey").alias("id"), "p_size")
    whole = D.problem_list([p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), p.filter("id % 10 = 0")], F.col("p_size") == 1)
    return numbered(whole.select("id"), [F.asc("id")]).withColumnRenamed("id", "p_partkey")


@R.add("k15_index_order", "SELECT p_partkey, row_number() OVER (ORDER BY (p_name LIKE 'r%')::INT DESC, p_size DESC, p_partkey) AS rn FROM part")
def k15(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_name").startswith("r"), "dp").otherwise("other").alias("contest_id"), F.col("p_size").alias("start"))
    return numbered(rows, D.index_order(["dp"])).select(F.col("id").alias("p_partkey"), "rn")


@R.add("p26_difficulty_from_rating", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 OR c_acctbal <= 1200 THEN 'Easy' WHEN c_acctbal <= 2000 THEN 'Medium' ELSE 'Hard' END AS difficulty FROM customer")
def p26(t):
    return t("customer").select("c_custkey", P.difficulty_from_rating(F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal"))).alias("difficulty"))


@R.add("p27_difficulty_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Easy' WHEN 'O' THEN 'Medium' ELSE 'Unknown' END AS difficulty FROM orders")
def p27(t):
    return t("orders").select("o_orderkey", P.difficulty_name(F.col("o_orderstatus"), {"F": "Easy", "O": "Medium"}).alias("difficulty"))


#: Every document with a heading, a formula mark or a database mark of its own, by id.
MADE = "CASE doc_id % 6 WHEN 0 THEN 'Table: T ' WHEN 1 THEN 'Write the create table line ' WHEN 2 THEN 'use $$x$$ ' ELSE '' END || text || CASE doc_id % 4 WHEN 0 THEN ' Example 1: in Constraints: n < 5 Follow-up: faster' WHEN 1 THEN ' Constraint: n > 1' ELSE '' END"
ONE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@R.add("p28_is_sql", f"""WITH d AS (SELECT doc_id, {MADE} AS x FROM documents) SELECT doc_id, regexp_matches(x, '(?i)Table:\\s*\\w+|Column Name.*Type|\\+[-+]+\\+|employee_id.*int|varchar\\(\\d+\\)|Write a.*solution|Select.*from|database') AS leetcode,
regexp_matches(x, '(?i)create table|insert into|select\\s+.*\\s+from|varchar\\s*\\(|database\\s+schema|sql\\s+query') AS codechef FROM d""")
def p28(t):
    x = F.expr(MADE)
    return t("documents").select("doc_id", P.is_database(x, "leetcode").alias("leetcode"), P.is_database(x, "codechef").alias("codechef"))


@R.add("p29_statement_split", f"""WITH d AS (SELECT doc_id, {MADE} AS x FROM documents), e AS (SELECT *, regexp_extract(x, '(?is)^(.*?)Example\\s*\\d*\\s*:', 1) AS a, regexp_matches(x, '(?i)Example\\s*\\d*\\s*:') AS ha, regexp_extract(x, '(?is)^(.*?)Constraints?\\s*:', 1) AS b, regexp_matches(x, '(?i)Constraints?\\s*:') AS hb, regexp_extract(x, '(?is)Constraints?\\s*:(.*)$', 1) AS r FROM d)
SELECT doc_id, {ONE.format("CASE WHEN ha THEN a WHEN hb THEN b ELSE x END")} AS description, {ONE.format("regexp_replace(r, '(?is)Follow-up\\s*:.*$', '')")} AS constraints FROM e""")
def p29(t):
    return t("documents").select("doc_id", P.split_statement(F.expr(MADE), "leetcode").alias("s")).select("doc_id", "s.*")


@R.add("p30_component_clean", f"""WITH d AS (SELECT doc_id, {ONE.format(f"regexp_replace(CASE WHEN doc_id % 5 > 0 THEN {MADE} ELSE ' $' END, '\\$+', ' ', 'g')")} AS x FROM documents) SELECT doc_id, CASE WHEN x = '' THEN '' ELSE x || ' Input: n' END AS body, CASE WHEN x = '' THEN '' ELSE 'a b' END AS constraints FROM d""")
def p30(t):
    statement = F.when(F.col("doc_id") % 5 > 0, F.expr(MADE)).otherwise(" $")
    return t("documents").select("doc_id", P.from_components(statement, F.lit("$n$"), F.lit(" a $ b")).alias("s")).select("doc_id", F.col("s.description").alias("body"), "s.constraints")


@R.add("p33_topic_union", "SELECT p_partkey, string_agg(DISTINCT x, ',' ORDER BY x) AS topics FROM (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' '))) AS x FROM part) GROUP BY 1")
def p33(t):
    return t("part").select("p_partkey", F.array_join(P.topic_union(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), ",").alias("topics"))


@R.add("p44_match_type", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 20 = 0 THEN 'confirmed' ELSE 'platform-variant' END WHEN event_id % 100 > 60 THEN 'exact' ELSE 'similar' END AS kind FROM events")
def p44(t):
    e = F.col("event_id")
    return t("events").select("event_id", P.match_type(e % 10 == 0, e % 20 == 0, e % 100 / 100).alias("kind"))


@R.add("p42_review_reasons", "SELECT p_partkey, (p_size = 1)::INT + (p_size % 2)::INT + (p_size % 3 > 0)::INT + (p_size % 5 = 0)::INT AS n FROM part")
def p42(t):
    titles = F.array("p_name", F.when(F.col("p_size") % 5 == 0, "Task (hard version)").otherwise("hardly"))
    return t("part").select("p_partkey", F.size(P.review_reasons(F.col("p_size") == 1, F.col("p_size") % 2 == 1, F.col("p_size") % 3 == 0, titles)).alias("n"))


@R.add("s10_feed_rows", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def s10(t):
    return feeds.links(t("pages"), "page_id")


@R.add("s23_page_content", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS content FROM pages")
def s23(t):
    return t("pages").select("page_id", feeds.page_content(F.col("html")).alias("content"))


@R.add("ts03_incremental_source", "SELECT conv_id, count(DISTINCT turn) AS turns, max(turn) AS last FROM conversations GROUP BY 1")
def ts03(t):
    """Two overlapping reads of a feed, replayed rows dropped by id."""
    c = t("conversations")
    read = incremental.replayed([c.filter("turn <= 2"), c.filter("turn >= 1"), c], ("conv_id", "turn"))
    return read.groupBy("conv_id").agg(F.countDistinct("turn").alias("turns"), F.max("turn").alias("last"))