"""Candidates over documents (platform: language), search and page matching over part (problems) and customers or names (pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import pages as P
from tallyspark.operators import search
from tallyspark.operators import similarity as S
from tallyspark.operators.graphs import cut
from tallyspark.plans.base import Registry
from tallyspark.plans.text_queries import TITLE, retrieval_sql

R = Registry()


def dedupe(a: str) -> str:
    return f"list_distinct({a})"


def versions(t):
    d = t("documents")
    title = F.array_join(F.slice(F.split("text", " ", 7), 1, 6), " ")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("platform"), T.retrieval_tokens(title, False).alias("title_tokens"), T.retrieval_tokens(T.retrieval_body(F.col("text")), True).alias("body_tokens"), F.sha2("text", 256).alias("fingerprint"))


V = f"""v AS MATERIALIZED (SELECT doc_id AS id, lang AS platform, {retrieval_sql(TITLE, False)} AS tt, {dedupe(retrieval_sql('left(text, 10000)', True))} AS bt, sha256(text) AS fp FROM documents), n AS (SELECT count(*) AS n FROM v),
tp AS MATERIALIZED (SELECT id, platform, term, min(pos) AS pos FROM (SELECT id, platform, unnest(tt) AS term, generate_subscripts(tt, 1) AS pos FROM v) GROUP BY 1, 2, 3), bp AS MATERIALIZED (SELECT id, platform, unnest(bt) AS term FROM v),
td AS (SELECT term, count(*) AS df, ln(1 + (SELECT n FROM n)::DOUBLE / count(*)) AS w FROM tp GROUP BY 1), bd AS MATERIALIZED (SELECT term, count(*) AS df, ln(1 + (SELECT n FROM n)::DOUBLE / count(*)) AS w FROM bp GROUP BY 1)"""
PAIRS = f"""{V}, tr AS (SELECT * FROM (SELECT id, term, df, w FROM tp JOIN td USING (term) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, pos) <= 6) WHERE df <= 600), br AS (SELECT id, term, w FROM bp JOIN bd USING (term) WHERE df BETWEEN 2 AND 250 QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, term) <= 12),
vo AS (SELECT a.id, b.id AS other, b.platform, 3 * a.w AS vote FROM tr a JOIN tp b USING (term) WHERE a.id <> b.id UNION ALL SELECT a.id, b.id, b.platform, a.w FROM br a JOIN bp b USING (term) WHERE a.id <> b.id),
sc AS (SELECT id, other, platform, round(sum(vote), 6) AS score FROM vo GROUP BY 1, 2, 3), be AS (SELECT id, other FROM sc QUALIFY row_number() OVER (PARTITION BY id, platform ORDER BY score DESC, other) <= 32),
ke AS (SELECT id, array_to_string(list_sort(list_distinct(tt)), ' ') AS k FROM v WHERE len(tt) > 0 UNION ALL SELECT id, fp FROM v), ex AS (SELECT a.id, b.id AS other FROM ke a JOIN ke b USING (k) WHERE a.id <> b.id),
pairs AS (SELECT DISTINCT least(id, other) AS l, greatest(id, other) AS r FROM (SELECT * FROM be UNION ALL SELECT * FROM ex))"""
SCORED = f"""{PAIRS}, ms AS (SELECT id, sum(w) AS mass FROM bp JOIN bd USING (term) GROUP BY 1), sh AS (SELECT l, r, sum(w) AS common, count(*) AS shared FROM pairs JOIN bp a ON a.id = l JOIN bp b ON b.id = r AND a.term = b.term JOIN bd ON bd.term = a.term GROUP BY 1, 2),
f AS (SELECT pairs.l, pairs.r, a.platform AS pa, b.platform AS pb, CASE WHEN len(list_distinct(a.tt)) + len(list_distinct(b.tt)) > 0 THEN round(2.0 * len(list_intersect(a.tt, b.tt)) / (len(list_distinct(a.tt)) + len(list_distinct(b.tt))), 6) ELSE 0 END AS title, CASE WHEN coalesce(x.mass, 0) + coalesce(y.mass, 0) > 0 THEN round(2 * coalesce(common, 0) / (coalesce(x.mass, 0) + coalesce(y.mass, 0)), 6) ELSE 0 END AS statement, coalesce(shared, 0) AS shared, a.fp = b.fp AS exact, len(a.tt) > 0 AND list_sort(list_distinct(a.tt)) = list_sort(list_distinct(b.tt)) AS alias
FROM pairs JOIN v a ON a.id = pairs.l JOIN v b ON b.id = pairs.r LEFT JOIN ms x ON x.id = pairs.l LEFT JOIN ms y ON y.id = pairs.r LEFT JOIN sh USING (l, r)),
c AS (SELECT l AS "left", r AS "right", least(pa, pb) || '/' || greatest(pa, pb) AS platform_pair, pa <> pb AS cross_platform, title, statement, shared, CASE WHEN exact THEN 'exact-statement' WHEN alias THEN 'title-alias' WHEN title < 0.5 THEN 'statement' ELSE 'title-and-statement' END AS discovery, round(CASE WHEN exact THEN 1.0 ELSE 0.35 * title + 0.65 * statement END, 4) AS score
FROM f WHERE exact OR alias OR (title >= 0.5 AND statement >= 0.10) OR (statement >= 0.32 AND shared >= 4))"""


STATEMENTS = ["id", "platform", "body_tokens"]


def stored(t, columns: list[str] | None = None):
    """Token arrays are used many times over: they are computed once and kept for the query, in the folder of checkpoints, which needs no release. columns: the only ones that are needed."""
    v = cut(versions(t).select(columns or "*"))
    return v, v.count()


def flagship(t):
    v, n = stored(t)
    return S.scored_pairs(S.candidate_pairs(v, n), v, n)


@R.add("j07_candidate_pairs", f'WITH {PAIRS} SELECT l AS "left", r AS "right" FROM pairs')
def j07(t):
    v, n = stored(t)
    return S.candidate_pairs(v, n)


@R.add("j07_exact_links", f"""WITH {V}, ke AS (SELECT id, 'title' AS channel, array_to_string(list_sort(list_distinct(tt)), ' ') AS k FROM v WHERE len(tt) > 0 UNION ALL SELECT id, 'statement', fp FROM v), g AS (SELECT channel, k, min(id) AS representative, count(*) - 1 AS n_links FROM ke GROUP BY 1, 2 HAVING count(*) > 1)
SELECT id, channel, representative, n_links FROM ke JOIN g USING (channel, k)""")
def j07_links(t):
    return S.exact_links(versions(t))


@R.add("j07_candidate_links", f"""WITH {PAIRS}, g AS (SELECT k, min(id) AS l, count(*) - 1 AS n FROM ke GROUP BY 1 HAVING count(*) > 1), st AS (SELECT g.l, id AS r, max(n) AS n FROM g JOIN ke USING (k) WHERE id <> g.l GROUP BY 1, 2), vp AS (SELECT DISTINCT least(id, other) AS l, greatest(id, other) AS r FROM be)
SELECT l AS "left", r AS "right", st.n AS n_links FROM vp FULL JOIN st USING (l, r)""")
def j07_candidate_links(t):
    """The candidates, exact groups as stars."""
    v, n = stored(t)
    return S.candidate_links(v, n)


@R.add("f14_a16_scored_candidates", f'WITH {SCORED} SELECT "left", "right", platform_pair, discovery, round(score, 3) AS score FROM c')
def f14(t):
    v, n = stored(t)
    voted, linked, _ = S.scored_candidates(v, n)
    return voted.unionByName(linked).select("left", "right", "platform_pair", "discovery", F.round("score", 3).alias("score"))


@R.add("p43_discovery", f"WITH {SCORED} SELECT discovery, count(*) AS n FROM c GROUP BY 1")
def p43(t):
    """Pairs with equal titles or statements are counted by group, not made."""
    v, n = stored(t)
    voted, _, own = S.scored_candidates(v, n)
    return voted.select("discovery", F.lit(1).cast("long").alias("n")).unionByName(S.linked_totals(own).select("discovery", "n")).groupBy("discovery").agg(F.sum("n").alias("n"))


SAMPLE = f"""{SCORED}, st AS (SELECT greatest(count(DISTINCT platform_pair), 1) AS s FROM c), rk AS (SELECT *, row_number() OVER (PARTITION BY platform_pair ORDER BY cross_platform DESC, score DESC, "left", "right") AS own FROM c), sa AS (SELECT * FROM rk ORDER BY (own <= least(100, 60 // (SELECT s FROM st)))::INT DESC, cross_platform DESC, score DESC, "left", "right" LIMIT 60)"""


@R.add("k07_stratified_sample", f'WITH {SAMPLE} SELECT "left", "right" FROM sa')
def k07(t):
    v, n = stored(t)
    voted, linked, _ = S.scored_candidates(v, n, most=60)
    return S.select_candidates(cut(voted.unionByName(linked)), 60).select("left", "right")


@R.add("a20_platform_coverage", f'WITH {SAMPLE} SELECT c.platform_pair, count(*) AS total, count(sa."left") AS included FROM c LEFT JOIN sa USING ("left", "right") GROUP BY 1')
def a20(t):
    """Pairs with equal titles or statements are counted by group; only those that a sample may take are made."""
    v, n = stored(t)
    voted, linked, own = S.scored_candidates(v, n, most=60)
    voted = cut(voted)  # counted and ranked
    sample = S.select_candidates(cut(voted.unionByName(linked)), 60).groupBy("platform_pair").agg(F.count("*").alias("included"))
    totals = voted.select("platform_pair", F.lit(1).cast("long").alias("n")).unionByName(S.linked_totals(own).select("platform_pair", "n")).groupBy("platform_pair").agg(F.sum("n").alias("total"))
    return totals.join(sample, "platform_pair", "left").select("platform_pair", "total", F.coalesce("included", F.lit(0)).cast("long").alias("included"))


@R.add("a21_j18_evaluation", f'WITH {PAIRS}, e AS (SELECT a.doc_id AS l, b.doc_id AS r FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id) SELECT count(*) AS expected_pairs, count(p.l) AS retrieved_pairs, round(count(p.l) / count(*), 4) AS recall FROM e LEFT JOIN pairs p ON p.l = e.l AND p.r = e.r')
def a21(t):
    return S.evaluate_groups(t("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("key")), versions(t))


@R.add("a14_title_idf", "WITH p AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) SELECT term, count(*) AS df, round(ln((SELECT count(*) + 1 FROM part)::DOUBLE / (count(*) + 1)) + 1, 6) AS idf FROM p GROUP BY 1")
def a14(t):
    p = t("part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("platform"), F.split("p_name", " ").alias("tokens"))
    return S.title_idf(S.postings(p, "tokens"), F.lit(t("part").count())).withColumn("idf", F.round("idf", 6))


@R.add("a15_retrieval_weights", f"WITH {V} SELECT term, df, round(w, 6) AS w FROM bd")
def a15(t):
    v, n = stored(t, STATEMENTS)
    return S.weights(S.postings(v, "body_tokens"), n).withColumn("w", F.round("w", 6))


@R.add("a27_inverted_index", f"WITH {V} SELECT term, min(id) AS first_id, count(*) AS n FROM bp GROUP BY 1")
def a27(t):
    return S.postings(versions(t), "body_tokens").groupBy("term").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@R.add("k04_rarest_terms", f"WITH {V} SELECT id, term FROM bp JOIN bd USING (term) WHERE df BETWEEN 2 AND 250 QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, term) <= 12")
def k04(t):
    v, n = stored(t, STATEMENTS)
    body = S.postings(v, "body_tokens")
    return S.rarest(body, S.weights(body, n), 12, 2, 250, False).select("id", "term")


@R.add("k11_informative_terms", f"WITH {V} SELECT id, term FROM bp JOIN bd USING (term) WHERE df > 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, term) <= 10")
def k11(t):
    v, n = stored(t, STATEMENTS)
    body = S.postings(v, "body_tokens")
    return S.rarest(body, S.weights(body, n), 10, 2, 1 << 30, False).select("id", "term")


QUESTION = "q AS (SELECT p_partkey AS id, p_partkey AS native_id, p_name AS title, string_split(p_name, ' ') AS tt, [lower(p_brand)] AS pt, string_split(lower(p_type), ' ') AS st FROM part), fi AS (SELECT id, term, max(w) AS weight FROM (SELECT id, unnest(tt) AS term, 5.0 AS w FROM q UNION ALL SELECT id, unnest(pt), 2.0 FROM q UNION ALL SELECT id, unnest(st), 0.5 FROM q) GROUP BY 1, 2), d AS (SELECT term, ln(1 + (SELECT count(*) FROM q)::DOUBLE / count(*)) AS idf FROM fi GROUP BY 1), qu AS (SELECT s_suppkey AS qid, (SELECT p_name FROM part WHERE p_partkey = s_suppkey) AS text FROM supplier)"


@R.add("k06_search", f"WITH {QUESTION}, h AS (SELECT qid, fi.id, idf * weight AS s FROM (SELECT DISTINCT qid, unnest(string_split(text, ' ')) AS term FROM qu) JOIN d USING (term) JOIN fi USING (term) UNION ALL SELECT qid, q.id, 30 FROM qu JOIN q ON lower(title) = text), g AS (SELECT qid, id, round(sum(s), 6) AS score FROM h GROUP BY 1, 2) SELECT qid, id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM g QUALIFY rn <= 20")
def k06(t):
    p = t("part")
    questions = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("native_id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("title_tokens"), F.array(F.lower("p_brand")).alias("topic_tokens"), F.split(F.lower("p_type"), " ").alias("statement_tokens"))
    asked = t("supplier").join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("qid"), F.col("p_name").alias("text"), F.array_distinct(F.split("p_name", " ")).alias("tokens"))
    out = search.search(questions, asked, p.count())
    return out.select("qid", "id", F.round("score", 4).alias("score"), F.col("rn").cast("long").alias("rn"))


def page_inputs(t):
    """Every row of part as a problem and as a page, and the idf of the titles."""
    p = t("part")
    problems = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), F.split("p_name", " ").alias("title_tokens"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("desc_tokens"))
    pages = p.select(F.col("p_partkey").alias("page"), F.col("p_brand").alias("source"), F.split("p_name", " ").alias("title_tokens"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tokens"))
    return pages, problems, S.title_idf(S.postings(p.select(F.col("p_partkey").alias("id"), F.lit("x").alias("platform"), F.split("p_name", " ").alias("tokens")), "tokens"), F.lit(p.count()))


MATCHES = """p AS (SELECT p_partkey AS id, p_brand AS source, list_distinct(string_split(p_name, ' ')) AS tt0, string_split(p_name, ' ') AS tl, string_split(lower(p_type), ' ') AS dl, string_split(lower(p_name || ' ' || p_type), ' ') AS al FROM part),
own AS (SELECT id, source, list_filter(tl, lambda x, i: list_position(tl, x) = i) AS t, list_filter(dl, lambda x, i: list_position(dl, x) = i) AS d, list_filter(al, lambda x, i: list_position(al, x) = i) AS a FROM p),
idf AS (SELECT term, ln((SELECT count(*) + 1 FROM p)::DOUBLE / (count(*) + 1)) + 1 AS w FROM (SELECT id, unnest(t) AS term FROM own) GROUP BY 1),
kind AS (SELECT DISTINCT t, d, a FROM own), nk AS (SELECT row_number() OVER () AS k, * FROM kind), of AS (SELECT own.id, own.source, k FROM own JOIN nk USING (t, d, a)),
tt AS (SELECT k, unnest(t) AS term FROM nk), dd AS (SELECT k, unnest(d) AS term FROM nk), aa AS (SELECT k, unnest(a) AS term FROM nk),
tb AS (SELECT DISTINCT k, t[i] || ' ' || t[i + 1] AS g FROM nk, range(1, len(t)) r(i)), db AS (SELECT DISTINCT k, d[i] || ' ' || d[i + 1] AS g FROM nk, range(1, len(d)) r(i)), ab AS (SELECT DISTINCT k, a[i] || ' ' || a[i + 1] AS g FROM nk, range(1, len(a)) r(i)),
tw AS (SELECT k, sum(coalesce(w, 1)) AS total FROM tt LEFT JOIN idf USING (term) GROUP BY 1), dw AS (SELECT k, sum(coalesce(w, 1)) AS total FROM dd LEFT JOIN idf USING (term) GROUP BY 1),
th AS (SELECT x.k AS page, y.k AS other, sum(coalesce(w, 1)) AS hit, count(*) AS n FROM tt x JOIN tt y USING (term) LEFT JOIN idf USING (term) GROUP BY 1, 2), dh AS (SELECT x.k AS page, y.k AS other, sum(coalesce(w, 1)) AS hit, count(*) AS n FROM aa x JOIN dd y USING (term) LEFT JOIN idf USING (term) GROUP BY 1, 2),
tg AS (SELECT x.k AS page, y.k AS other, count(*) AS n FROM tb x JOIN tb y USING (g) GROUP BY 1, 2), dg AS (SELECT x.k AS page, y.k AS other, count(*) AS n FROM ab x JOIN db y USING (g) GROUP BY 1, 2),
tn AS (SELECT k, count(*) AS n FROM tb GROUP BY 1), dn AS (SELECT k, count(*) AS n FROM db GROUP BY 1),
ts AS (SELECT page, other, hit / total * (1 - exp(-th.n / 1.4)) AS s, coalesce(tg.n, 0) AS g, tn.n AS m FROM th JOIN tw ON tw.k = other LEFT JOIN tg USING (page, other) LEFT JOIN tn ON tn.k = other), ds AS (SELECT page, other, hit / total * (1 - exp(-dh.n / 1.4)) AS s, coalesce(dg.n, 0) AS g, dn.n AS m FROM dh JOIN dw ON dw.k = other LEFT JOIN dg USING (page, other) LEFT JOIN dn ON dn.k = other),
tm AS (SELECT page, other, round(CASE WHEN m > 0 THEN s * 0.7 + g / m * 0.3 ELSE s END, 6) AS t FROM ts), dm AS (SELECT page, other, round(CASE WHEN m > 0 THEN s * 0.7 + g / m * 0.3 ELSE s END, 6) AS d FROM ds),
sc AS (SELECT page, other, coalesce(t, 0) AS t, coalesce(d, 0) AS d, least(1, round(coalesce(t, 0) * 0.75 + coalesce(d, 0) * 0.5, 6)) AS combined FROM tm FULL JOIN dm USING (page, other))"""


@R.add("j08_page_matches", f"WITH {MATCHES} SELECT x.id AS page, y.id AS id, round(combined, 4) AS combined, CASE WHEN combined > 0.6 THEN 'exact' ELSE 'similar' END AS kind FROM sc JOIN of x ON x.k = sc.page JOIN of y ON y.k = sc.other WHERE x.source <> y.source AND (combined >= 0.4 OR t >= 0.4 OR d >= 0.4)")
def j08(t):
    """Pages against problems, scored where a bound allows them to reach the threshold."""
    return P.page_matches(*page_inputs(t), digits=4).select("page", "id", "combined", "kind")


@R.add("j09_k08_distinct_titles")
def j09(t):
    """Greedy and order-dependent, so not for SQL; tests/test_page_matches.py holds it against a plain version."""
    return P.distinct_page_titles(*page_inputs(t))


@R.add("k08_ranked_matches")
def k08(t):
    """The matcher with the catalog's confirmed versions first (a question: parts of one size and type); greedy, so tests/test_page_matches.py holds it against a plain version."""
    p = t("part")
    named = p.select(F.col("p_partkey").alias("k"), F.concat_ws("-", F.col("p_size").cast("string"), "p_type").alias("canonical_id"), F.when(F.col("p_partkey") % 4 == 0, "variant").alias("contract"))
    pages, problems, idf = page_inputs(t)
    return P.ranked_matches(pages.join(named, F.col("page") == F.col("k")).drop("k"), problems.join(named, F.col("id") == F.col("k")).drop("k"), idf)
