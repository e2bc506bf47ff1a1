import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import companies, text, times, urls
from tallyspark.operators import activity, catalog, contests, library, similarity


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(v[0] for v in values.values()) or (1,)], schema).select(column.alias("out")).first().out


def test_clean_text(spark):
    cases = [
        ("<script>x</script>a<sup>2</sup> b<sub>i</sub> &lt;c&gt;", "a^(2) b_(i) <c>"), ("i<n and <b>bold</b>", "i<n and bold"), ("&amp;lt; &#65; &#x110000; &bogus;", "&lt; A &#x110000; &bogus;"),
        ("ﬁ² caf́ x  y", "fi2 caf́".replace("f́", "f́") + " x y"), (None, ""), ("&le;&GE;", "≤≥"),
    ]
    for raw, want in cases:
        import unicodedata

        assert one(spark, text.clean_text(F.col("t")), t=(raw, "string")) == unicodedata.normalize("NFKC", want)


def test_keys_and_tokens(spark):
    assert one(spark, text.title_key(F.lit("A. The Two-Sum, in an Array!"), F.lit("codeforces"))) == "two-sum in array"
    assert one(spark, text.title_key(F.lit("D2. Game"), F.lit("codeforces"))) == "d2 game"
    assert one(spark, text.retrieval_tokens(F.lit("3sum: Largest palindromic classes 12"), False)) == ["three", "sum", "maximum", "palindrome", "classe"]
    stems = one(spark, text.stemmed(F.array(*map(F.lit, ["relational", "hopping", "flies", "agreed", "plastered", "sky", "happy", "rational", "adoption", "controlling", "as"]))))
    assert stems == ["relat", "hop", "fli", "agre", "plaster", "sky", "happi", "ration", "adopt", "control", "as"]
    assert one(spark, text.bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a b", "b c"]
    assert one(spark, text.bigrams(F.array(F.lit("a")))) == []


def test_urls(spark):
    key = lambda p, u: one(spark, urls.problem_key(F.lit(p), F.lit(u)))
    assert key("codeforces", "https://codeforces.com/contest/12/problem/b1") == key("codeforces", "https://codeforces.com/problemset/problem/12/B1") == "codeforces:12:B1"
    assert key("atcoder", "https://atcoder.jp/contests/abc1/tasks/abc1_a/") == "atcoder:abc1_a"
    assert key("leetcode", "https://leetcode.com/problems/two-sum/solutions/?x=1") == "leetcode:two-sum"
    assert key("leetcode", "not a url") == "leetcode:not a url"
    safe = lambda u, p: one(spark, urls.safe_problem_url(F.lit(u), F.lit(p)))
    assert safe("https://leetcode.com/problems/x", "leetcode") and safe("http://leetcode.com/problems/x", "leetcode") is None and safe("https://leetcode.com.evil/x", "leetcode") is None
    assert safe("https://u:p@atcoder.jp/contests/a/tasks/b", "atcoder") is None
    assert one(spark, urls.clean_handle("code360", F.lit("naukri.com/code360/profile/me"))) == "me"
    assert one(spark, urls.clean_handle("atcoder", F.lit("a-b"))) is None
    assert one(spark, urls.import_platform(F.lit("https://leetcode.com/u/me"))) is None


def test_times(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, times.date_key(t("2026-10-08 19:00:00"), "Asia/Kolkata")) == date(2026, 10, 9)
    assert one(spark, times.next_midnight(t("2026-03-07 12:00:00"), "America/New_York")) == datetime(2026, 3, 8, 5)
    assert one(spark, times.next_midnight(t("2026-03-08 12:00:00"), "America/New_York")) == datetime(2026, 3, 9, 4)
    for now, want in (("2026-01-01 00:00:00", "in 1d 3h"), ("2026-01-02 02:00:00", "in 1h 0m"), ("2026-01-02 02:59:30", "in 1m"), ("2026-01-02 03:00:00", "Live"), ("2026-01-02 04:00:00", "Ended")):
        assert one(spark, times.countdown(t("2026-01-02 03:00:00"), t("2026-01-02 04:00:00"), t(now))) == want


def test_streaks_and_calendar(spark):
    days = lambda *ds: spark.createDataFrame([(date.fromisoformat(d), 1) for d in ds], "day date, n int")
    run = lambda df, today: tuple(activity.streaks(df, F.lit(today).cast("date")).first())
    assert run(days("2024-02-28", "2024-02-29", "2024-03-01"), "2024-03-01") == (3, 3)
    assert run(days("2024-02-28"), "2024-03-01") == (0, 1)
    records = spark.createDataFrame([("a", "1", "k1", datetime(2024, 1, 2, 12), None, True), ("a", "2", "k2", datetime(2024, 1, 2, 13), None, True), ("b", "3", "k1", datetime(2024, 1, 2, 1), date(2024, 1, 1), False)], "platform string, id string, key string, ts timestamp, day date, pending boolean")
    calendar = spark.createDataFrame([("a", date(2024, 1, 2), 3)], "platform string, day date, count int")
    accounts = lambda s: spark.createDataFrame([("a", datetime(2024, 1, 2, s))], "platform string, synced_at timestamp")
    counts = lambda s: {r.day.day: r.n for r in activity.daily_activity(records, calendar, accounts(s), "UTC").collect()}
    assert counts(10) == {2: 5, 1: 1} and counts(20) == {2: 3, 1: 1}


def test_exact_groups_and_identities(spark):
    body = "Count every ordered pair of distinct stones whose weights add up to the limit that the keeper of the hall announces today."
    rows = [("a", "x", "Stones", "u", body), ("b", "y", "Stones", "u", body), ("c", "x", "Stones", "u", body), ("d", "x", "Easy stones", "u", body), ("e", "y", "Easy stones", "u", body), ("f", "codeforces", "Halls", "https://codeforces.com/contest/1/problem/A", body), ("g", "codeforces", "Halls", "https://codeforces.com/contest/1/problem/B", body)]
    v = spark.createDataFrame(rows, "id string, platform string, title string, url string, description string").withColumn("fingerprint", F.sha2("description", 256)).withColumn("title_key", text.title_key(F.col("title"), F.col("platform")))
    none = spark.createDataFrame([], "left string, right string")
    ids = lambda blocked: {r.id for r in catalog.exact_groups(v, blocked, spark.createDataFrame([], "id string")).collect()}
    assert ids(none) == {"a", "b", "c"}
    assert ids(spark.createDataFrame([("a", "c")], "left string, right string")) == set()
    members = spark.createDataFrame([("g1", "a", None), ("g1", "b", None), ("g2", "c", None), ("g3", "d", "q_fixed")], "grp string, id string, explicit string")
    before = spark.createDataFrame([("a", "q_old"), ("c", "q_old"), ("d", "q_gone")], "id string, old_id string")
    got = {r.grp: r.question_id for r in catalog.claim_ids(members, before).collect()}
    assert got["g1"] == "q_old" and got["g3"] == "q_fixed" and got["g2"].startswith("q_") and got["g2"] != "q_old"
    after = members.join(spark.createDataFrame(list(got.items()), "grp string, question_id string"), "grp").select("id", "question_id")
    assert {(r.old_id, r.target) for r in catalog.redirects(before, after).collect()} == {("q_gone", "q_fixed")}
    with pytest.raises(ValueError):
        catalog.resolve(spark.createDataFrame([("a", "b"), ("b", "a")], "old_id string, target string"))
    with pytest.raises(Exception):
        catalog.unique_or_fail(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_library(spark):
    rows = [(1, "k1", 1, "Two Sum", "lc", "Easy", ["Array"], False, "q1", "Two Sum (all)", 80.0), (2, "k2", 2, "Two Sums", "gfg", "Hard", ["Graph"], True, "q1", "Two Sum (all)", None), (3, "k3", 3, "Maximum", "lc", "Unknown", ["Array"], False, None, None, 25.0)]
    df = spark.createDataFrame(rows, "id long, key string, pos long, title string, platform string, difficulty string, topics array<string>, is_premium boolean, canonical_id string, canonical_title string, frequency double")
    assert {r.id for r in library.filter_library(df, query="sum two").collect()} == {1, 2}
    assert {r.id for r in library.filter_library(df, topics=["Graph", "Array"], access="free").collect()} == {1, 3}
    solved = spark.createDataFrame([("k2",)], "key string")
    assert {r.id for r in library.filter_library(df, status="solved", solved=solved).collect()} == {1, 2}
    got = sorted((r.title, r.n_versions, r.frequency) for r in library.collapse(df).collect())
    assert got == [("Maximum", 1, 25.0), ("Two Sum (all)", 2, 80.0)]


def test_similarity(spark):
    v = spark.createDataFrame([(1, "a", ["stone"], ["river", "bridge", "cross", "lamp", "weight"], "x"), (2, "b", ["rock"], ["river", "bridge", "cross", "lamp", "weight"], "y"), (3, "b", ["moon"], ["orbit"], "z")], "id long, platform string, title_tokens array<string>, body_tokens array<string>, fingerprint string")
    pairs = similarity.candidate_pairs(v, 3)
    r = similarity.scored_pairs(pairs, v, 3).collect()
    assert [(x.left, x.right, x.title, x.discovery) for x in r] == [(1, 2, 0.0, "statement")]
    many = spark.createDataFrame([(f"l{i}", f"r{i}", "a/b", True, 0.9 - i / 1000) for i in range(50)] + [(f"m{i}", f"s{i}", "a/c", True, 0.1) for i in range(3)], "left string, right string, platform_pair string, cross_platform boolean, score double")
    got = similarity.select_candidates(many, 10).collect()
    assert len(got) == 10 and sum(r.platform_pair == "a/c" for r in got) == 3
    assert similarity.select_candidates(many, 0).count() == 0


def test_exact_groups_are_stars(spark):
    rows = [(i, "a" if i % 2 else "b", ["same", "title"] if i < 40 else ["title", "same"] if i < 45 else [f"t{i}"], ["w"], "print" if i % 3 == 0 else None) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, platform string, title_tokens array<string>, body_tokens array<string>, fingerprint string")
    links = similarity.exact_links(v)
    got = {(r.id, r.channel): (r.representative, r.n_links) for r in links.collect()}
    assert got == {**{(i, "title"): (0, 44) for i in range(45)}, **{(i, "statement"): (0, 19) for i in range(0, 60, 3)}}
    pairs = {(i, j) for j in range(60) for i in range(j) if j < 45 or (i % 3 == 0 and j % 3 == 0)}
    assert {tuple(r) for r in similarity.expanded(links).collect()} == pairs
    assert {tuple(r) for r in similarity.expanded(links, spark.createDataFrame([(48,)], "id long")).collect()} == {p for p in pairs if 48 in p}
    stars = similarity.candidate_links(v, 60)
    assert stars.filter("n_links IS NOT NULL").count() == 59 - 45 + 45 - sum(1 for i in range(45, 60) if i % 3) and stars.filter("left = 0 AND right = 3").first().n_links == 44


def test_companies_and_contests(spark):
    kept, named = companies.split_tags(F.array(*map(F.lit, ["Arrays", "Amazon Microsoft", "FAANG", "Arrays"])), F.lit(None).cast("array<string>"))
    assert one(spark, F.struct(kept.alias("a"), named.alias("b"))).asDict() == {"a": ["Arrays"], "b": ["Amazon", "Microsoft"]}
    c = spark.createDataFrame([("c1", datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 14), "https://x")], "id string, start timestamp, end timestamp, url string")
    none = spark.createDataFrame([], "name string")
    n = lambda now: contests.reminders(c, none, F.lit(now).cast("timestamp")).count()
    assert (n("2024-01-01 10:00:00"), n("2024-01-01 11:30:00"), n("2024-01-01 11:55:00")) == (2, 1, 0)
    rows = spark.createDataFrame([("a", "T", 1000, 2000, 1), ("a", "T2", 1000, 3000, 2), ("b c", "T", 1000, 2000, 3), ("d", "T", 2000, 1000, 4)], "slug string, title string, start_s long, end_s long, pos int")
    assert [r.title for r in contests.normalize(rows, "atcoder").collect()] == ["T2"]


def test_small_tables_are_spread(spark):
    from tallyspark.sources.readers import spread

    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    many = spark.range(100).repartition(spark.sparkContext.defaultParallelism + 3)
    assert spread(many).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism + 3


def test_votes_and_packed_terms_are_those_of_plain_versions(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, rng.choice("abc"), rng.sample(words, rng.randrange(4)), rng.sample(words, rng.randrange(1, 15)), None) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, platform string, title_tokens array<string>, body_tokens array<string>, fingerprint string")
    df = [{w: sum(w in r[c] for r in rows) for w in words} for c in (2, 3)]
    weight = lambda c, w: math.log(1 + 60 / df[c - 2][w])
    voted, place = set(), {r[0]: r[1] for r in rows}
    for i, _, title, body, _ in rows:
        votes = {}
        for c, terms in ((2, sorted(title, key=lambda w: (df[0][w], title.index(w)))[:6]), (3, sorted((w for w in body if df[1][w] > 1), key=lambda w: (df[1][w], w))[:12])):
            for w in terms:
                for r in rows:
                    if w in r[c] and r[0] != i:
                        votes[r[0]] = votes.get(r[0], 0) + (3 if c == 2 else 1) * weight(c, w)
        for p in "abc":
            voted |= {(i, o) for o in sorted((o for o in votes if place[o] == p), key=lambda o: (-round(votes[o], 6), o))[:3]}
    assert {tuple(r) for r in similarity.voted_pairs(v, 60, 3).collect()} == voted
    pairs = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60)], "left long, right long")
    got = {(r.left, r.right): (r.shared, r.statement) for r in similarity.scored_pairs(pairs, v, 60).collect()}
    mass = {r[0]: sum(weight(3, w) for w in r[3]) for r in rows}
    for (i, j), (shared, statement) in got.items():
        both = set(rows[i][3]) & set(rows[j][3])
        assert shared == len(both) and abs(statement - 2 * sum(weight(3, w) for w in both) / (mass[i] + mass[j])) < 1e-6
    assert len(got) > 100


def test_numbers_as_bytes():
    import numpy as np
    import pyarrow as pa

    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 21, (1 << 39) - 1])
    data, sizes = similarity.packed(numbers)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 4, 6]
    assert similarity.unpacked(pa.array([b"", bytes(data[:2]), b"", bytes(data[2:5])], pa.binary()))[1].tolist() == [0, 1, 127, 255]
    assert similarity.unpacked(pa.array([b"", bytes(data[:2]), b"", bytes(data[2:5])], pa.binary()).slice(1))[0].tolist() == [0, 0, 2, 2]


def test_versions_are_judged_without_their_texts(spark):
    long = "word " * 40
    rows = [(i, p, t, f"https://codeforces.com/contest/{c}/problem/A", d, "f", t.lower()) for i, (p, t, c, d) in enumerate([
        ("codeforces", "Some output", 1, long), ("codeforces", "only this", 1, long), ("leetcode", "Hard one", 1, long), ("codeforces", "b2. twice", 2, long), ("leetcode", "outputs", 3, "short"), ("leetcode", "onlyx", 3, long + "example:")])]
    v = catalog.judged(spark.createDataFrame(rows, "id long, platform string, title string, url string, description string, fingerprint string, title_key string"))
    assert not {"description", "title", "url"} & set(v.columns)
    got = {(r.l, r.r): set(r.why) for r in v.alias("a").crossJoin(v.alias("b")).filter("a.id <> b.id").select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), catalog.merge_blockers().alias("why")).collect()}
    why = catalog.REASONS
    assert got[0, 1] == {why[1], why[4], why[5]} and got[1, 0] == {why[1], why[5]} and got[2, 1] == got[1, 2] == {why[1], why[4]}
    assert got[0, 3] == {why[1], why[6]} and got[4, 5] == {why[1], why[2]} and got[5, 4] == {why[1], why[3]}


def test_stems_are_remembered_by_word(spark):
    import inspect

    rng = random.Random(3)
    ends = ["", "s", "sses", "ies", "ss", "eed", "ed", "ing", "y", "ational", "izer", "fulness", "icate", "ement", "sion", "e", "ll", "ated", "bling", "izing", "tted", "ogies", "ousli", "ion"]
    words = list(dict.fromkeys("".join(rng.choice("abdeilnostuyz0") for _ in range(rng.randrange(1, 6))) + rng.choice(ends) for _ in range(3000)))
    table = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stemmed(F.array("w"))[0].alias("s"))
    assert not [(r.w, r.s, text.stem(r.w)) for r in table.collect() if text.stem(r.w) != r.s]
    assert one(spark, text.match_tokens(F.lit("The Running runs, 12 runner-s x2 running"))) == ["run", "runner", "x2"]
    assert "stemmed(" not in inspect.getsource(text.match_tokens)
