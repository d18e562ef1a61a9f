"""Row cases of the text, URL, date, classifying and source functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import classify as C
from corpusflow.functions import dates as D
from corpusflow.functions import summary as SM
from corpusflow.functions import text as T
from corpusflow.functions import url as U
from corpusflow.operators import blocklist, cluster, feed, forum, merge, state
from corpusflow.sources import feeds, html, jsondocs, logs


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("url, want", [
    ("http://8.8.8.8/a/?utm_source=x&b=1#t", "http://8.8.8.8/a?b=1"), ("https://Example.com", "https://Example.com/"), ("http://10.0.0.1/", None), ("http://127.0.0.1/x", None),
    ("http://169.254.169.254/latest", None), ("http://172.16.0.1/", None), ("http://100.64.1.1/", None), ("http://192.168.1.1/", None), ("http://224.0.0.1/", None), ("http://localhost:80/", None),
    ("http://a.local/", None), ("http://2130706433/", None), ("http://0x7f000001/", None), ("http://[::1]/", None), ("ftp://a.com/", None), ("not a url", None), ("https://a.com/b//", "https://a.com/b"), (None, None),
])
def test_public_url(spark, url, want):
    assert one(spark, U.public_url, url) == want


@pytest.mark.parametrize("value, offset, want", [
    ("2026-05-20T15:30:00", "+07:00", "2026-05-20 08:30:00"), ("2026-05-20 15:30", "Z", "2026-05-20 15:30:00"), ("2026-05-20", "+08:00", "2026-05-19 16:00:00"),
    ("Wed, 20 May 2026 10:00:00 +0000", "Z", "2026-05-20 10:00:00"), ("2026-05-20T15:30:00+09:00", "Z", "2026-05-20 06:30:00"), ("1 Jun 20261 Jun 2026", "Z", None), ("junk", "Z", None), ("", "Z", None), ("1999-12-31", "Z", None), (None, "Z", None),
])
def test_normalize_date(spark, value, offset, want):
    as_of = F.lit("2026-06-01").cast("timestamp")
    assert one(spark, lambda v: F.date_format(D.normalize_date(v, offset, as_of), "yyyy-MM-dd HH:mm:ss"), value) == want


def test_dateline_and_range(spark):
    assert one(spark, D.dateline_date, "TAKERO MINAMIJune 5, 2026 06:15 JSTTOKYO -- x") == "2026-06-05T06:15:00+09:00"
    assert one(spark, D.dateline_date, "June 5, 2026 only") is None
    assert D.date_range(None, "2024-01-10", "x", 92) == ("2024-01-04", "2024-01-10")
    for bad in (("2024-02-01", "2024-01-01"), ("2020-01-01", "2024-01-01"), ("x", "2024-01-01")):
        with pytest.raises(ValueError):
            D.date_range(*bad, "2024-01-01", 92)


@pytest.mark.parametrize("title, want", [
    ("Best wireless earbuds deals", "Best wireless earbuds deals"), ("Top Valvoline Coupons and Promo Codes", "Coupons"), ("Save $50 on TVs", "Save $50"), ("Phone at 20% off", "20% off"),
    ("Giảm giá lớn", "Giảm giá "), ("GIẢM GIÁ SỐC", "GIẢM GIÁ "), ("KHUYẾN MÃI lớn", "KHUYẾN MÃI "), ("MUA NGAY", "MUA NGAY"), ("BEST TV DEALS", "BEST TV DEALS"), ("Trade deal signed by both", None), ("Couponing is old", None), (None, None),
])
def test_promo(spark, title, want):
    assert one(spark, C.promo_phrase, title) == want


@pytest.mark.parametrize("message, kind, retry, status", [
    ("HTTP 503 x", "server_error", True, 503), ("Request timeout", "timeout", True, None), ("read ECONNRESET", "connection", True, None), ("HTTP 404", "not_found", False, 404),
    ("URL must be a public http(s) URL", "invalid_url", False, None), ("429", "rate_limited", True, 429), ("408", "timeout", True, 408), ("DataDome wall", "blocked", True, None), (None, "unknown", True, None), ("code 5031", "unknown", True, None),
])
def test_fetch_errors(spark, message, kind, retry, status):
    assert tuple(one(spark, C.fetch_error, message)) == (kind, retry, status)


def test_tldr_and_markup(spark):
    assert one(spark, T.normalize_tldr, "- **Price** 6.000-7.000 on 25-26/6") == "Price 6.000-7.000 on 25-26/6"
    long = "word " * 60
    short = one(spark, T.normalize_tldr, long)
    assert len(short) <= 200 and short.endswith("word...")
    assert one(spark, T.tldr_from_summary, "This first sentence is long enough to be kept here. Second one.") == "This first sentence is long enough to be kept here."


def test_summary_parse(spark):
    tags = ["AI", "Sports"]
    body = "x" * 130
    got = one(spark, lambda v: SM.parse_output(v, tags), '```json\n{"tldr":"t","hotScore":99,"tags":["ai","AI","x","sports"],"editorialMarkdown":"' + body + '"}\n```')
    assert (got.tldr, got.hot_score, got.tags, got.structured, got.usable) == ("t", 10, ["AI", "Sports"], True, True)
    got = one(spark, lambda v: SM.parse_output(v, tags), "<tldr> old </tldr>" + body)
    assert (got.tldr, got.structured, got.usable, got.editorial_markdown) == ("old", False, True, body)
    assert one(spark, SM.is_repetitive, "10 USD (khoảng 250 nghìn đồng) " * 3) and not one(spark, SM.is_repetitive, "10 USD (khoảng 250 nghìn đồng) " * 2)
    assert one(spark, SM.is_repetitive, "(tức 3 giờ Việt Nam) " * 3) and not one(spark, SM.is_repetitive, "(tức 3 giờ Việt Nam)\n\n" * 3)


def test_similarity_against_a_plain_loop(spark):
    rng = random.Random(0)
    words = ["vụ", "cháy", "ở", "hà", "nội", "khiến", "ba", "người", "a", "b1"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(60)]

    def grams(t):
        return {x for w in t.split() for x in ([w] if len(w) < 2 else [w[i : i + 2] for i in range(len(w) - 1)])} if len(t) >= 2 else set()

    def jac(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", T.jaccard(T.bigram_set(T.similarity_text(F.col("a"))), T.bigram_set(T.similarity_text(F.col("b")))).alias("j")).collect()
    assert all(abs(r.j - jac(grams(r.a), grams(r.b))) < 1e-12 for r in got)
    assert one(spark, lambda v: T.top_keywords(T.similarity_text(v), 2), "bbb aaa aaa bbb ccc") == ["bbb", "aaa"]


def test_clusters_with_title_lock_and_novelty(spark):
    base = "The council voted on the new budget for public schools after a long debate"
    rows = [
        (1, "2024-01-01 00:00:00", base, "one two three four five six seven"), (2, "2024-01-01 01:00:00", base, "completely other words about nothing at all here"),
        (3, "2024-01-01 02:00:00", "Unrelated headline on sports results tonight", "zzz yyy xxx"), (4, "2024-01-01 09:30:00", base, "one two three four five six seven"),
    ]
    df = spark.createDataFrame(rows, "id long, created_at string, title string, raw_excerpt string").withColumn("created_at", F.to_timestamp("created_at")).withColumn("image_url", F.lit(None).cast("string"))
    df = df.withColumn("parent_article_id", F.lit(None).cast("long")).withColumn("summary_status", F.lit("pending"))
    got = {r.id: (r.parent_article_id, r.summary_status) for r in cluster.cluster(df).collect()}
    assert got == {1: (None, "pending"), 2: (1, "skipped"), 3: (None, "pending"), 4: (None, "pending")}
    forum_too = cluster.cluster(df, F.col("id") == 2)
    assert {r.id: r.parent_article_id for r in forum_too.collect()}[2] is None
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id long, parent_article_id long")
    assert {r.parent_article_id for r in cluster.flatten(chain).collect()} == {None, 0}


def test_forum_rules(spark):
    good = "I have been running this setup for two years and it works really well for our team"
    rows = [("t", "a", good, 5, 1, 1), ("t", "b", good.upper(), 9, 1, 2), ("t", "c", "+1", 50, 1, 3), ("t", "d", "word " * 20, 3, 1, 4), ("t", "e", "We moved our whole company to another provider because prices went up a lot", 1, 2, 0)]
    df = spark.createDataFrame(rows, "thread string, author string, body string, reactions int, page int, order int")
    assert [r.author for r in forum.best_comments(df, 5).orderBy("page", "order").collect()] == ["a", "e"]
    gate = forum.thread_gate(df, 5, 3).first()
    assert (gate.comments, gate.useful, gate.skip_reason) == (5, 3, None)
    assert forum.thread_gate(df, 10).first().skip_reason == "few_comments"


def test_blocklist_rules(spark):
    rules = spark.createDataFrame([(1, "cnn.com", "domain"), (2, "bbc.com/sport", "path"), (3, "edition.x.com/*/weather", "path")], "id long, pattern string, type string")
    urls = ["https://www.edition.cnn.com/a", "https://notcnn.com/", "http://bbc.com/sports/x", "http://m.bbc.com/sport", "https://edition.x.com/2026/06/weather/v", "https://edition.x.com/weather", "https://y.com/bbc.com/sport"]
    got = {r.url: r.id for r in blocklist.match(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == {urls[0]: 1, urls[2]: 2, urls[4]: 3, urls[6]: 2}


def test_blocklist_rules_of_every_shape_against_a_loop(spark):
    """Short rules beside long ones, stars in front, in the middle, at the end and alone; no nested loop in the plan."""
    rng = random.Random(7)
    words = ["casino", "news", "a", "ads", "sport", "win-big-today-at-the-tables", "tin", "ñandú", "x.y"]
    urls = ["https://www." + rng.choice(["bbc.com", "m.cnn.com", "t.co"]) + "/" + "/".join(rng.choices(words, k=rng.randint(0, 4))) + rng.choice(["", "?q=casino", "#ads", "/"]) for _ in range(300)]
    patterns = ["a", "t.co/n", "sport/casino", "*casino", "*/ads*tin", "bbc.com/*sport", "*win-big-today-at-the-tables*a", "*ñan", "x.y", "*x.y*", "*.y/t", "m.cnn.com/*/*", "news/tin/a", "zzz", "*zzz", None, ""]
    rules = [(i, p, "path") for i, p in enumerate(patterns)] + [(50, "cnn.com", "domain")]
    schema = "id long, pattern string, type string"

    def loop(rules):
        want = {}
        for u in set(urls):
            host, bare = u.split("/")[2].removeprefix("www."), u.lower().removeprefix("https://").removeprefix("www.")
            hit = [(0, p, i) for i, p, t in rules if t == "domain" and (host == p or host.endswith("." + p))]
            for i, p, t in rules:
                if t == "path" and p:
                    body = "[^?#]*".join(re.escape(x) for x in p.split("*"))
                    if re.match(body, bare) if "*" in p else bare.startswith(p) or "/" + p in bare:
                        hit.append((1, p, i))
            if hit:
                want[u] = min(hit)[2]
        return want

    frame = spark.createDataFrame([(u,) for u in [*urls, None, ""]], "url string")
    for more in ([], [(60, "**", "path"), (61, "*", "path")]):
        out = blocklist.match(frame, spark.createDataFrame(rules + more, schema))
        got = {r.url: r.id for r in out.collect()}
        if more:
            assert got.pop("") == 61
        assert got == loop(rules + more)
        assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert blocklist.match(frame, spark.createDataFrame([], schema)).count() == 0


def test_feed_arguments():
    assert (feed.FeedQuery(page=9999, limit=0).page, feed.FeedQuery(page=9999, limit=0).limit) == (500, 1)
    for bad in ({"tab": "x"}, {"sort": "x"}, {"status": "x"}, {"issue": "x"}, {"min_score": 11}, {"date": "today"}):
        with pytest.raises(ValueError):
            feed.FeedQuery(**bad)


def test_merge(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id long, v string, n int")
    c = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "id long, v string")
    assert sorted(map(tuple, merge.merge(t, c, ["id"]).collect()), key=str) == [(1, "a", 1), (2, "B", 2), (3, "C", None), (None, "N", 3)]
    assert merge.merge(t, c, ["id"], when=F.col("t.n") > 2, insert=False).where("id = 2").first().v == "b"


def test_queue_rules(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [(1, "discovered", "2024-01-01 10:00:00", None), (2, "discovered", "2024-01-01 10:00:00", '{"rescueArticleId":"7"}'), (3, "discovered", "2024-01-01 10:00:00", '{"isManualSave":true}'), (4, "discovered", "2024-01-01 20:00:00", None), (5, "done", "2023-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "id long, status string, created_at string, payload_json string").withColumn("created_at", F.to_timestamp("created_at"))
    assert {r.id for r in state.expire_jobs(df, as_of).where("status = 'skipped'").collect()} == {1}


def test_feeds_and_sitemaps(spark):
    xml = "<rss><item><title><![CDATA[A & B]]></title><link>https://a.com/1</link><description>&lt;img src='https://i.com/x.png'&gt; hi</description></item><item><title>No link</title></item></rss>"
    r = feeds.rss_items(spark.createDataFrame([("f", xml)], "feed string, xml string")).collect()
    assert [(x.title, x.guid, x.snippet) for x in r] == [("A & B", "https://a.com/1", "hi")]
    maps = [("https://a.com/s.xml", "<urlset><url><loc>https://a.com/n-e_w</loc><lastmod>2024-01-01</lastmod></url><url><loc>/old</loc><lastmod>2023-01-01</lastmod></url><url><loc>https://a.com/n-e_w/</loc></url></urlset>"), ("https://a.com/i.xml", "<sitemapindex><sitemap><loc>/s.xml</loc></sitemap></sitemapindex>")]
    df = spark.createDataFrame(maps, "url string, xml string")
    as_of = F.lit("2024-01-02").cast("timestamp")
    got = feeds.expand_sitemaps(df.where("url like '%i.xml'").select("url"), df, as_of).collect()
    assert [(x.url, x.title) for x in got] == [("https://a.com/n-e_w", "n e w")]


def test_xml_reader(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>l</link></item><item><title>B</title></item></channel></rss>")
    assert sorted(r.title for r in feeds.read_items(spark, str(tmp_path / "f.xml")).collect()) == ["A", "B"]


def test_log_files(spark, tmp_path):
    import gzip

    line = '1.2.3.4 - - [10/Jun/2026:14:11:08 +0700] "GET /{} HTTP/1.1" 200 12 "-" "{}"\n'
    (tmp_path / "access.log").write_text(line.format("a", "Mozilla") + "junk\n")
    with gzip.open(tmp_path / "access.log.2.gz", "wt") as f:
        f.write(line.format(".env", "Mozilla") + line.format("b", "curl/8"))
    got = logs.parse_access_log(logs.read_access_log(spark, str(tmp_path / "access.log*"))).collect()
    assert sorted((r.path, r.is_bot) for r in got) == [("/.env", True), ("/a", False), ("/b", True)] and str(got[0].date) == "2026-06-10"


def test_html_trees_and_structured_data(spark):
    page = '<html><body><nav>menu</nav><div class="ad x">buy</div><article><h1>T</h1><p>one <b>two</b></p><div itemprop="articleBody">long body text here</div></article><script type="application/ld+json">[{"@type":"NewsArticle","headline":"H","articleBody":["<p>a</p>","b"]},{"articleBody":"x"}]</script></body></html>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.title for r in html.page_metadata(df).orderBy("page_id").collect()] == ["T", None]
    assert {r.page_id: r.extractor for r in html.page_bodies(df).collect()} == {1: "article", 2: None}
    r = jsondocs.json_ld_articles(df).collect()
    assert [(x.page_id, x.body, x.title) for x in r] == [(1, "a\n\nb", "H")]
    assert html.tree("<div id=a><p class='x y'>q</p></div>").select("#a .y")[0].text() == "q"
    assert one(spark, F.pandas_udf(html.repair_text, "string"), "Ti&#7871;ng Viá»‡t".encode().decode()) is not None
    assert one(spark, F.pandas_udf(html.repair_text, "string"), "cafÃ©") == "café" and one(spark, F.pandas_udf(html.repair_text, "string"), "plain Ä word") == "plain Ä word"
    assert jsondocs.balanced_object('x = 1; window.s = {"a":{"b":"}"}}; y', "window.s") == '{"a":{"b":"}"}}'


def test_a_broken_log_file_does_not_stop_the_others(spark, tmp_path):
    import gzip

    line = '10.0.0.{} - - [05/Jan/2024:00:00:01 +0700] "GET /a HTTP/1.1" 200 1 "-" "Mozilla/5.0"\n'
    (tmp_path / "access.log").write_text(line.format(1))
    whole = gzip.compress("".join(line.format(i) for i in range(2, 200)).encode())
    (tmp_path / "access.log.2.gz").write_bytes(whole)
    (tmp_path / "access.log.3.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "access.log.4.gz").write_bytes(b"no gzip at all")
    got = logs.parse_access_log(logs.read_access_log(spark, str(tmp_path / "access.log*"))).collect()
    assert len(got) >= 199 and {r.ip for r in got} == {f"10.0.0.{i}" for i in range(1, 200)}


def _ld(*docs):
    return "<html>" + "".join(f'<script type="application/ld+json">{d}</script>' for d in docs) + "</html>"


def test_json_ld_forms(spark):
    body = '"articleBody": "{}"'
    pages = [
        (1, _ld('[{"@graph": [[{"@graph": [{"@type": ["Thing", "NewsArticle"], "headline": " deep ", ' + body.format("nested body") + "}]}]]}]")),
        (2, _ld("not json", '{"@type": "Article", "headline": 5, "name": "named", "image": [{"contentUrl": "i.png"}], ' + body.format("second script") + "}")),
        (3, _ld('{"@graph": [{"articleBody": "short"}], "articleBody": ["<p>long one</p>", "of the outer"], "headline": "outer"}')),
        (4, _ld('{"x": {"articleBody": "not descended"}}')),
        (5, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: (r.body, r.title, r.image_url) for r in jsondocs.json_ld_articles(df).collect()}
    assert got == {1: ("nested body", "deep", None), 2: ("second script", "named", "i.png"), 3: ("long one\n\nof the outer", "outer", None)}


@pytest.mark.parametrize("caption, want", [
    ('"https://a/c.vtt"', "https://a/c.vtt"), ('{"url": "u", "contentUrl": "c"}', "u"), ('{"contentUrl": " c "}', "c"), ('[{"name": "x"}, {"contentUrl": "second"}]', "second"),
    ('["", 7, "plain"]', "plain"), ("[]", None), ("null", None), ('{"url": {"a": 1}}', None),
])
def test_json_ld_captions(spark, caption, want):
    page = _ld('{"@graph": [{"@type": ["VideoObject", "Thing"], "name": "n", "caption": ' + caption + '}, {"@type": "Thing", "caption": "no"}]}')
    got = jsondocs.json_ld_video(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(r.title, r.caption_url) for r in got] == [("n", want)]


def test_states_are_tried_in_order(spark):
    next_data, initial = '<script id="__NEXT_DATA__" type="x">{}</script>', "<script>window.__INITIAL_STATE__ = {};</script>"
    found = initial.format('{"a": {"bodyText": "from the last"}}')
    pages = [(1, next_data.format('{"props": 1}') + found), (2, next_data.format("{broken") + found), (3, next_data.format('{"articleBody": "first"}') + found), (4, "none")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert {r.page_id: r.body for r in jsondocs.state_bodies(df).collect()} == {1: "from the last", 2: "from the last", 3: "first"}


def test_fallback_and_longest_text(spark):
    rows = [("a  b " * 3, "x" * 12, None), ("short", "x" * 12, None), ("short", "  y ", None), ("short", "x" * 12, "fetched"), ("content", "x" * 12, ""), (None, None, None)]
    df = spark.createDataFrame(rows, "content string, excerpt string, full string")
    args = F.col("content"), F.col("excerpt")
    got = df.select(T.snippet_fallback(*args, 11).alias("f"), T.longest_text(F.col("full"), *args, 11).alias("t")).collect()
    assert [r.f for r in got] == ["a  b " * 3, "x" * 12, None, "x" * 12, "x" * 12, None]
    assert [r.t for r in got] == ["a  b " * 3, "x" * 12, "short", "fetched", "content", ""]


def test_few_rules_are_broadcast_and_many_shuffled(spark, monkeypatch):
    """What is cut from URLs is not sorted for few rules; the rows are the same either way."""
    urls = spark.createDataFrame([(f"https://h{i % 7}.org/{'ab' * (i % 5)}/x/{i}",) for i in range(60)], "url string")
    rules = spark.createDataFrame([(1, "h1.org", "domain"), (2, "abab/x", "path"), (3, "h3.org/*/x", "path")], "id long, pattern string, type string")
    joins, rows = {}, {}
    for most in (blocklist.FEW_RULES, 2):
        monkeypatch.setattr(blocklist, "FEW_RULES", most)
        out = blocklist.match(urls, rules)
        joins[most] = out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
        rows[most] = sorted(map(tuple, out.collect()))
    assert joins == {200_000: 0, 2: 3} and rows[2] == rows[200_000] != []


def test_hits_of_rules_count_rows_but_join_each_url_once(spark):
    rules = spark.createDataFrame([(1, "a.com", "domain"), (2, "x/", "path"), (3, "none.org", "domain")], "id long, pattern string, type string")
    urls = [("http://a.com/x/1",)] * 500 + [("http://b.com/x/1",)] * 3 + [("http://b.com/x/2",), ("http://c.com/",), (None,)]
    out = blocklist.hits(spark.createDataFrame(urls, "url string").repartition(2), rules)
    assert sorted((r.id, r.hits) for r in out.collect()) == [(1, 500), (2, 4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join Inner, (url"):]
    assert "Aggregate [url" in join.split("RepartitionByExpression [url")[1]  # counted by URL before the rows are dealt to the join
