import re

from pyspark.sql import functions as F

from odd_rows import with_clashes
from fitframe.llm.common import hot_join
from fitframe.llm.mixing import mix, mixed_documents
from fitframe.llm.url_filter import judged_urls, line_verdicts, page_outcomes
from fitframe.plans.scratch import Scratch


def test_mixing(spark):
    rows = []
    for source, count, words in (("a", 300, 40), ("b", 60, 25), (None, 20, 10), ("empty", 3, 0)):
        rows += [(len(rows) + i, "word " * words, source) for i in range(count)]
    rows += [(5000, None, "a"), (5000, None, "a")]
    documents = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = mix(documents, ["doc_id", "source"]).collect()
    assert sorted(map(str, found)) == sorted(map(str, mix(documents.repartition(5), ["doc_id", "source"]).collect()))
    assert len(found) == len(rows)
    sizes = {"a": 12000, "b": 1500, None: 200, "empty": 0}
    # Weights by rank: a 3, b 1, empty 2, null 3; 150 % of 13,700 words are asked for, no source more than twice.
    targets = {"a": 20550 - 3000 - 400, "b": 3000, None: 400, "empty": 0}
    for source, size in sizes.items():
        mine = [r for r in found if r["source"] == source]
        assert {r["_mix_total"] for r in mine} == {size}
        assert all(abs(r["_mix_target"] - targets[source]) < 1e-6 for r in mine)
        assert abs(sum(r["_mix_taken"] for r in mine) - targets[source]) <= 1
        assert all(r["_mix_taken"] <= 2 * r["_mix_size"] for r in mine)


def test_mixed_documents(odd_documents, no_documents):
    mixed = mixed_documents(with_clashes(odd_documents))
    assert mixed.columns == with_clashes(odd_documents).columns
    assert mixed.where("doc_id = 7").count() in (1, 2)
    # Texts without words come with complete epochs of their source only, never from a sample.
    taken = mix(odd_documents, ["doc_id"]).where("_mix_size = 0").collect()
    assert all(r["_mix_taken"] == 0 for r in taken)
    whole = mix(odd_documents, ["doc_id"]).where("_mix_size = 0 AND _mix_total > 0 AND _mix_target < _mix_total")
    assert whole.where("_mix_copies > 0").count() == 0
    assert mixed_documents(no_documents).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), match[1]), match[2]) if match else ("", "")
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fit, key=lambda r: len(r[0] + r[1]), default=None)


TEXTS = 40
TAGGED = "<!DOCTYPE html><nav>the same navigation line on every page there is</nav><p>{}</p><b>{}</b>"


def line(text, number):
    return f"line {number} of the text number {text}, \"a\" < b & c > d, long enough"


def page(text):
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    return TAGGED.format(escape(line(text, 0)), "  " + escape(line(text, 1)) + "\n")


def labelled_texts(spark):
    """Even texts are good, odd ones bad; every fourth pair has no label."""
    rows = [(i, f"{line(i, 0)}\n\t{line(i, 1)} \r\nshort") for i in range(TEXTS)] + [(900, None), (901, ""), (None, line(1, 0))]
    documents = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = [(i, 1 - i % 2, 0) for i in range(TEXTS) if i // 2 % 4] + [(2, 1, None), (None, 0, 0), (9999, 0, 0), (900, 0, 0), (3, None, 1)]
    return documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_urls(spark):
    documents, labels = labelled_texts(spark)
    urls = [
        "https://Example.NET/en/a?x#y", "http://www.example.net/en", "http://net/", "http://net", "http://internet/x",
        "ftp://a.b.org/fr/x", "http://example.com/de/#", "http://notexample.com/de/", "no scheme", "", None, "://", "http://h?/a://b",
        "http://example.com/DE/", "http://bad.site/1", "http://good.site/1", "http://long.site/" + "p/" * 200_000,
    ]
    rows = [(i, url, None if i % 2 else "") for i, url in enumerate(urls)]
    rows += [(100 + i, f"http://{'bad' if i % 2 else 'good'}.site/{i}", page(i % TEXTS)) for i in range(200)]
    rows += [(0, urls[0], None), (None, urls[1], page(0)), (None, urls[1], page(0))]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("share", F.lit("x")))
    found = judged_urls(pages, documents, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        url = {i: u for i, u, _ in rows}[r["page_id"]]
        host, path, rule = judged(url)
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule and rule[0] + rule[1])
        if rule:
            assert r["verdict"] == rule[2]
        elif host in ("bad.site", "good.site"):
            assert r["verdict"] == ("block" if host == "bad.site" else "allow")
        else:
            assert r["verdict"] in ("allow", "block")
    none = judged_urls(pages, documents, labels.where("doc_id < 0")).where("rule IS NULL")
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert judged_urls(pages.where("page_id < 0"), documents, labels).count() == 0


def test_blocked_hosts_are_worse_on_texts_without_labels(spark):
    documents, labels = labelled_texts(spark)
    # Each host draws bad texts with a share of its own; a third of all pages is on one host.
    rows, bad = [], {}
    for h in range(30):
        for i in range(400 if h == 7 else 25):
            text = (i * 7 + h) % (TEXTS // 2) * 2 + ((i * 31 + h * 17) % 100 < (90 if h % 3 == 0 else 10))
            rows.append((len(rows), f"http://h{h}.{'xyz'[h % 3]}.example/{i}", page(text)))
            if text // 2 % 4 == 0:
                bad.setdefault(f"h{h}.{'xyz'[h % 3]}.example", []).append(text % 2)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r["host"]: r["verdict"] for r in judged_urls(pages, documents, labels).collect()}
    shares = {v: [sum(bad[h]) / len(bad[h]) for h in bad if verdicts[h] == v] for v in ("block", "allow")}
    assert len(shares["block"]) == 10
    assert min(shares["block"]) > max(shares["allow"]) + 0.2


def test_outcomes_of_pages(spark):
    documents, labels = labelled_texts(spark)
    rows = [("a", page(2)), ("a", page(3)), ("a", page(3)), ("a", page(0)), ("b", None), ("b", ""), ("c", page(2) + page(3))]
    pages = spark.createDataFrame(rows, "host string, html string")
    scratch = Scratch(spark)
    found = page_outcomes(pages, line_verdicts(documents, labels), scratch).collect()
    # Text 0 has no label; a page with as many good as bad passages is good.
    assert sorted(map(tuple, found)) == [("a", 4, 3, 1), ("b", 2, 0, 0), ("c", 1, 1, 1)]


def test_join_over_hot_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionAll(
        spark.sql("SELECT -1L, 5L")
    )
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    for other in (right, right.where("k >= 0")):
        found = hot_join(left, other, "k", sizes, Scratch(spark)).select("k", "id", "v").collect()
        assert sorted(found) == sorted(left.join(other, "k").select("k", "id", "v").collect())
