"""URL filters: parts and rules against plain Python, the trees by held-out accuracy."""

import random

from pyspark.sql import functions as F

from almanac.llm import urls

RULES = urls.RULES


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = max(
        ((len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)),
        default=(0, None, None),
    )
    return host, path, best[1], best[2]


def test_parts_and_rules_equal_plain_ones(spark):
    r = random.Random(2)
    parts = ["http://", "://", "example.net", ".", "org", "net", "/", "/en/", "/fr/", "/de/", "?", "#", "EXAMPLE.com", "x", "É", "\n"]
    made = [None, "", "http://net", "http://net/", "HTTP://A.Example.NET/en/1?x=http://y", "http://xnet/"]
    made += ["".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, u, "v", 1.0) for i, u in enumerate(made)], "page_id long, url string, verdict string, length double")
    rows = urls.url_verdicts(df).collect()
    assert len(rows) == len(made) and {r.length for r in rows} == {1.0}
    for row in rows:
        host, path, rule, verdict = plain(row.url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict in ("allow", "block") and (verdict is None or row.verdict == verdict)


def test_trees_learn_labels_they_have_not_seen(spark):
    r = random.Random(6)

    def url(blocked):
        if blocked:
            return f"http://{r.randrange(10**6)}-win.site{r.randrange(99)}.top/{r.randrange(10**8)}?a={r.randrange(99)}&b={r.randrange(99)}&c=1"
        return f"https://www.{r.choice(['news', 'library', 'school'])}.org/{r.choice(['about', 'history', 'pages'])}/{r.choice('abcdef')}"

    rows = [(i, url(i % 2), i % 2) for i in range(1200)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    judged = urls.url_verdicts(df.where("page_id >= 600"), rules=(), labelled=df.where("page_id < 600"), trees=5, depth=3)
    right = judged.where(F.col("verdict") == F.when(F.col("blocked") == 1, "block").otherwise("allow")).count()
    assert right >= 0.95 * 600


def test_labels_of_one_kind_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.url_verdicts(df, rules=()).collect()[0].verdict == "allow"
    assert urls.url_verdicts(df.limit(0)).count() == 0
