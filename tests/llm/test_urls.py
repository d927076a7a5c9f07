import random

from pyspark.sql import functions as F

from skein.llm import urls
from skein.llm.queries import URL_RULES

URLS = [
    None, "", "nothing", "http://", "https://Example.COM", "http://example.com/", "http://example.com/en", "http://example.com/en/1?x=/fr/", "http://www.example.com/en/1",
    "http://a.www.example.com/en/1#y", "http://notexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://net?/fr/", "http://ÄB.net/fr/", "x://y://z.com/a", "http://com/", "http://.com/", "http://a\n.com/b\nc?d",
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[7], "x", "y")] * 2, "page_id long, url string, host string, rule string")
    got = urls.url_filter(df, URL_RULES).collect()
    assert [tuple(r)[1:] for r in got] == [brute(u, URL_RULES) for u in [*URLS, URLS[7], URLS[7]]]
    assert urls.url_filter(df.limit(0), URL_RULES).count() == 0
    assert all(r["verdict"] == "block" and r["rule"] is None for r in urls.url_filter(df, [], default="block").collect())


def test_a_list_in_shards(spark):
    """More rules than one filter may have bits for; urls of any length; repeated rows."""
    r = random.Random(9)
    rules = [urls.Rule(("allow", "block")[i % 2], f"h{i}.org", "/") for i in range(300)] + list(URL_RULES)
    found = [f"http://{'a.' * r.randrange(3)}h{r.randrange(600)}.org/{'x' * r.randrange(5)}" for _ in range(400)] + URLS + [f"http://{'s.' * 30_000}example.com/en/{'y' * 100_000}"] * 2
    df = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    got = urls.url_filter(df, rules, max_bits=1024).collect()
    assert sorted(map(str, got)) == sorted(map(str, urls.url_filter(df, rules).collect()))
    assert [tuple(x)[1:] for x in sorted(got)] == [brute(u, rules) for u in found]


def test_cascade_is_exact(spark):
    r = random.Random(4)
    keys = [f"k{r.randrange(10**9)}" for _ in range(3000)]
    listed = set(keys[:400])
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    chosen = spark.createDataFrame([(k,) for k in listed], "key string")
    cascade = urls.build_cascades({"x": chosen, "none": chosen.limit(0)}, universe, universe_size=len(keys))["x"]
    assert len(cascade.levels) >= 3
    got = {k for k, inside in universe.select("key", cascade.contains(F.col("key"))).collect() if inside}
    assert got == listed


def test_native(spark):
    plan = urls.url_filter(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
