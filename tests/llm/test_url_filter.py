import re

import numpy as np
import pytest

from veilspark.llm import url_filter as U
from veilspark.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else None


@pytest.fixture(scope="module")
def model(spark):
    return U.train(spark)


def check(rows, urls):
    for r in rows:
        host, path = split(urls[r["page_id"]])
        found = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, found[0] if found else None)
        assert r["verdict"] == (found[1] if found else "block" if r["score"] >= 0.5 else "allow")


def test_query(spark, sf, duck):
    urls = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    rows = QUERIES["op6_url_filter"](spark, sf).collect()
    assert len(rows) == len(urls)
    check(rows, urls)
    assert {r["verdict"] for r in rows} == {"allow", "block"}
    frame = QUERIES["op6_url_filter"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_model_holds_on_urls_it_has_not_seen(spark, model):
    bad = ["http://mega-casino.example.net/en/3", "https://pills-online.example.com/en/5", "http://hot-porn.example.net/x", "https://ads-track.example.net/en/6"]
    good = ["http://blog.thering.example.com/en/3", "https://www.thother.example.net/en/8", "https://m.history.example.com/page"]
    made = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    scores = {r["page_id"]: r["score"] for r in U.judge(made, rules=(), model=model).collect()}
    assert all(scores[i] >= 0.5 for i in range(len(bad))) and all(scores[i] < 0.5 for i in range(len(bad), len(bad + good)))


def test_scores_are_those_of_the_weights(spark, model):
    weights, bias = model
    made = spark.createDataFrame([(u,) for u in U.BLOCKED[:5] + U.ALLOWED[:5]], "url string")
    host, path = U.host_and_path(made["url"])
    for r in made.select(U.slots(host, path).alias("s"), U.score(host, path, weights, bias).alias("p")).collect():
        assert len(set(r["s"])) == len(r["s"])
        assert np.isclose(r["p"], 1 / (1 + np.exp(-(bias + sum(weights[k] for k in r["s"])))))


def test_edges(spark, model):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "x://a.example.org/en/12?q#f", "http://example.org/en/2", "http://org/", "http://borg/",
            "http://a.com/fr/", "http://com/de/#x", "http://a.com?/fr/", "http://a.com#/fr/", "//x.org/", "a://b://c.org/", "http://ÉCOLE.org/É", "http://a.org",
            "http://u:p@a.com:80/de/", "http://a.com/de", "http://x\n.com/fr/\ny?z", "http://" + "a" * 30000 + ".org/" + "b" * 30000]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, None, "x", "y"), (None, "http://a.org/", None, None)]
    made = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = U.judge(made, model=model).collect()
    assert len(got) == len(rows)
    check([r for r in got if r["page_id"] is not None], dict(enumerate(urls)))
    assert U.judge(made.limit(0), model=model).count() == 0
