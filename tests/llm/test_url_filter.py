import datetime as dt
import random

from pyspark.sql import functions as F

from graphloom.llm import url_filter

D = dt.date


def test_hosts(spark):
    urls = ["http://A.b.Example.com/x", "https://user:pw@h.org:80/?q=1", "ftp://x.y.", "no url", "", None, "http://", "http://h.com?x", "http://h.com#y"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.host_of().alias("h"))
    assert [r["h"] for r in df.collect()] == ["a.b.example.com", "h.org", "x.y", None, None, None, None, "h.com", "h.com"]


def test_intervals(spark):
    e = [("a.com", "x", True, D(2024, 1, 5)), ("a.com", "x", False, D(2024, 2, 1)), ("a.com", "x", True, D(2024, 3, 1)), ("A.com", "x", False, D(2024, 3, 1)), (None, "x", True, D(2024, 1, 1)), ("b.com", None, True, None)]
    got = url_filter.validity_intervals(spark.createDataFrame(e, "entry string, category string, listed boolean, at date"))
    assert sorted(map(tuple, got.collect()), key=str) == [("a.com", "x", D(2024, 1, 5), D(2024, 2, 1)), ("a.com", "x", D(2024, 3, 1), None)]


def brute(captures, events):
    out = []
    for key, url, t in captures:
        host = url.split("/")[2] if url and "://" in url else None
        active = set()
        if host and t:
            p = host.split(".")
            suffixes = {".".join(p[i:]) for i in range(len(p))}
            for entry, cat in {(e[0], e[1]) for e in events if e[0] in suffixes}:
                past = {}
                for x, c, listed, at in events:
                    if (x, c) == (entry, cat) and at <= t:
                        past[at] = past.get(at, False) or listed
                if past and past[max(past)]:
                    active.add((entry, cat))
        out.append((key, url, t, bool(active), len(active), ",".join(sorted({e for e, _ in active})), ",".join(sorted({c for _, c in active}))))
    return sorted(out, key=str)


def test_filter_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "z.b.org", "c.net"]
    day = lambda: D(2023, 12, 1) + dt.timedelta(rng.randrange(500))
    events = [(rng.choice([*hosts, "com"]), rng.choice(["x", "y"]), rng.random() < 0.6, day()) for _ in range(60)]
    captures = [(i, f"http://{rng.choice(hosts)}/p{i % 3}", day()) for i in range(150)] + [(200 + i, "http://a.com/hot", day()) for i in range(100)]
    captures += [(1, None, D(2024, 1, 1)), (2, "http://a.com/", None), (None, "http://b.org/", D(2024, 6, 1)), captures[0], captures[0], (3, "http://" + "a" * 50_000 + ".com/", D(2024, 1, 1))]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date").withColumn("blocked", F.lit("clash")).withColumn("entry", F.lit("clash"))
    e = spark.createDataFrame(events, "entry string, category string, listed boolean, at date")
    got = url_filter.filter_captures(c, e).drop("entry")
    assert sorted(map(tuple, got.collect()), key=str) == brute(captures, events)
    assert url_filter.filter_captures(c.limit(0), e).count() == 0
    assert url_filter.filter_captures(c, e.limit(0)).where("blocked").count() == 0
    no_time = c.withColumn("fetched", F.lit(None).cast("date"))
    assert url_filter.filter_captures(no_time, e).count() == len(captures)
