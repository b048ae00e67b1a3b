"""URL filters: literal logs, and brute force over all captures and entries."""
import datetime as dt
import random

from tijara.llm import url_filters as U

D = dt.date


def entries_of(spark, rows):
    return spark.createDataFrame(rows, "list string, pattern string, day date, action string")


def captures_of(spark, rows):
    return spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(rows)], "capture long, url string, fetched date")


def test_intervals(spark):
    rows = [("l", "domain:a.org", D(2024, 1, 5), "add"), ("l", "domain:a.org", D(2024, 1, 9), "ADD"), ("l", "domain:a.org", D(2024, 2, 1), "remove"),
            ("l", "domain:a.org", D(2024, 3, 1), "remove"), ("l", "domain:a.org", D(2024, 4, 1), "add"), ("l", "domain:b.org", D(2024, 1, 1), "remove"),
            ("l", "domain:b.org", D(2024, 1, 2), "add"), ("l", "domain:b.org", D(2024, 1, 2), "remove"), (None, "domain:c.org", D(2024, 1, 1), "add"),
            ("l", "domain:c.org", None, "add"), ("l", "domain:c.org", D(2024, 1, 1), "move"), ("l", "domain:a.org", D(2024, 1, 5), "add")]
    got = sorted(tuple(r) for r in U.intervals(entries_of(spark, rows)).collect())
    assert got == [("l", "domain:a.org", D(2024, 1, 5), D(2024, 2, 1)), ("l", "domain:a.org", D(2024, 4, 1), None)]


def test_patterns(spark):
    rows = [("HTTPS://user:pw@WWW.Example.org:8080/A/b.html?q=1#x", D(2024, 1, 1)), ("http://a.org", D(2024, 1, 1)), ("mailto:x", None), (None, None), ("", None)]
    c = captures_of(spark, rows)
    got = [set(r.p) for r in c.select("capture", U.patterns(U.host_of(c.url), U.path_of(c.url)).alias("p")).orderBy("capture").collect()]
    assert got[0] == {"domain:www.example.org", "domain:example.org", "host:www.example.org", "url:www.example.org/A/b.html",
                      "path:www.example.org/A", "path:www.example.org/A/b.html"}
    assert got[1] == {"domain:a.org", "host:a.org", "url:a.org"} and got[2:] == [set()] * 3


def brute(captures, entries):
    out = []
    for url, day in captures:
        lists = set()
        for name in {e[0] for e in entries}:
            for pattern in {e[1] for e in entries if e[0] == name}:
                log = sorted((e[2], e[3]) for e in entries if e[:2] == (name, pattern) and day is not None and e[2] <= day)
                if not log or max(a for d, a in log if d == log[-1][0]) != "add":
                    continue
                host, _, path = url.split("//")[1].partition("/")
                kind, _, what = pattern.partition(":")
                if (kind == "domain" and ("." + host).endswith("." + what) or kind == "host" and host == what
                        or kind == "path" and (host + "/" + path + "/").startswith(what + "/") or kind == "url" and host + "/" + path == what):
                    lists.add(name)
        out.append(",".join(sorted(lists)))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "xa.org", "z.net"]
    paths = ["", "p", "p/q", "pq", "p/q/r.html"]
    day = lambda: D(2024, 1, 1) + dt.timedelta(days=r.randrange(60))
    captures = [(f"http://{r.choice(hosts)}/{r.choice(paths)}", day()) for _ in range(300)] + [("http://a.org/p", None)]
    entries = []
    for _ in range(80):
        h, p = r.choice(hosts), r.choice(paths[1:])
        pattern = r.choice([f"domain:{h}", f"host:{h}", f"path:{h}/{p}", f"url:{h}/{p}"])
        entries.append((r.choice("xyz"), pattern, day(), r.choice(["add", "add", "remove"])))
    got = U.judge(captures_of(spark, captures), entries_of(spark, entries)).orderBy("capture").collect()
    assert [g.lists for g in got] == brute(captures, entries)


def test_empty(spark):
    assert U.judge(captures_of(spark, []), entries_of(spark, [])).count() == 0
    got = U.judge(captures_of(spark, [("http://a.org/", D(2024, 1, 1)), (None, None)]), entries_of(spark, [])).collect()
    assert [(g.lists, g.n_entries) for g in got] == [("", 0), ("", 0)]
    plan = U.judge(captures_of(spark, [("http://a.org/", D(2024, 1, 1))]), entries_of(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_closing_dots_are_no_part_of_a_host(spark):
    got = U.judge(captures_of(spark, [("http://Bad.com./x", D(2024, 1, 2)), ("http://bad.com../", D(2024, 1, 2))]),
                  entries_of(spark, [("l", "domain:bad.com", D(2024, 1, 1), "add")])).collect()
    assert [(r.host, r.lists) for r in got] == [("bad.com", "l")] * 2
