"""Line dedup by site against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparklore.llm import lines

SCHEMA = "page_id long, host string, text string, lines string, n_lines string, h1 string"


def brute(rows, ratio, least):
    totals, seen = Counter(h for _, h, _ in rows), defaultdict(Counter)
    for _, h, t in rows:
        seen[h].update(set((t or "").split("\n")))
    out = []
    for i, h, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (h is not None and x.strip(" \t\n\x0b\x0c\r") and totals[h] >= least
                                         and seen[h][x] > 1 and seen[h][x] > ratio * totals[h])]
        out.append((i, h, t if len(kept) == len(parts) else "\n".join(kept), sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in parts),
                    len(parts) - len(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        host = rng.choice(["big.example"] * 6 + ["b.example", "c.example", None])
        body = [rng.choice(["menu", "Menu", "footer é", " ", "", "\t", f"line {rng.randrange(200)}", f"own {i}", "x" * 3000]) for _ in range(rng.randrange(9))]
        rows.append((i, host, "\n".join(body)))
    rows += [(400, "one.example", "menu\nmenu"), (401, "big.example", None), (402, "big.example", ""), (None, "big.example", "menu"), rows[3], rows[3]]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = lines.drop_boilerplate(table, ratio=0.3, least_pages=5)
    assert {"lines", "h1"} <= set(out.columns)
    got = sorted((tuple(r) for r in out.select("page_id", "host", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == brute(rows, 0.3, 5)
    assert lines.drop_boilerplate(table.limit(0)).collect() == []


def test_hosts_and_html(spark):
    urls = {"https://A.example.com/x?y": "a.example.com", "http://u:p@b.example:80/": "b.example", "c.example/x": None, "": None, None: None,
            "https://": None, "ftp://d.example#top": "d.example"}
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["h"] for r in table.select("url", lines.host_of(F.col("url")).alias("h")).collect()} == urls
    html = "<html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><!-- x --><ul><li>a</li><li> b</li></ul><p>one <b>two</b><br>three</body>"
    table = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    assert [r[0] for r in table.select(lines.html_lines(F.col("html"))).collect()] == ["T\na\nb\none two\nthree", None, ""]
