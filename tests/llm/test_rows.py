"""Chat rotation and URL rules: edge cases, and random rules against brute force."""

import random

from gristmill.llm import chat, url_filter


def brute_chat(turns):
    """Render each perspective in one pass over the sorted turns."""
    talks = {}
    for conv, turn, role, text in turns:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = {}
    for conv, rows in talks.items():
        for me in {r[2] for r in rows} - {"system"}:
            done, mask = "", []
            for _, _, who, text in sorted(rows):
                done += "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == me else f"<|user name={who}|>\n"
                if who == me:
                    mask.append((len(done), len(done) + len(text) + len("<|end|>\n")))
                done += text + "<|end|>\n"
            out[conv, me] = (done, mask)
    return out


def test_rotation(spark):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["system", "ann", "bob", "é\U0001f600", None]), rng.choice(["", "hi", "é\U0001f600 x\ny", None, "z" * 500])) for c in [*range(8), None] for t in range(rng.randint(0, 9))]
    turns += turns[:5] + [(3, None, "ann", "before all"), (50, 1, "system", "alone")]
    schema = "conv_id long, turn long, role string, text string, speaker string, m long"
    frame = spark.createDataFrame([(*t, "clash", 1) for t in turns], schema)
    got = {(r.conv_id, r.speaker): (r.rendered, [(s.start, s.end) for s in r.mask]) for r in chat.rotate(frame).collect()}
    assert got == brute_chat(turns)
    assert chat.rotate(frame.limit(0)).count() == 0


def brute_url(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate({i: i + 32 for i in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else otherwise


def test_rules(spark):
    rng = random.Random(2)
    labels, paths = ["a", "b", "ab", "c", "com"], ["", "/", "/x", "/x/y", "/xy", "/z"]
    name = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in [(name(), rng.choice(paths)) for _ in range(40)]}.values())
    urls = [f"http://{name().upper() if rng.random() < 0.2 else name()}{rng.choice(paths)}{rng.choice(['', '?q=/x', '#/x', '/'])}" for _ in range(400)]
    urls += [None, "", "no scheme/x", "http://", "http:///x", "://a/x", "ftp://.a/x", "http://a./x", "http://a-b.com/x", "http://é.a/x", "http://a:80/x", "x" * 50_000 + "://a/x", urls[0]]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "clash", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect())
    want = [(i if i % 50 else -1, *brute_url(u, rules)) for i, u in enumerate(urls)]
    assert got == sorted((i, h, p, r or "", v) for i, h, p, r, v in want)
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark, []), "block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_many_rules_of_one_host(spark):
    """10,000 paths behind one host, 300 of them nested in each other, and 23,000 URLs, most of them under that host."""
    rng = random.Random(3)
    deep = ["/d" + "x" * i for i in range(300)]
    paths = {f"/{rng.randint(0, 10**6)}" for _ in range(9_700)} | set(deep)
    rules = [(rng.choice(["allow", "block"]), "hub.example.org", p) for p in paths] + [("block", "org", "/d"), ("block", "org", "/d" + "x" * 290 + "y"), ("allow", "a.hub.example.org", "/")]
    by = {(h, p): v for v, h, p in rules}
    hosts = ["hub.example.org", "a.hub.example.org", "b.hub.example.org", "org", "com"]
    some = sorted(paths)
    urls = [(rng.choice(hosts), rng.choice(some) + rng.choice(["", "/", "7", "y"])) for _ in range(20_000)] + [("hub.example.org", "/same")] * 3_000
    rows = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {}
    for r in url_filter.judge(spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id long, url string"), rows, "none").collect():
        assert r.page_id not in got
        got[r.page_id] = (r.host, r.path, r.rule, r.verdict)
    for i, (host, path) in enumerate(urls):
        labels = host.split(".")
        fits = [(len(h) + n, len(h), h + path[:n], by[h, path[:n]]) for h in (".".join(labels[j:]) for j in range(len(labels))) for n in range(len(path) + 1) if (h, path[:n]) in by]
        best = max(fits, default=(0, 0, None, "none"))
        assert got[i] == (host, path, *best[2:])
    assert len(got) == len(urls)
