import random
import re
from collections import Counter, defaultdict

from rookery.operators import identity
from rookery.operators.prefilter import folded


def board_of(url):
    return (url or "").strip().rstrip("/").lower() or None


def sequential(jobs, watchlist, declared, most=8):
    """The same rules, one record after the other, with sets that are put together in memory."""
    links, aliases, counts, watch = defaultdict(set), defaultdict(set), defaultdict(Counter), set()
    for name, url in watchlist:
        key = folded(name)
        watch.add(key)
        counts[key][name] += 1
        if board_of(url):
            links[board_of(url)].add(key)
    for name, url, more in jobs:
        key = folded(name or "")
        if key:
            counts[key][name] += 1
            if board_of(url):
                links[board_of(url)].add(key)
                for a in more or []:
                    if folded(a):
                        aliases[folded(a)].add(board_of(url))
    said = set()
    for url, name, more in declared:
        if board_of(url) in links and folded(name):
            said.add((board_of(url), folded(name)))
            for a in more or []:
                if folded(a):
                    aliases[folded(a)].add(board_of(url))
    for b, key in said:
        links[b].add(key)
    primary = {k for ks in links.values() for k in ks}
    for key, boards in aliases.items():
        if len(boards) == 1 and key not in primary:
            links[next(iter(boards))].add(key)
    group = {}
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    for b, keys in links.items():
        if len(keys) <= most:
            for key in keys:
                group[find("n" + key)] = find("b" + b)
    slug = lambda b: folded(m[1]) if (m := re.match(r"https?://[^/]+/([^/?#]+)", b)) else None
    vouched = {k for _, k in said} | {slug(b) for b, keys in links.items() if slug(b) in keys}
    parts = defaultdict(list)
    for node in list(group):
        if node[0] == "n":
            parts[find(node)].append(node[1:])
    called = {}
    for root, keys in parts.items():
        total = lambda k: sum(counts[k].values())
        pick = min([k for k in keys if k in watch] or [k for k in keys if k in vouched] or [min(keys, key=lambda k: (-total(k), -len(k), k))])
        shown = [(k not in watch, k != pick, not re.search("[A-Z]|[ .,&-]", d), -n, len(d), d) for k in keys for d, n in counts[k].items()]
        called[root] = pick, min(shown)[-1] if shown else pick
    out = []
    for name, url, _ in jobs:
        key = folded(name or "")
        got = (called.get(find("b" + board_of(url))) if board_of(url) else None) or (called.get(find("n" + key)) if key else None)
        out.append(got or (key, name))
    return out


def test_companies_are_those_of_a_sequential_reading(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"{w} {x}".strip() for w in ("Mill", "mill", "Oak Tree", "Zephyr", "north-star", "Blue", "Ace") for x in ("", "Inc", "Labs", "One", "Two")] + ["", None, "slug3", "Slug4"]
        boards = [f"https://jobs.lever.co/{s}" for s in ("mill", "Oak%20Tree", "slug3", "slug4", "zephyr-one", "q1", "q2", "q3", "q4", "q5")] + ["https://big.example/", None, ""]
        jobs = [(rng.choice(names), rng.choice(boards), rng.sample(["ext", "only a", "Mill", "alias b", ""], rng.randint(0, 2)) if rng.random() < 0.8 else None) for _ in range(40)]
        jobs += [(f"Name {i}", "https://big.example", ["x"]) for i in range(9)]
        watchlist = [("Zephyr Two", "https://jobs.lever.co/Q1/"), ("Nobody", None), ("Ace One", "https://jobs.lever.co/q9")]
        declared = [("https://jobs.lever.co/q2", "Declared Co", ["dec", "ext"]), ("https://jobs.lever.co/unseen", "Mill", []), ("https://jobs.lever.co/q3", "", None)]
        df = spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "id long, company string, board string, aliases array<string>")
        got = identity.resolved_companies(df, spark.createDataFrame(watchlist, "name string, careers_url string"), spark.createDataFrame(declared, "careers_url string, name string, aliases array<string>")).orderBy("id").collect()
        assert [(r.company_key, r.company) for r in got] == sequential(jobs, watchlist, declared), seed


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, company string, board string, aliases array<string>")
    assert identity.resolved_companies(none, spark.createDataFrame([], "name string, careers_url string"), spark.createDataFrame([], "careers_url string, name string, aliases array<string>")).count() == 0
