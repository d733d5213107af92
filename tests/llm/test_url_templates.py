import re
from collections import Counter, defaultdict

import pytest

from sangloc.llm import url_templates as ut
from sangloc.llm.queries import RULES, op3_url_templates


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :]).group()


def rule_of(host, path, rules):
    fit = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def by_hand(urls, rules):
    rows = []
    for url in urls:
        host, path = parts(url)
        verdict, rule = rule_of(host, path, rules)
        rows.append([host, path, rule, verdict, [s for s in path.split("/") if s], ""])
    level = -1
    while max(Counter((r[0], r[5]) for r in rows if len(r[4]) > level + 1).values(), default=0) >= ut.LEAST_PAGES:
        level += 1
        children = defaultdict(lambda: defaultdict(Counter))
        for host, _, _, verdict, segments, template in rows:
            if len(segments) > level:
                children[host, template][segments[level]].update(n=1, labelled=verdict is not None, blocked=verdict == "block")
        names = {}
        for parent, kids in children.items():
            total = sum(c["n"] for c in kids.values())
            literal = [(k, c) for k, c in kids.items() if c["n"] >= max(ut.LEAST_PAGES, ut.LEAST_SHARE * total)]
            literal.sort(key=lambda x: (x[1]["labelled"] > 0, (x[1]["blocked"] + 0.5) / (x[1]["labelled"] + 1), x[0]))
            groups = []
            for k, c in literal:
                last = groups[-1][-1][1] if groups else None
                if last is None or (c["labelled"] and not last["labelled"]):
                    new = True
                elif not c["labelled"]:
                    new = False
                else:
                    n, m = c["labelled"], last["labelled"]
                    p = (c["blocked"] + last["blocked"] + 0.5) / (n + m + 1)
                    new = abs(c["blocked"] / n - last["blocked"] / m) > ut.DIFFERENT * (p * (1 - p) * (1 / n + 1 / m)) ** 0.5
                if new:
                    groups.append([])
                groups[-1].append((k, c))
            for g in groups:
                label = g[0][0] if len(g) == 1 else "{" + "|".join(sorted(k for k, _ in g)) + "}"
                names.update({(*parent, k): label for k, _ in g})
        for r in rows:
            if len(r[4]) > level:
                r[5] += "/" + names.get((r[0], r[5], r[4][level]), "*")
    sums = defaultdict(Counter)
    for r in rows:
        r[5] += "/**" if len(r[4]) > level + 1 else ""
        sums[r[0], r[5]].update(labelled=r[3] is not None, blocked=r[3] == "block")
    out = []
    for host, path, rule, verdict, _, template in rows:
        s = sums[host, template]
        purity = (s["blocked"] + ut.PRIOR_PAGES * ut.PRIOR) / (s["labelled"] + ut.PRIOR_PAGES)
        out.append((host, path, rule, verdict or ("block" if purity >= ut.PURITY else "allow"), template, round(purity, 9)))
    return out


def compare(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in ut.judged(pages, rules).collect()}
    want = dict(enumerate(by_hand(urls, rules)))
    assert got == want
    return got


def test_tree_by_hand(spark):
    urls = [f"http://a.net/{lang}/{i}" for lang, n in (("es", 30), ("fr", 20), ("en", 40), ("de", 6), ("xx", 1)) for i in range(n)]
    urls += [f"http://b.net/{i % 3}x/fr/{i}" for i in range(9)] + [f"http://c.net/{'fr' if i % 4 else 'q'}{'/' if i % 2 else ''}{i}" for i in range(60)]
    urls += [f"http://s.net/fr/p{i}?x" for i in range(3)] + [f"http://s.net/k{i}/p" for i in range(4)] + [f"http://t.net/{'fr/' if i < 14 else ''}p{i}" for i in range(16)]
    urls += ["http://d.org/" + "/".join("abcdefghijkl"), None, "", "no scheme", "x://", "HTTP://WWW.Example.COM/En/é#a?b", "a://b://c/d", "http://a.net//es///1\n2/", "http://É.Net/es/1"]
    got = compare(spark, urls + urls[:9], RULES)
    assert any("{" in r[4] for r in got.values()) and any(r[2] is None and r[3] == "block" for r in got.values())


@pytest.mark.parametrize("host,path,want", [("www.example.com", "/en/1", "www.example.com/en/"), ("m.example.com", "/en/1", "example.com/en/"), ("xexample.com", "/en/1", "com/"), ("com", "/", "com/"), ("net", "/es/", "net/es/"), ("a.net", "/es", None), ("a.com", "", None)])
def test_longest_rule(host, path, want):
    assert rule_of(host, path, RULES)[1] == want


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert ut.judged(pages, RULES).count() == 0
    pages = spark.createDataFrame([(None, None), (1, None)], "page_id long, url string")
    assert {(r.host, r.path, r.rule, r.verdict) for r in ut.judged(pages, RULES).collect()} == {("", "", None, "allow")}


def test_query_by_hand(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = dict(zip([p.page_id for p in pages], by_hand([p.url for p in pages], RULES)))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in op3_url_templates(spark, folder).collect()}
    assert got == want


def test_branches_that_part_at_the_ninth_level(spark):
    """The depth of the tree follows from the pages."""
    deep = "a/b/c/d/e/f/g/h"
    rows = [(i, f"http://s.test/{deep}/bad/{i}") for i in range(30)] + [(100 + i, f"http://s.test/{deep}/good/{i}") for i in range(30)]
    rows += [(200, f"http://s.test/{deep}/bad/new"), (201, f"http://s.test/{deep}/good/new")]
    rules = [("s.test", f"/{deep}/bad/{i}", "block") for i in range(30)] + [("s.test", f"/{deep}/good/{i}", "allow") for i in range(30)]
    got = {r.page_id: (r.rule, r.verdict) for r in ut.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[200] == (None, "block") and got[201] == (None, "allow")
