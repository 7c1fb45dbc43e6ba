import random
from urllib.parse import urljoin

import pytest

from orogen.llm import url_filters as u

SCHEMA = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, signs: s[: min([s.find(x) for x in signs if x in s], default=len(s))]
    own = cut(rest, "/?#")
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in own), cut(rest[len(own) :], "?#")


def rule_of(url, rules):
    own_host, own_path = parts(url)
    fits = [(len(r), v == "allow", r, v) for v, r in rules for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (own_host == h or own_host.endswith("." + h)) and own_path.startswith(p)]
    return max(fits)[2:] if fits else None


def key(url):
    scheme, rest = url.split("#")[0].split("://", 1)
    own = rest.split("/")[0].split("?")[0]
    return scheme.lower() + "://" + own.lower() + rest[len(own) :]


def plain(pages, links, rules=u.RULES):
    near = {}
    for a, b in links:
        if all(x and "://" in x for x in (a, b)):
            near.setdefault(key(a), set()).add(key(b))
            near.setdefault(key(b), set()).add(key(a))
    out = []
    for i, url, _ in pages:
        own, seen, todo = rule_of(url, rules), set(), [key(url)] if url and "://" in url else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        found = {r[1] for x in seen for r in [rule_of(x, rules)] if r}
        verdict = own[1] if own else "allow" if not found or "allow" in found else "block"
        out.append((i, *parts(url), own and own[0], verdict, own is None and bool(found)))
    return sorted(out, key=repr)


def judged(spark, rows, **more):
    return sorted((tuple(r) for r in u.judge(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", Host string, own int"), **more).collect()), key=repr)


def test_rules_alone(spark):
    urls = [None, "", "no scheme", "http://", "://com/", "http://com/", "http://com", "HTTP://A.COM/x", "http://xcom/", "http://www.example.com/en/1", "http://m.example.com/en/", "http://example.com/en", "http://a.WWW.example.com/en/?q#f", "http://x.net/es/a", "http://net/fr/", "http://net/de/", "http://a.org/?u=http://x.net/es/", "http://x.net?/es/", "http://İ.com/", "a\nb://x.net/es/\nq", "http://user@x.net/es/", "http://x.net:80/es/"]
    rows = [(i, x, None) for i, x in enumerate(urls)] + [(None, "http://net/es/", "")] * 2
    assert judged(spark, rows) == plain(rows, [])
    assert judged(spark, []) == []


def test_chains_of_aliases(spark):
    r = random.Random(4)
    pages = [(i, f"http{'s' * (i % 2)}://{r.choice(['a.org', 'b.ORG', 'x.net', 'c.io', 'example.com', 'm.net'])}/{r.choice(['en', 'es', 'de'])}/{i}{r.choice(['', '#t', '?p=1'])}", None) for i in range(400)]
    links = [(r.choice(pages)[1], r.choice(pages)[1] if r.random() < 0.8 else f"http://far.net/{r.choice(['es', 'de'])}/{r.randint(0, 9)}") for _ in range(220)]
    links += [(pages[0][1], pages[0][1]), (None, pages[1][1]), ("odd", pages[2][1])]
    redirects = spark.createDataFrame(links, "from_url string, to_url string")
    got = judged(spark, pages, redirects=redirects)
    assert got == plain(pages, links) and {x[4] for x in got if x[5]} == {"allow", "block"}


@pytest.mark.parametrize(
    "html, link",
    [
        ('<link rel="canonical" href="http://x.net/es/1">', "http://x.net/es/1"),
        ("<LINK href='/es/2' data-x=1 REL=canonical />", "/es/2"),
        ('<link href="//x.net/es/?a=1&amp;b=2" rel="alternate canonical">', "//x.net/es/?a=1&b=2"),
        ('<meta http-equiv="refresh" content="0; url=http://x.net/es/3">', "http://x.net/es/3"),
        ("<meta content=\"5;URL='../es/4'\" http-equiv=Refresh>", "../es/4"),
        ('<!-- <link rel="canonical" href="http://x.net/es/5"> -->', None),
        ("<script>'<link rel=\"canonical\" href=\"http://x.net/es/6\">'</script>", None),
        ('<link rel="canonicals" href="http://x.net/es/7">', None),
        ('<meta http-equiv="refresh" content="5">', None),
        ('<link rel="canonical" href="http://[x">', None),
        ('<link rel="canonical" href="">', None),
    ],
)
def test_links_of_pages(spark, html, link):
    base = "http://a.org/x/y.html"
    got = u.page_links(spark.createDataFrame([(base, html + "p" * 10)], "url string, html string")).collect()
    assert [tuple(x) for x in got] == ([(base, urljoin(base, link))] if link else [])


def test_a_page_follows_its_canonical_form(spark):
    html = '<html><link rel="canonical" href="http://x.net/es/1"></html>'
    rows = [(1, "http://a.org/", html), (2, "http://b.com/", html), (3, "http://a.org/#top", None), (4, "http://c.org/", None)]
    assert judged(spark, rows) == plain(rows, [(r[1], "http://x.net/es/1") for r in rows[:2]])  # through http://b.com/ a rule allows a page of the component
    assert [x[4] for x in judged(spark, rows[:1] + rows[2:])] == ["block", "block", "allow"]
