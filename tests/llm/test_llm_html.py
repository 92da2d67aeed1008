import random
import time

import pytest

from fraudlens.llm import html_extract as H
from fraudlens.llm.html_lines import lines

SCHEMA = "page_id long, url string, html string, k1 string, host string, text string"


def text(html):
    return H.main_text(html, [])


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<article><h1>A</h1><p>b  <b>c</b>\n d<br>e<p>f</article>", "A b c d e f"),
    ("<nav>x</nav><header>y</header><main><p>m</p></main><aside>z</aside><footer>f</footer>", "m"),
    ("<div class='ad top'>x</div><div id=cookie-notice>y</div><p>m</p><section class=\"user-comments\"><p>c</p></section>", "m"),
    ("<article>t<article class=comment>reader</article>u</article>", "t u"),
    ("<form><p>name</p><input></form><article>t</article>", "t"),
    ("<form id=page><div><nav>n</nav><article><p>t</p></article></div></form>", "t"),
    ("<script>var a='</p><article>x</article>';</script><style>p{}</style><p>t</p>", "t"),
    ("<p>a<!-- <p>b</p> -->c</p>", "ac"), ("<p>a<!-- open", "a"), ("<p>1 < 2 <3 & &lt;b&gt;</p>", "1 < 2 <3 & <b>"),
    ("<p title='a>b' x=\"<\">t</p>", "t"), ("<p title=don't>t</p><p>u's</p>", "t u's"),
    ("<div class=content-with-sidebar><p>t</p></div>", "t"), ("<body class='nav-open'><p>t</p>", "t"),
    ("<p>a&nbsp;b&#x41;&eacute;</p>", "a bAé"), ("<ul><li>a<li>b</ul>", "a b"), ("<P>x</P><NAV>y</NAV>", "x"),
    ("<article><header><h1>t</h1></header><p>u</p><footer>f</footer></article>", "t u"),
    ("<p>read <span class='share-button'>share</span> on</p>", "read on"), ("</div></p>x</article>", "x"),
    ("<title>t</title><noscript>n</noscript><template>q</template><p>x", "x"), ("<script>never closed <p>x", ""),
    ("<p class=notice>n<p>t</p>", "t"), ("<![CDATA[x]]><?php a ?><!DOCTYPE html>t", "t"),
])
def test_markup(html, want):
    assert text(html) == want


def test_hostile_markup_is_read_in_linear_time():
    for piece in ("<", "<!--", "<a title=\"", "<div>", "</x>", "<p class='", "&", "<a b=c ", "<script>"):
        lines(piece * 50_000)
    assert len(lines("<p>x</p>" * 20_000)) == 20_000


@pytest.mark.parametrize("n", [10, 5_000, 300_000])
def test_quoted_values_of_any_length_belong_to_their_tag(n):
    props = "<p>x > y</p> class='x' " * (n // 10)
    assert text(f'<div data-props="{props}" class="ad"><p>buy</p></div><p>t</p>') == "t"
    assert text(f"<div srcdoc='{'<a href=x>' * n}' id=text><p>t</p></div>") == "t"
    assert text(f"""<div data-props="<div class='ad' id='menu'>{'.' * n}"><p>t</p></div>""") == "t"  # values hold no attributes
    assert text("<p>" + "<a b='>" + "x" * n + "<i>t</i>") == "x" * n + "t"  # no quote closes this value


def test_hostile_quotes_are_read_in_linear_time():
    for piece in ('<a b=">" ', "<a b='>\" ", "<a b=\">' =", "<a =\"'>", "<a b=", "<a b= ' > \" =", "=\"><a ='>", "<a\t=\"'"):
        for tail in ("", ">", "\">", "'", "\"", "'>\""):
            start = time.process_time()
            lines(piece * 60_000 + tail)
            assert time.process_time() - start < 5, (piece, tail)


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 20, 0])
def test_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(H, "TABLE_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(1500):
        k = rng.choice([2, 4, 10])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(14))] for _ in range(2))
        at = H.common_subsequence(a, b)
        left = iter(b)
        assert at == sorted(set(at)) and all(a[i] in left for i in at) and len(at) == longest(a, b)


def page(path, body, host="site.example.org", n=0):
    return (n, f"https://{host}{path}", body, "x", "y", "z")


def template(article):
    return f"<div>Welcome to the site</div><div>{article}</div><div>All rights reserved</div>"


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [page(f"/news/{i:02d}.html?x=1", template(f"<p>Story {i} begins here and is told at length.</p><p>More of {i}.</p>"), n=i)
            for i in range(20)]
    rows += [page("/about", template("<p>Another story.</p>"), "other.example.org", 50),
             page("/news/07.html", rows[7][2], n=70),  # a copy of page 7: tells nothing
             (80, None, template("<p>No url.</p>"), "x", "y", "z"), (81, "https://site.example.org/zz", None, "x", "y", "z"),
             (None, "not a url", "<p>t</p>", "x", "y", "z"), rows[3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = H.report(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(20):
        assert by[i].text == f"Story {i} begins here and is told at length. More of {i}.", by[i]
        assert by[i].n_template == 2 and by[i].n_chars == len(by[i].text)
    assert by[70].text == by[7].text
    assert by[50].text == "Welcome to the site Another story. All rights reserved"  # the only page of its host
    assert by[80].text == "Welcome to the site No url. All rights reserved" and by[81].text == ""
    assert H.report(df.limit(0)).collect() == []


def test_runs_of_copies_lose_their_template_lines_alike(spark):
    def told(i):
        return template(f"<p>Story {i} begins here and is told at length, as stories of this host are.</p><p>More of {i}.</p>")

    def near(k):
        return told(7).replace("</p><p>", f"</p><p>Seen {k}.</p><p>")
    rows = [page(f"/n/{i}", told(i), n=i) for i in (5, 6, 8, 9)]
    rows += [page(f"/n/7?x={k}", told(7), n=100 + k) for k in range(5)]  # copies, side by side
    rows += [page(f"/n/7a/{k}", near(k), n=200 + k) for k in range(6)]  # near copies, side by side
    rows += [page("/n/7a/2x", None, n=300)]  # no lines: no neighbour
    # a short page: what it shares is most of it, with either side
    rows += [page("/n/8a", template("<p>Tiny.</p>"), n=400)]
    by = {r.page_id: r for r in H.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(by) == len(rows)
    start = "Story 7 begins here and is told at length, as stories of this host are."
    assert {by[100 + k].text for k in range(5)} == {f"{start} More of 7."}
    for k in range(6):
        assert by[200 + k].text == f"{start} Seen {k}. More of 7." and by[200 + k].n_template == 2
    assert by[400].text == "Tiny." and by[300].text == ""


def test_a_copy_beyond_the_run_is_passed_over():
    chars = [10] * 10
    own = list(range(10))
    copy, other = [*range(9), 99], [0, *range(100, 109)]
    assert H.template_lines(own, chars, "/b", [("/a", copy, 100), None]) == ([], [True, False])
    assert H.template_lines(own, chars, "/b", [("/a", copy, 100), ("/c", other, 100)]) == ([0], [False, False])
    long = [*range(9), *range(100, 200)]
    assert H.template_lines(own, chars, "/b", [("/a", long, 1090), ("/c", long[1:], 1080)])[0] == list(range(1, 9))
    assert H.template_lines(own, chars, "/b", [("/a", long, 1090), None]) == ([], [False, False])


def test_pages_beyond_a_copy_are_reached_in_a_second_pass(spark):
    def of(*ids):
        return "".join(f"<p>line number {i}.</p>" for i in ids)
    rows = [page("/a", of(14, *range(40, 49)), n=1), page("/b", of(30, 31, *range(12, 20)), n=2),
            page("/c", of(*range(10, 18), 32, 33), n=3), page("/d", of(*range(10, 20)), n=4)]
    by = {r.page_id: r for r in H.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    # /c is a copy of /d and ends the run towards /b, which is a copy of /d but none of /c
    assert by[4].n_template == 1 and "number 14." not in by[4].text and "number 15." in by[4].text


def test_articles_may_repeat_each_other(spark):
    same = "<p>A passage that many articles of this host quote in full.</p>"
    rows = [page(f"/a/{i}", f"<nav>m</nav><article><p>own {i} {i}{' and on' * 20}</p>{same}</article><footer>f</footer>", n=i) for i in range(6)]
    got = H.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.text == f"own {r.page_id} {r.page_id}{' and on' * 20} A passage that many articles of this host quote in full." for r in got)
    assert all(r.n_template == 2 for r in got)


def test_url_parts(spark):
    urls = ["HTTP://User@Host.Example.org:80/a/b/?q#f", "https://h/a.html#x", "//h/p", "mailto:x", "", None, "h/p"]
    from pyspark.sql import functions as F
    host, path = H.url_parts(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host, path).collect()]
    assert got[:3] == [("host.example.org:80", "/a/b"), ("h", "/a.html"), ("h", "/p")]
    assert all(h is None for h, _ in got[3:])


def told_plainly(pages):
    """{page_id: (text, n_template)} of pages (id, host, path, [(line, zone)]) whose lines are each
    once in a page and in the same order in all, so that what two pages share is one sequence."""
    def size(ls):
        return sum(len(t) for t, _ in ls)

    def shared(p, q):
        there = {t for t, _ in q[3]}
        return [i for i, (t, _) in enumerate(p[3]) if t in there]

    def chars(p, at):
        return sum(len(p[3][i][0]) for i in at)
    firsts = {}
    for p in sorted((p for p in pages if p[3]), key=lambda p: p[2]):
        firsts.setdefault((p[1], tuple((t, z == "A") for t, z in p[3])), p)
    order = sorted(firsts.values(), key=lambda p: (p[1], p[2]))
    begins = [i == 0 or order[i - 1][1] != p[1] or
              chars(p, shared(p, order[i - 1])) < 0.8 * max(size(p[3]), size(order[i - 1][3])) for i, p in enumerate(order)]

    def before(i):
        while i > 0 and not begins[i]:
            i -= 1
        return i - 1

    def after(i):
        i += 1
        while i < len(order) and not begins[i]:
            i += 1
        return i
    found = {}
    for i, p in enumerate(order):
        sides = [before(i), after(i)]
        while True:
            near = [k for k in sides if 0 <= k < len(order) and order[k][1] == p[1]]
            prefix = {k: len([1 for n in range(min(len(p[2]), len(order[k][2]))) if p[2][:n + 1] == order[k][2][:n + 1]]) for k in near}
            small = [k for k in sorted(near, key=lambda k: (-prefix[k], k)) if chars(p, shared(p, order[k])) < 0.8 * size(p[3])]
            copies = [k for k in near if chars(p, shared(p, order[k])) >= 0.8 * max(size(p[3]), size(order[k][3]))]
            if small or not copies:
                break
            sides = [step(k) if k in copies else k for k, step in zip(sides, (before, after))]
        if small:
            found[i] = set(shared(p, order[small[0]]))
        else:
            found[i] = set(shared(p, order[near[0]])) & set(shared(p, order[near[1]])) if len(near) == 2 else set()
    number = {(p[1], tuple((t, z == "A") for t, z in p[3])): i for i, p in enumerate(order)}
    out = {}
    for n, host, _, ls in pages:
        drop = found[number[host, tuple((t, z == "A") for t, z in ls)]] if ls else set()
        out[n] = (" ".join(t for i, (t, z) in enumerate(ls) if z == "A" or z == "U" and i not in drop),
                  sum(ls[i][1] != "A" for i in drop))
    return out


def test_report_equals_plain_pairing(spark):
    rng = random.Random(21)
    around = {"A": "<article><p>%s</p></article>", "C": "<nav><p>%s</p></nav>", "U": "<div>%s</div>"}
    pages, last = [], {}
    for n in range(400):
        host = rng.choice(["a.example.org", "a.example.org", "b.example.org", f"lone{n}.example.org"])
        pool = [(k, f"{host} line {k} {'word ' * (k % 9)}".strip(), "UUUCA"[k % 5]) for k in range(30)]
        if host in last and rng.random() < 0.4:  # a copy, whole or but for a line
            chosen = [x for x in last[host] if rng.random() < rng.choice([1, 0.95])]
        else:
            chosen = [x for x in pool if rng.random() < rng.choice([0.2, 0.6, 0.8])]
            chosen += [(rng.random() * 30, f"own {n} {k} {'text ' * rng.randint(1, 8)}".strip(), rng.choice("UUA")) for k in range(rng.randint(0, 8))]
        last[host] = chosen = sorted(chosen)
        pages.append((n, host, f"/{n // 20:03d}/{rng.choice('xyz')}{n:04d}", [(t, z) for _, t, z in chosen]))
    want = told_plainly(pages)
    rows = [page(path, "".join(around[z] % t for t, z in ls), host, n) for n, host, path, ls in pages]
    got = {r.page_id: (r.text, r.n_template) for r in H.report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert {n: (got[n], want[n]) for n in want if got[n] != want[n]} == {}
    assert sum(k for _, k in want.values()) > 500 and sum(not k for _, k in want.values()) > 50
