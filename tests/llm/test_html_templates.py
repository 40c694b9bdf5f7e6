import random
import time
from collections import defaultdict
from urllib.parse import urlsplit

import pytest

from terrakiln.llm import html_extract


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div style="overflow:hidden"><p>kept</p></div>', "kept"),
        ('<div data-id="share"><p title="hidden gems">kept</p></div>', "kept"),
        ("<p>it <a title=it's>x</a> don't</p>", "it x don't"),
        ('<p>a <span class="ad">no</span> b</p>', "a b"),
        ('<p class="x" hidden>no</p><p aria-hidden="true">no</p><p aria-hidden="false">yes</p>', "yes"),
        ("<p>one<a href='x", "one"),
        ("<p>a</p><!-- open <p>b", "a"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<article><p>in</p></article><article class=comment><p>out</p></article>", "in"),
    ],
)
def test_what_is_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("part", ["<div>x", "<a ", '<a =">"', "<p>", "<b><p>", "<li>x", "<a", "<td><table><div></td>", "</p></div>", "<!--", "<script>", "&amp;"])
def test_time_is_linear(part):
    took = []
    for size in (100_000, 400_000):
        began = time.process_time()
        html_extract.main_text(part * (size // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2 and took[1] < 4


WORDS = [f"w{i}" for i in range(4000)]


def site(host, pages, draw):
    """Pages of a site without any telling tag or class: three frames, prose of their own, one shared paragraph."""
    say = lambda n: " ".join(draw.choices(WORDS, k=n))
    top, side, low, shared = say(6), say(9), say(7), say(20)
    out = []
    for i in range(pages):
        own = [say(30) for _ in range(4)] + [shared] * (i % 5 == 0)
        article = "".join(f"<p>{x}</p>" for x in own)
        page = f"<div><ul><li>{top}<li>home</ul></div><div><span>{side}</span></div><article>{article}</article><div><p>{low}</p></div>"
        out.append((f"http://{host}/p/{i}", page, "\n\n".join(own)))
    return out


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_templates_without_the_structural_list(spark, broadcast_rows):
    draw = random.Random(4)
    made = site("a.example", 40, draw) + site("b.example", 12, draw) + site("c.example", 2, draw)
    # Frames outside a marked article: without <article> they are told by their counts only.
    made = [(u, p.replace("<article>", "<div>").replace("</article>", "</div>") if i % 2 else p, t) for i, (u, p, t) in enumerate(made)]
    pages = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(made)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html_extract.extract(pages, structural=False, broadcast_rows=broadcast_rows).collect()}
    for i, (u, p, t) in enumerate(made):
        if "c.example" in u and "<article>" not in p:
            assert rows[i].n_template == 0 and len(rows[i].text) > len(t)  # two pages are too few to tell
            continue
        shared = t.split("\n\n")[4:]
        if "<article>" in p:
            assert rows[i].text == t  # prose that other articles share stays
        else:
            assert rows[i].text in (t, "\n\n".join(t.split("\n\n")[:4])) and (rows[i].text == t or shared)
        assert rows[i].n_template == 0 if "c.example" in u else rows[i].n_template >= 3


@pytest.mark.parametrize("structural", [True, False])
def test_counts_against_brute_force(spark, sf, structural):
    draw = random.Random(5)
    rows = [(r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [x[:2] for h in ("a.example", "b.example") for x in site(h, 15, draw)]
    rows += [rows[-1]] * 5 + [(None, None), ("http://x.example", "")]
    on, pages_of = defaultdict(set), defaultdict(set)
    for url, page in rows:
        host = (urlsplit(url or "").hostname or "").lower()
        pages_of[host].add(page or "")
        for own in html_extract.subtree_digests(page, structural):
            on[host, own].add(page or "")
    expected = sorted(own for (host, own), n in on.items() if len(n) >= (10 if own[1] else 3) and len(n) >= (0.5 if own[1] else 0.01) * len(pages_of[host]))
    frame = spark.createDataFrame(rows, "url string, html string")
    got = html_extract.templates(frame, "url", "html", 3, 0.01, 10, 0.5, structural)
    assert sorted((r._subtree, r._prose) for r in got.collect()) == expected and expected


def test_repeated_pages_keep_their_text(spark):
    page = "<div><p>Some text of a page</p><p>and more of it</p></div><div><p>that stays whole</p></div>"
    rows = [(i, "http://a.example/", page) for i in range(5)] + [(9, "http://a.example/x", None), (10, None, page)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.count("\n\n") for r in got} == {**dict.fromkeys(range(5), 2), 9: 0, 10: 2}


def test_names_in_the_way(spark):
    rows = spark.createDataFrame([(1, "u", "<p>x", "old", 7, 8)], "page_id long, url string, html string, Text string, n_chars int, n_template int")
    (row,) = html_extract.extract(rows).collect()
    assert row.asDict() == {"page_id": 1, "url": "u", "html": "<p>x", "text": "x", "n_chars": 1, "n_template": 0}
    with pytest.raises(ValueError, match="_host"):
        html_extract.extract(rows.withColumnRenamed("page_id", "_host"))
