import random
import re

import pytest

from tidewell.llm import html_main, licenses
from tidewell.llm.license_templates import TEMPLATES

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="layout"><aside class="sidebar"><p>Side text long long long long</p></aside><main><article class="post post-%d"><h1>Title &amp; more</h1><div class="ad">Buy</div>
<p>First <b>para</b>&nbsp;graph with a > b " quote.<br>line two<p>Second para<!-- hi <p> --> text.<ul><li>one</li><li>two</li></ul><form><input><p>Sign up</p></form>
<p class="share">Share this</p><p>%s</p><section id="comments"><h2>Comments</h2><p>Nice post! I love it so so much, long long comment text.</p></section></article></main></div><footer>&copy; foo</footer>"""
MAIN = 'Title & more\n\nFirst para graph with a > b " quote. line two\n\nSecond para text.\n\none\n\ntwo\n\n%s'
SCHEMA = "page_id long, url string, html string, text string, host string, path string, winners string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def test_main_text(spark):
    rows = [(i, "https://a.example.org/%d" % i, PAGE % (i, "body %d" % i + " word" * 30)) for i in range(12)]
    rows += [(12, "http://A.example.org:80/x", PAGE % (12, "short")), (13, None, None), (14, "odd", ""), (15, None, "just <b>text</b>"), (15, None, "just <b>text</b>"), (16, "http://b.org", "<p>" + "é " * 40_000), (17, "http://b.org", "<div class='x")]
    found = {r["page_id"]: r for r in html_main.main_text(pages(spark, rows)).collect()}
    assert len(found) == 18
    for i in range(12):
        assert found[i]["text"] == MAIN % ("body %d" % i + " word" * 30) and found[i]["url"].endswith(f"/{i}")
    assert found[12]["text"] == MAIN % "short"
    assert found[13]["text"] == found[14]["text"] == found[17]["text"] == "" and found[15]["text"] == "just text"
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert html_main.main_text(pages(spark, [])).collect() == []


def test_pages_follow_their_host(spark):
    page = '<body><div class="box-%d"><p>%s</p></div><div class="tail"><p>%s</p></div>'
    rows = [(i, "http://h.org/%d" % i, page % (i, "main " * 40, "tail " * 5)) for i in range(9)]
    rows.append((9, "http://h.org/9", page % (9, "main", "tail " * 60)))  # alone it would choose the tail
    found = {r["page_id"]: r["text"] for r in html_main.main_text(pages(spark, rows)).collect()}
    assert found[9] == "main" and found[0] == " ".join(["main"] * 40)


PARA = "<p>A sentence of the article, long enough to count.</p>"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<body><form id=page action=x><nav>menu</nav><div class=content><p>Body one.</p><p>Body two.</p></div><input></form></body>", ["Body one.", "Body two."]),
        ("<body><div class=text>" + PARA * 2 + "<form><p>Your name</p></form></div></body>", [PARA[3:-4]] * 2),
        ("<body><div class=wrap><p>Opening words.</p><div class=inner>" + PARA * 9 + "</div></div></body>", ["Opening words.", *[PARA[3:-4]] * 9]),
        ("<body><div class=wrap><h1>Head</h1><div class=opening>" + PARA + "</div><div class=details><p>Rest.</p></div></div></body>", ["Head", PARA[3:-4], "Rest."]),
        ("<body><div class=page><div class=left><a href=x>one</a> <a href=y>two</a></div><div class=inner>" + PARA + "</div></div></body>", [PARA[3:-4]]),
        ("<body>" + "\u0130" * 40 + "<script>x</script><article>" + PARA + "</article></body>", [PARA[3:-4]]),
        ("\u0130" * 11 + "<article><script>var x</SCRIPT ><p>a</p></article><div class=share>gone</div>" + "<style>p{}</style><p>b</p>", ["\u0130" * 11, "a", "b"]),
        ("<article><script>a</scripty></script><p>x <math><mi>y</mi></math></p></article>", ["x y"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
    ],
)
def test_nothing_of_the_article_is_lost(html, want):
    assert html_main.Page(html).extract([]) == "\n\n".join(want)


def test_votes_against_a_recount(spark):
    rng, rows = random.Random(2), []
    for i in range(90):
        kind, words = rng.choice(["a", "a", "b", "c"]), "word " * rng.randrange(20, 40)
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<body><div class='{kind}-{i}'><p>{words}</p></div></body>"))
    cast = {}
    for i, url, html in rows:
        kind = re.search("class='(.)", html)[1]
        cast.setdefault(f"h{i % 3}.org", []).append("body>div" if kind in "abc" else "")
    counted = {h: sorted({p: v.count(p) for p in v}.items(), key=lambda x: (-x[1], x[0])) for h, v in cast.items()}
    got = {r["host"]: r["winners"] for r in html_main.winning_paths(html_main.votes(pages(spark, rows))).collect()}
    assert got == {h: [f">{p}" for p, n in v if n >= html_main.MIN_SHARE * len(cast[h])] for h, v in counted.items()}
    shares = [("h", "p" * (k + 1)) for k, n in enumerate((50, 25, 25, 9, 1)) for _ in range(n)] + [("g", "x")]
    got = {r["host"]: r["winners"] for r in html_main.winning_paths(spark.createDataFrame(shares, "host string, path string")).collect()}
    assert got == {"h": ["p", "pp", "ppp"], "g": ["x"]}


@pytest.mark.parametrize("odd", ["<", "<a", "</", "<!--", "<!", "<a href='x", '<p class="', "&", "&#x;", "<script>", "</script>", "<p/>", "<><>", "\x00<b>", "<div " * 300])
def test_broken_markup(odd):
    for html in (odd, f"<article><p>some text here</p>{odd}", f"{odd}<p>x</p>"):
        assert isinstance(html_main.Page(html).extract([]), str)


LICENSES = "doc_id long, text string, license string, containment double"


def brute_licenses(text, share=0.8):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())
    own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    out = set()
    for name, template in TEMPLATES.items():
        w = re.findall(rb"[a-z0-9\x80-\xff]+", template.encode().lower())
        shingles = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if len(shingles & own) / len(shingles) >= share:
            out.add(name)
    return out


def test_licenses_against_brute_force(spark):
    rng, rows = random.Random(8), []
    for i in range(120):
        filler = [rng.choice(["alpha", "beta", "the", "license", "under", "of", "é"]) for _ in range(rng.randrange(0, 300))]
        at = rng.randrange(len(filler) + 1)
        notice = TEMPLATES[rng.choice(sorted(TEMPLATES))].split()
        if rng.random() < 0.3:
            notice[rng.randrange(len(notice))] = "changed"
        if rng.random() < 0.3:
            notice = [w.upper() for w in notice]
        rows.append((i, " ".join(filler[:at] + (notice if rng.random() < 0.8 else []) + filler[at:])))
    rows += [(200, None), (201, ""), (202, "x " * 60_000 + TEMPLATES["MIT/line"]), (None, TEMPLATES["MIT/line"]), (203, TEMPLATES["MIT/line"]), (203, TEMPLATES["MIT/line"])]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], LICENSES)
    found = {}
    for r in licenses.scan_licenses(df).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert found == {i: w for i, t in rows if (w := brute_licenses(t or ""))}
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_spans_are_bytes_of_the_text():
    text = "é Word. " + TEMPLATES["GPL-3.0/line"] + " more"
    ((name, share, a, b),) = licenses.TemplateIndex(TEMPLATES).scan([b"before", text.encode(), b"after"])[1]
    assert name == "GPL-3.0/line" and share == 1 and text.encode()[a:b].decode() == TEMPLATES["GPL-3.0/line"].rstrip(".")


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        licenses.TemplateIndex({"x": "too short"})


def test_bands_meet_the_collision_bound():
    for top, members, bands in licenses.TemplateIndex(TEMPLATES).classes:
        least = min(len(licenses.TemplateIndex(TEMPLATES).sets[i]) for i in members)
        worst = 0.8 * least / (licenses.WINDOWS * top + 0.2 * least)
        assert 1 - (1 - worst) ** bands >= licenses.COLLIDE


def brute_places(text, share=0.8):
    """Places by a walk over every word of a text, for each template."""
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[a-z0-9\x80-\xff]+", text.lower())]
    words = [text.lower()[a:b] for a, b in spans]
    index = licenses.TemplateIndex(TEMPLATES)
    out = []
    for i, name in enumerate(index.names):
        wanted, top = index.sets[i], 1
        while top < len(wanted):
            top *= 4
        hits = [(k, own) for k in range(len(words) - 4) if (own := tuple(words[k : k + 5])) in wanted]
        start = 0
        while True:
            found = []
            for right in range(start, len(hits)):
                part = hits[start : right + 1]
                while hits[right][0] - part[0][0] > 2 * top or part[0][1] in {w for _, w in part[1:]}:
                    part = part[1:]
                if len({w for _, w in part}) >= share * len(wanted) and (not found or right + 1 - len(part) <= found[0][-1]):
                    found.append((-len({w for _, w in part}), part[-1][0] - part[0][0], right + 1 - len(part), right))
            if not found:
                break
            size, _, left, right = min(found)
            out.append((name, -size / len(wanted), spans[hits[left][0]][0], spans[hits[right][0] + 4][1]))
            start = right + 1
    return sorted(out)


def test_places_are_those_of_a_walk_whatever_the_batches(spark):
    rng, rows = random.Random(12), []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(" ".join(rng.choice(["of", "the", "license", "word", "é"]) for _ in range(rng.randrange(0, 60))))
            notice = TEMPLATES[rng.choice(sorted(TEMPLATES))].split()
            for _ in range(rng.choice([0, 0, 1, 12]) * (len(notice) > 40)):
                notice.insert(rng.randrange(2, 5) if rng.random() < 0.9 else len(notice) // 2, "inserted")
            parts += [" ".join(notice)] * rng.choice([0, 1, 1, 2])
        rows.append((i, " ".join(parts)))
    want = sorted((i, *hit) for i, t in rows for hit in brute_places(t.encode()))
    assert len(want) > 150
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], LICENSES)
    names = ["doc_id", "license", "containment", "start_byte", "end_byte"]
    for tasks in (1, 3, 50):
        assert sorted(tuple(r) for r in licenses.scan_licenses(df.repartition(tasks)).select(*names).collect()) == want
    assert sorted((i, *hit) for i, t in rows for hit in licenses.TemplateIndex(TEMPLATES).scan([t.encode()])[0]) == want


def test_the_best_of_a_place():
    gpl2, agpl = TEMPLATES["GPL-2.0/header"], TEMPLATES["AGPL-3.0/header"]
    text = f"{gpl2} And then. {agpl}".encode()
    index = licenses.TemplateIndex(TEMPLATES)
    hits = index.scan([text])[0]
    best = [h[0] for h, b in zip(hits, index.best_of_place(hits)) if b]
    assert sorted(best) == ["AGPL-3.0/header", "GPL-2.0/header"] and len(hits) > 2


A, B = "The first long part tells what happened in the town that day. " * 6, "The second one says how it went on in the weeks after it. " * 6


@pytest.mark.parametrize(
    "part",
    [
        '<p title="The hidden truth">{}</p>', '<p data-note="display:none is bad">{}</p>', '<section class="side-effects"><p>{}</p></section>',
        '<section id="notice-period"><p>{}</p></section>', '<div class="post-header"><h1>Title</h1><p>{}</p></div>', '<div class="has-sidebar"><p>{}</p></div>',
        '<p>{}</p><h2 id="search-algorithms">Title</h2>', '<p>{}</p><h2 id=navigation>Title</h2>', "<p class=content-text>{}</p>", '<div id="comment-on-the-law"><p>{}</p></div>',
        '<p data-x=\'a "hidden" b\'>{}</p>', '<p hidden=until-found>{}</p>', '<p style="color: red; display: block">{}</p>',
    ],
)
def test_names_that_only_hold_a_word_of_noise(part):
    page = f"<html><body><article>{part.format(A)}<p>{B} Ends with <a title='a hidden gem' href='x'>a link</a> inside.</p></article></body></html>"
    found = html_main.Page(page)
    text = "\n\n".join(t for _, t, _ in found.blocks)
    assert A.strip() in text and B.strip() in text and "a link inside." in text and ("Title" in page) == ("Title" in text)


@pytest.mark.parametrize(
    "opening",
    [
        '<div class="ad">', '<div class="ad-slot-1 x">', '<div id=cookie-banner>', '<div class="site-header">', '<div class=siteFooter>', '<section class="post-comments">', '<ul class="menu-item-12">',
        '<div class="search-box">', '<div role=navigation>', '<div class="related-posts">', '<p class=notice>', '<p hidden>', '<div aria-hidden = "true">', '<div style="Display : None">', '<div class="article-share-buttons">',
        '<div class=header>', '<div class="main-menu">', "<nav>", "<aside>",
    ],
)
def test_names_of_noise(opening):
    tag = re.match("<([a-z]+)", opening)[1]
    page = f"<html><body><article><p>{A}</p>{opening}Buy this now</{tag}><p>{B}</p></article></body></html>"
    text = "\n\n".join(t for _, t, _ in html_main.Page(page).blocks)
    assert A.strip() in text and B.strip() in text and "Buy" not in text
