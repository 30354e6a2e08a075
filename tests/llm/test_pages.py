import hashlib
import re

import pytest
from helpers import corpus, table, words
from pyspark.sql import functions as F

from folioworks.llm import decontamination, html_text, toxicity

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site name</h2><a href=/>Home</a></header>
<div id="cookie-banner"><p>We use cookies to improve things. Accept them all, please.</p></div><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="layout"><div class="post-content"><h1>A  title</h1><p>First paragraph with some words that make it quite long, and a <a href=x>link</a> inside it.
<div class="ad-slot"><p>Buy this now, it is a great product for everyone around.</p></div><p>Short &amp; sweet.</p><ul><li>one item</li><li>two item</li></ul>
<p hidden>Hidden words that nobody sees, although they are many.</p><p>Second paragraph with enough words to count as text, surely it is.</p></div>
<aside><p>Related things that are long enough to look like content, alas.</p></aside><section class="comments"><p>I really like this article, it says many things that are true.</p></section>
<form><label>Name</label><input></form></div><footer>&copy; 2020 Someone. All rights reserved.</footer></body></html>"""


def test_article_without_the_rest():
    assert html_text.content_blocks(PAGE) == [
        "A title",
        "First paragraph with some words that make it quite long, and a link inside it.",
        "Short & sweet.",
        "one item",
        "two item",
        "Second paragraph with enough words to count as text, surely it is.",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), (None, ""), ("<p", ""), ("plain words only, and an end.", "plain words only, and an end."), ("<div><p>a &lt; b &amp;amp; c", "a < b &amp; c"), ("<!-- x", ""), ("<script>var t='</p>'", ""),
        ("<p class=it's>Hello to everyone here.</p><p>We don't know it yet, do we?", "Hello to everyone here. We don't know it yet, do we?"), ('<p title="x>Hello', "Hello"), ("<p a='b>Some words. <i>c", "Some words. c"),
        ("<p>Some words here. <svg viewBox='0'/> And some more words.</p>", "Some words here. And some more words."), ("<p>Words.<button>Share<p>More", "Words. More")],
)
def test_unfinished_pages(spark, page, text):
    assert html_text.extract_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first()["text"] == text


def test_deep_and_long_pages():
    import time

    start = time.process_time()
    deep = html_text.content_blocks("<div>" * 20_000 + "<p>Some words to read.</p>" + "</div>" * 20_000 + "</b>" * 20_000)
    stray = html_text.content_blocks("<p><div>" + "<span>" * 20_000 + "Some words to read." + "</p>" * 20_000)
    long = html_text.content_blocks("<article>" + "<p>One more paragraph of words, and an end.</p>" * 20_000)
    assert deep == stray == ["Some words to read."] and len(long) == 20_000
    assert time.process_time() - start < 20


#: Pages without article elements; lines marked + are content, - are not.
LABELLED = [
    """<div id=top><a href=/>Home</a> <a href=/news>News</a></div>|-
    <div id=page><h2>How rivers move</h2>|+
    <p>Rivers carry sand and stones for many miles, and leave them where the water slows down.</p>|+
    <div class=sponsored><p>Get your own boat today, with a discount for all readers of this page.</p></div>|-
    <p>After a flood the bed may lie elsewhere.</p>|+
    <blockquote>No man steps in the same river twice.</blockquote>|+
    <ul class=share-links><li><a href=x>Send it to a friend</a><li><a href=y>Print it</a></ul></div>|-
    <div id=comments><p>I have seen such a river myself, and it was as you say it is here.</p></div>|-
    <div class=footer>Some company, some street 12. All rights are reserved by the owners.</div>|-""",
    """<table><tr><td class=leftmenu><a href=1>Start</a><br><a href=2>Contact us</a></td>|-
    <td><h1>Soup</h1>|+
    <p>Cut the carrots, then boil them in water with salt for about half an hour.|+
    <p>Eat it warm.|+
    <form><label>Write to us about this recipe, we read all of it</label></form></td></tr></table>|-
    <div role=contentinfo><p>This site is made by volunteers who do not get any money for it.</p></div>|-""",
]


def test_accuracy_on_labelled_blocks():
    right = total = 0
    for page in LABELLED:
        rows = [line.strip().rsplit("|", 1) for line in page.splitlines()]
        found = html_text.content_blocks("".join(html for html, _ in rows))
        for html, mark in rows:
            text = " ".join(re.sub("<[^>]*>", " ", html).split())
            right, total = right + ((text in found) == (mark == "+")), total + 1
    assert right / total >= 0.9


WRAPPERS = (
    "content with-sidebar|page-with-sidebar|layout has-sidebar|has-header|article-comments-enabled|post-form|search-results|single-post tag-social|main-content ads-free|wrapper nav-fixed"
    "|page-legal|notice-of-meeting|social-policy-article|form-horizontal-article|story subscribe-wall|banner-article|top-stories|td-header-wrap|no-sidebar|site-main cookies-on"
).split("|")
LONG = [f"Paragraph {k} has many words, which are written for people who like long and winding sentences about rivers." for k in range(3)]
SHORT_COMMENTS = "<section class=post-comments><h3>What others say</h3><p>I like this text of yours, it is a very good text for all of us.</p><p>So do I, and once wrote a longer thing that nobody read at all.</p></section>"


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("title", ["<h1>Of rivers</h1>", ""])
def test_names_of_layouts_do_not_take_the_article(name, title):
    page = f"<body><nav><a href=a>Home</a> <a href=b>News</a></nav><div class='{name}'>{title}{''.join(f'<p>{p}</p>' for p in LONG)}</div>{SHORT_COMMENTS}<div class='ad-slot'><p>Buy a boat today, it is cheap and it is good for you.</p></div><footer>© A firm</footer></body>"
    assert html_text.content_blocks(page) == ["Of rivers"] * bool(title) + LONG


#: Whole pages and their texts, written by hand.
WHOLE = {
    """<body><form id="aspnetForm" action="p.aspx"><div class="menu"><ul><li><a href=1>Start</a><li><a href=2>About us</a></ul></div><h1>The old mill</h1>
    <p>The mill stood at the river for three hundred years, until a flood took its wheel away.</p><p>Nobody has built it up again since then, although many have said that they would like to.</p>
    <div id="sidebar"><p>Other places to see around here are the castle and the bridge.</p></div><label>Search</label><input name=q></form></body>""": "The old mill The mill stood at the river for three hundred years, until a flood took its wheel away. Nobody has built it up again since then, although many have said that they would like to.",
    """<body><div id="page" class="hfeed site has-cookie-notice"><div id="cookie-notice"><p>This site sets cookies, as all sites do, and you may say no to some of them.</p></div>
    <div class="entry-content"><h1>Bread</h1><p>Take flour, water and salt, and leave them alone for a whole night in a warm place.</p><div class="share-links"><a href=x>Tell a friend</a> <a href=y>Print</a></div>
    <p>Then bake it.</p></div><div class="related-posts"><p>You may also want to read what we wrote about butter last year.</p></div></div></body>""": "Bread Take flour, water and salt, and leave them alone for a whole night in a warm place. Then bake it.",
    """<body><div class="article-page comments-open"><h1>A short note</h1><p>The library stays closed on Monday, because its roof is being mended by two men.</p></div>
    <div id="comments" class="comments-area"><p>Which two men are these, and why does it take them the whole of a Monday to mend it?</p><p>I have been inside the library last week and there was no hole in its roof that I could see.</p>
    <p>The roof of the library has been mended every single year since I came to live in this town.</p></div></body>""": "A short note The library stays closed on Monday, because its roof is being mended by two men.",
}

WHOLE['<body><div class="ad">Buy this boat today, it is a very good one.</div><article><h1>No.</h1><p>None.</article></body>'] = "No. None."


@pytest.mark.parametrize("page", WHOLE)
def test_whole_pages(page):
    assert " ".join(html_text.content_blocks(page)) == WHOLE[page]


def test_pages_edge_cases(spark):
    pages = spark.createDataFrame([(1, "<p>One text.</p>", 5), (1, "<p>One text.</p>", 5)], "page_id long, html string, found long")
    assert [r["text"] for r in html_text.extract_text(pages).collect()] == ["One text."] * 2
    assert html_text.extract_text(pages).columns == ["page_id", "html", "found", "text"]
    assert html_text.extract_text(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already"):
        html_text.extract_text(pages, out_col="found")


def brute_cut(odds, edges):
    best = None
    for mask in range(1 << len(odds)):
        side = [mask >> i & 1 for i in range(len(odds))]
        cost = sum(z for z, s in zip(odds, side, strict=True) if z > 0 and not s) - sum(z for z, s in zip(odds, side, strict=True) if z < 0 and s) + sum(c for a, b, c in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


def test_cut_is_minimal():
    import random

    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        side = html_text.source_side(odds, edges)
        cost = sum(z for z, s in zip(odds, side, strict=True) if z > 0 and not s) - sum(z for z, s in zip(odds, side, strict=True) if z < 0 and s) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost == pytest.approx(brute_cut(odds, edges))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=10):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        m = min(window, len(own))
        grams = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if own else set()
        for k in range(len(found) - m + 1):
            if tuple(found[k : k + m]) in grams:
                hit.update(range(k, k + m))
                names.add(str(name))
    return len(found), len(hit), sorted(names)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_items_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    texts = corpus()
    long = (texts[0] or "").split(" ")
    items = [(1, " ".join(long[5:30])), (2, texts[3]), (3, "One"), (4, " ".join(long[8:14])), (5, ""), (6, None), (7, words(30, 501)), (8, "TWO words"), (9, " ".join(long[5:30])), (None, words(12, 5))]
    texts = [*texts, f"pre {words(30, 501)} post", f"pre {' '.join(words(30, 501).split(' ')[3:13])} {' '.join(words(30, 501).split(' ')[12:25])}", "one two words one"]
    found = decontamination.find_items(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.select("doc_id", "found", decontamination.hit_words(F.col("found")).alias("n_hit")).collect()
    named = [("null" if i is None else i, t) for i, t in items]
    for r in rows:
        assert (r["found"]["n_words"], r["n_hit"], r["found"]["items"]) == brute_hits(texts[r["doc_id"]], named)


def test_cleaned_texts(spark):
    item = words(20, 1)
    texts = [f"Keep this, {item.upper()}! and that with a few other words, so that most of the whole text is not hit at all by the one item of this test at hand", f"x {item}", "clean text stays as it is", None]
    docs = table(spark, texts)
    rows = decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [0, 2, 3]
    assert rows[0]["text"].startswith("Keep this, ! and that") and rows[1]["text"] == texts[2] and rows[2]["text"] is None
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, none).count() == 4


@pytest.mark.parametrize("block", [1 << 20, 100])
@pytest.mark.parametrize("least", [10, 25])
def test_short_items_are_cut_too(spark, monkeypatch, least, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    short, long = "alpha beta gamma delta", " ".join(f"item{i}" for i in range(30))
    part = " ".join(f"item{i}" for i in range(12))
    rest = words(60, 12)
    texts = [f"{rest} {short} end", f"{rest} {part} end", f"{rest} alpha beta gamma end", f"{rest} {long} end"]
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(table(spark, texts), items, min_words=least).collect()}
    assert got[0] == f"{rest}  end" and got[2] == texts[2] and got[3] == f"{rest}  end"
    assert got[1] == (f"{rest}  end" if least == 10 else texts[1])


def marked_corpus(spark):
    """Two languages; toxic texts hold words of one of two families."""
    texts, labels = [], []
    for i in range(360):
        toxic = i % 6 == 0
        body = words(60, 1000 + i)
        texts.append(f"{body} {'idiotic' if i % 12 else 'grumbelwort'}{'s' * (i % 3)} {body[:40]} {'moronic' if i % 12 else 'grumbelzeug'}" if toxic else body)
        labels.append((i, int(toxic)))
    texts += [None, "", words(6000, 3)]
    return table(spark, texts), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = marked_corpus(spark)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).join(labels.filter("toxic IS NOT NULL"), "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    rows = [(r["toxic"], r["toxicity"]["score"]) for r in scored.collect()]
    assert len(rows) > 80 and all(0 <= s <= 1 for _, s in rows)
    assert sum((s >= 0.7) == bool(y) for y, s in rows) / len(rows) > 0.95
    assert min(s for y, s in rows if y) > max(s for y, s in rows if not y) - 0.5


def test_toxicity_ignores_labels_of_held_out_rows_and_other_columns(spark):
    docs, labels = marked_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    score = lambda d, x: {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score_toxicity(d, toxicity.fit(d, x)).collect()}
    assert score(docs, labels) == pytest.approx(score(moved, flipped))


def test_toxicity_without_examples(spark):
    docs = table(spark, ["a", None])
    labels = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert [r["toxicity"]["evidence"] for r in rows] == [[], []]
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def brute_scores(docs, labels, k=15):
    """Scores by plain TF-IDF vectors, all cosines, votes and a pool-adjacent-violators fit, from the definitions."""
    import math
    from collections import Counter

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts = {i: Counter(w[:5] for w in re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items()}
    own = {r["doc_id"]: r["toxic"] for r in labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~toxicity.held_out(F.col("doc_id"))).collect()}
    toxic = [Counter(set(counts[i])) for i, y in own.items() if y]
    a, b = sum(toxic, Counter()), sum((Counter(set(counts[i])) for i, y in own.items() if not y), Counter())
    df, n = sum((Counter(set(c)) for c in counts.values()), Counter()), len(texts)
    weight = {t: (math.log((1 + n) / (1 + df[t])) + 0.05) * math.log2(2 + a[t] / max(1, b[t])) for t in {*a, *b}}

    def vector(i):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in counts[i].items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors, prior = {i: vector(i) for i in texts}, sum(own.values()) / len(own)

    def vote(i, skip):
        cosines = {j: sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) for j in own if j != skip}
        near = sorted(((c, j) for j, c in cosines.items() if c > 1e-9), reverse=True)[:k]
        return (sum(c * own[j] for c, j in near) + 0.5 * prior) / (sum(c for c, _ in near) + 0.5), near

    left_out = sorted((vote(i, i)[0], y) for i, y in own.items())
    means = [(v, v, 1, float(y)) for v, y in left_out]
    merged = True
    while merged:  # pool neighbours that do not rise
        merged, out = False, []
        for x in means:
            if out and out[-1][3] >= x[3]:
                low, _, w, m = out.pop()
                x, merged = (low, x[1], w + x[2], (w * m + x[2] * x[3]) / (w + x[2])), True
            out.append(x)
        means = out
    at, rate = [v for m in means for v in m[:2]], [m[3] for m in means for _ in range(2)]

    def interpolated(v):
        if v <= at[0] or v >= at[-1]:
            return rate[0] if v <= at[0] else rate[-1]
        i = max(j for j in range(len(at) - 1) if at[j] <= v)
        return rate[i] if at[i + 1] == at[i] else rate[i] + (rate[i + 1] - rate[i]) * (v - at[i]) / (at[i + 1] - at[i])

    scores = {}
    for i in texts:
        v, near = vote(i, None)
        scores[i] = (0.999 * interpolated(v) + 0.001 * v, [c for c, _ in near[:3]])
    return scores


def test_scores_against_brute_force(spark):
    docs, labels = marked_corpus(spark)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    expected = brute_scores(docs, labels)
    assert set(got) == set(expected)
    for i, (score, cosines) in expected.items():
        assert [e["cosine"] for e in got[i]["evidence"]] == pytest.approx(cosines, abs=1e-5)
        assert got[i]["score"] == pytest.approx(score, abs=1e-3), i


def test_extra_columns_and_clashes(spark):
    docs, labels = marked_corpus(spark)
    model = toxicity.fit(docs, labels)
    odd = docs.limit(3).withColumns({"score": F.lit(1), "y": F.lit(2)})
    assert toxicity.score_toxicity(odd, model).columns == [*odd.columns, "toxicity"]
    with pytest.raises(ValueError, match="already"):
        toxicity.score_toxicity(docs.withColumn("toxicity", F.lit(1)), model)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
