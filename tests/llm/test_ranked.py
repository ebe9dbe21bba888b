"""Lexical search, page extraction and resampling against brute force."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest

from tessera.llm import extraction, lexical, resampling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lexical_brute(rows, items, k):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(size for *_, size in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked, scores = TERM.findall((text or "").translate(LOWER)), []
        for doc, c, size in docs:
            m = 75 + (25 * size * n) // total
            score = 0
            for t in asked:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        best = sorted(scores)[:k]
        out += [(item, r, doc, -score) for r, (score, _, _, doc) in enumerate(best, 1)]
    return out


@pytest.fixture(scope="module")
def searched(prose):
    draw = random.Random(8)
    rows = list(prose) + [(None, prose[3][1]), prose[5], (2000, "w1 W1, w1-w2\x00w3"), (2001, "!?"), (2002, "ÇA ça Ça")]
    texts = [t for _, t in rows if t and len(t) < 2000]
    items = [(k, " ".join(draw.choice(texts).split()[:25])) for k in range(20)]
    return rows, items + [(50, None), (51, " .."), (52, "unheard"), (53, "w1 w1 W1 zzz"), (None, "w2 ça")]


def test_search(documents, spark, searched, monkeypatch):
    rows, items = searched
    docs = documents(rows).repartition(5)
    schema = "item_id long, text string, doc_id long, rank int, score int, query int"
    asked = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in items + [items[3]]], schema)
    want = sorted(lexical_brute(rows, items, 7), key=str)
    got = sorted(map(tuple, lexical.search(docs, asked, 7).collect()), key=str)
    assert got == want
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 600)  # several blocks
    got = lexical.search(docs, asked, 7, width=8, step=2).collect()  # nearly all terms collide
    assert sorted(map(tuple, got), key=str) == want


def test_search_of_nothing(documents, spark):
    items = spark.createDataFrame([(1, "w1 w2"), (2, None)], "item_id long, text string")
    assert lexical.search(documents([]), items).count() == 0
    assert lexical.search(documents([(1, None), (2, "")]), items).count() == 0
    assert lexical.search(documents([(1, "w1")]), items.limit(0)).count() == 0
    got = lexical.search(documents([(4, "w1"), (3, "w1"), (4, "w1"), (9, "w5"), (8, "w6 w7"), (7, "w8")]), items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [(1, 1, 3), (1, 2, 4), (1, 3, 4)]


def feature_buckets(text):
    w = FEATURE_WORD.findall((text or "").translate(LOWER))
    both = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    return len(w), [zlib.crc32(f.encode()) % 10_000 for f in both]


def resample_brute(rows, target, percent=25, seed=7):
    docs = [(i, *feature_buckets(t)) for i, t in rows]
    s = Counter(b for *_, f in docs for b in f)
    t = Counter(b for text in target for b in feature_buckets(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out, drawable = [], []
    for i, words, f in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if words >= 20:
            drawable.append(out[-1])
    drawable.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(drawable[: percent * len(drawable) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


def test_resampling(documents, spark, searched):
    rows, _ = searched
    rows = rows + [(k, "many " * 25) for k in [70_000] * 300]  # one number on very many rows
    rows += [(3000, "MiXed 12 a1b2 " * 9), (3001, "é" * 500 + " x" * 30)]
    texts = [t for _, t in rows[:15]] + [None, "", "many things"]
    target = spark.createDataFrame([(1, t, 5) for t in texts], "item_id long, text string, bucket int")
    want = resample_brute(rows, texts)
    for segments in (None, 1, 5):
        got = resampling.resample(documents(rows).repartition(4), target, segments=segments)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_segments_stay_even_with_ties(spark):
    rows = spark.range(3000).selectExpr(
        "IF(id < 2500, 7, id) AS doc_id", "IF(id < 2500, 1, id) AS score", "1L AS n_features", "true AS drawable"
    )
    done, n = resampling.ranked(rows.repartition(6), 10)
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    assert n == 3000 and max(sizes) <= 2 * n / 10 + 60
    assert sorted(r["rank"] for r in done.collect()) == list(range(1, 3001))


def test_resampling_of_nothing(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents([]), none).count() == 0
    rows = [(k, t) for k, t in enumerate([None, "", "a b", "c " * 30, "d " * 30, "e " * 30, "f " * 30])]
    assert sorted(map(tuple, resampling.resample(documents(rows), none).collect()), key=str) == resample_brute(rows, [])


PARAGRAPHS = [
    "The first paragraph of the article says a good deal about nothing in particular, at some length.",
    "A second one follows, with a <a href='/x'>link</a> inside &amp; an &eacute; reference.",
    "Third: short.",
    "And the last paragraph closes the text with <b>bold</b> and <i>italic</i> words, and then it ends.",
]
CLEAN = [
    PARAGRAPHS[0],
    "A second one follows, with a link inside & an é reference.",
    PARAGRAPHS[2],
    "And the last paragraph closes the text with bold and italic words, and then it ends.",
]
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(12)) + "</ul>"
JUNK_BEFORE = (
    "<header class='site'><h2>The Site</h2></header><nav><a href='/'>Home</a></nav>" + MENU
    + "<div class='cookie-notice'>We use cookies on this site, and you may accept them all.</div>"
    + "<div class=\"ad\">Buy this thing now, it is very good and cheap.</div><!-- ad > 5 --><script>if (a < b) t = '</p>';</script>"
)
JUNK_AFTER = (
    "<aside><p>Related things that nobody asked for, told at some length.</p></aside>"
    "<section id='comments'><article class='comment'><p>I disagree with all of this, as a reader, at great length, "
    "for many lines and more, so that my comment outgrows the article by far.</p></article></section>"
    "<form><label>Mail</label><input name=m><button>Send</button></form>"
    "<footer>&copy; The Site &middot; all rights</footer>"
)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style></head><body>{JUNK_BEFORE}{body}{JUNK_AFTER}</body></html>"


def test_extraction_of_articles():
    inner = "<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    want = "\n\n".join(["A title", *CLEAN])
    for body in (
        f"<article>{inner}</article>",
        f"<main><div class='wrap'><article class='post no-sidebar'><div>{inner}</div></article></div></main>",
        f"<div id='page'><div class='content'>{inner}</div></div>",
        f"<form action='/'><main>{inner}</main></form>",
        f"<article><header class='entry-header'><h1>A title</h1></header>{inner[16:]}<footer>by me</footer></article>",
        f"<ARTICLE>{inner.replace('</p>', '')}</ARTICLE>",  # unclosed paragraphs
        f"<article>{inner.replace('</h1>', '</h1><div class=advert>Buy now</div>')}</article>",
    ):
        assert extraction.main_text(page(body)) == want, body
    sections = "<article><h1>A title</h1>" + "".join(f"<section><p>{p}</p></section>" for p in PARAGRAPHS) + "</article>"
    assert extraction.main_text(page(sections)) == want


def test_extraction_of_odd_pages():
    text = extraction.main_text
    assert text(None) == text("") == text("  \n ") == text("<p></p>") == text("<script>x") == text(MENU) == ""
    assert text("only words\t of &lt;text&gt;") == "only words of <text>"
    assert text("<p>one<p>two<br>three</p>four<div>five") == "one\n\ntwo three\n\nfour\n\nfive"
    assert text("<p>a &amp b &am c&nbsp;d &#233; &#x;</p></div></p>x<") == "a & b &am c d é &#x;\n\nx<"
    assert text("<p title=\"a > b\" hidden=x>no</p><p title='it>s'>yes</p><p cut") == "yes"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><dl><dt>f<dd>g</dl>").split("\n\n") == list("abcdefg")
    deep = "<div>" * 50_000 + "deep words" + "</div>" * 20_000
    assert text(deep) == "deep words"
    assert text("<p>" + "long " * 100_000) == ("long " * 100_000).strip()
    assert text("<" * 50_000) == "<" * 50_000


class Tree(HTMLParser):
    """A second parser, for well-formed pages only."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = {"tag": "body", "kids": [], "up": None}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "kids": [], "up": self.at}
        self.at["kids"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


def counts(node):
    c = t = lc = lt = 0
    for kid in node["kids"]:
        if isinstance(kid, str):
            c += len("".join(kid.split()))
        else:
            kc, kt, klc, klt = counts(kid)
            link = kid["tag"] == "a"
            c, t, lc, lt = c + kc, t + kt + 1, lc + (kc if link else klc), lt + klt + link
    return c, t, lc, lt


def density(node, body):
    c, t, lc, lt = counts(node)
    if node["tag"] == "a":
        lc, lt = c, max(lt, 1)
    bc, _, blc, _ = counts(body)
    if not blc or not c:
        return c / max(t, 1)
    base = math.log(c / max(c - lc, 1) * lc + blc / max(bc, 1) * c + math.e)
    return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base)


def all_nodes(node):
    return [node] + [n for kid in node["kids"] if not isinstance(kid, str) for n in all_nodes(kid)]


def text_of(node):
    return "".join(kid if isinstance(kid, str) else text_of(kid) for kid in node["kids"])


def path(node):
    return ([] if node["up"] is None else path(node["up"])) + [node]


def content_brute(page):
    body = Tree(page).root
    total = {id(n): sum(density(k, body) for k in n["kids"] if not isinstance(k, str)) for n in all_nodes(body)}

    def best(node):
        return max(all_nodes(node), key=lambda n: total[id(n)])

    threshold = min(density(n, body) for n in path(best(body)))
    marked = [best(n) for n in all_nodes(body) if counts(n)[0] and density(n, body) >= threshold]
    root = body
    for n in all_nodes(body):
        if all(any(m is x for x in path(m2)) for m in [n] for m2 in marked):
            root = n
    return " ".join(text_of(root).split())


def test_extraction_against_brute_force():
    draw = random.Random(3)

    def grow(depth):
        out = []
        for _ in range(draw.randrange(1, 5)):
            if depth == 0 or draw.random() < 0.4:
                words = " ".join("word"[: draw.randrange(2, 5)] for _ in range(draw.choice([2, 5, 40])))
                link = draw.random() < 0.3
                out.append(f"<p>{'<a>' if link else ''}{words} {'</a>' if link else ''}</p>")
            else:
                out.append(f"<div>{grow(depth - 1)} </div>")
        return "".join(out)

    for _ in range(200):
        page = grow(4)
        got = extraction.main_text(page)
        assert " ".join(got.split()) == content_brute(page), page


def test_extraction_of_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", page("<article><p>é x</p></article>"), "t", 4), (None, None, None, None, None), (1, "u", "", "t", 1)]
    got = extraction.extract(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(1, "u", "é x", 3), (None, None, "", 0), (1, "u", "", 0)]
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0
    assert html.unescape("&eacute;") == "é"
