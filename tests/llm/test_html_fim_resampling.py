"""HTML extraction, fill-in-middle and resampling against brute-force versions."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tallymark.llm import fill_middle, html_text, resampling
from tallymark.session import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __tm_output string, rank string, n long, part string, row string"


def corpus():
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n\n", "no line feed", "a\nb", "a <P> b\nc", "x<S>", "<M>", "<\nP>\n<S\n", "é漢字😀\n😀\x00\n\x1c", " \t\r\n\x0b", "Ab ÀÉ ab_c-9", "z" * 200_000, "q w\n" * 20_000]
    more = "extra", "7", 3, "p", "r"
    rows = [(k, t, "en", f"s{k % 3}", 1, *more) for k, t in enumerate(texts)]
    return rows + [rows[3]] * 5 + [(None, texts[0], None, None, 0, *more), (None, "another text\n" * 30, None, None, 0, *more), (None, None, None, None, 0, *more)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- 11 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def weights():
    return html_text.fit(html_text.labelled([]))


def test_sum_product_against_enumeration():
    rng = np.random.default_rng(0)
    nodes = html_text.Nodes()
    for k, page in enumerate(("<div><p>a<b>b</b><p>c<ul><li>d<li>e</ul></div>f", "<article><h1>x</h1>y</article>")):
        html_text.parse(page, k, nodes, html_text.Static())
    f = html_text.forest(nodes)
    n = len(nodes.parent)
    assert n < 20
    own, edge = rng.normal(size=n) * 2, rng.normal(size=(html_text.N_KINDS, 2, 2))
    p, joint = html_text.marginals(f, own, edge)
    want, pairs = np.zeros(n), np.zeros((n, 2, 2))
    total = 0.0
    for y in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(own[k] * y[k] for k in range(n)) + sum(edge[nodes.kind[k], y[nodes.parent[k]], y[k]] for k in range(n) if nodes.parent[k] >= 0))
        total += weight
        want += weight * np.array(y)
        for k in range(n):
            if nodes.parent[k] >= 0:
                pairs[k, y[nodes.parent[k]], y[k]] += weight
    assert np.abs(p - want / total).max() < 1e-9
    assert np.abs(joint - pairs / total).max() < 1e-9


def test_fit_reaches_a_flat_gradient():
    """At the optimum expected and observed feature counts differ by the penalty alone."""
    nodes, static = html_text.Nodes(), html_text.Static()
    for k in range(12):
        html_text.parse(html_text.Writer(k).page(), k, nodes, static, html_text.marked)
    w = html_text.fit(nodes, rounds=1500, l2=0.5)
    f, y = html_text.forest(nodes), np.array(nodes.label, float)
    p, _ = html_text.marginals(f, html_text.potentials(f, w), w.edge)
    gradient = np.bincount(f.feature, weights=(y - p)[f.owner], minlength=html_text.N_FEATURES) - 0.5 * w.node
    assert np.abs(gradient).max() < 0.05


def test_html_held_out(weights):
    nodes, static = html_text.Nodes(), html_text.Static()
    for k in range(150):
        html_text.parse(html_text.Writer(10**6 + k).page(), k, nodes, static, html_text.marked)
    f = html_text.forest(nodes)
    p, _ = html_text.marginals(f, html_text.potentials(f, weights), weights.edge)
    leaf = np.array([x is not None for x in nodes.text])
    assert ((p[leaf] >= 0.5) == (np.array(nodes.label)[leaf] == 1)).mean() > 0.99


def by_rule(page):
    """What the driver's pages hold in their article, which is flat."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in parts if x)


def test_html_on_the_tables_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == by_rule(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


PAGE = """<!doctype html><HTML><head><title>t</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-banner"><p>We use cookies on this site to track you.</p><button>OK</button></div>
<main><h1>The &eacute;t&eacute; &amp; after</h1><p>First&nbsp;paragraph   with <b>bold</b> and
 <a href="x">a link</a>, and some more words that say things.<script>var a = "</p>";</script>
<p>Second paragraph, which is not closed, has AT&ampT in it &#x41;&#66; and goes on for a while.
<aside class="advert"><p>Buy this now, cheap.</p></aside>
<ul><li>An item of the article.</li><li>Another item of the article.</li></ul>
<form><p>Your name</p><input name="n"><textarea>typed</textarea></form>
<p>Third paragraph &lt;here&gt; ends the text.</p></main>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all, it is all wrong.</p></div></section>
<footer><p>&copy; 2020 Some site</p></footer></body></html>"""


def test_html_by_hand(weights):
    want = ["The été & after", "First paragraph with bold and a link, and some more words that say things.", "Second paragraph, which is not closed, has AT&T in it AB and goes on for a while.", "An item of the article.", "Another item of the article.", "Third paragraph <here> ends the text."]
    assert html_text.texts([PAGE], weights) == ["\n".join(want)]


def test_html_edges(spark, weights):
    broken = ["", None, "plain words only", "<", "<p", "<p>a<p>b</div></b></i>", "<!-- never closed <p>x", "<script>no end", "<a href=\"x>y", "</>", "<div>" * 3000 + "deep", "<p>" + "w " * 50_000, "&am", "<p x='1' x=\"2>\">q"]
    rows = [(k, f"u{k}", x, "e") for k, x in enumerate(broken)] + [(None, None, PAGE, "e")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = html_text.extract(df, weights=weights).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[0] == "" == {r.page_id: r.text for r in got}[1]
    assert len({r.text for r in got if r.page_id is None}) == 1
    assert html_text.extract(df.limit(0), html_text.Settings(made=20, rounds=5)).count() == 0


def test_html_is_linear(weights):
    """Texts that make parsers go back: each about 300 kB."""
    for x in ("<a x=\"" * 50_000, "<" * 300_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 40_000, "<!--" * 70_000, "</div>" * 50_000, "<script>" * 40_000, "<li>a" * 50_000):
        assert len(html_text.texts([x], weights)) == 1


# -- 12 ----------------------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 50
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_middle_against_brute_force(docs, empty):
    want = sorted((brute_fim(r[0], r[1]) for r in corpus()), key=repr)
    assert rows_of(fill_middle.digests(docs)) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fill_middle.digests(empty).count() == 0 == fill_middle.transform(empty).count()


def test_fill_middle_twin(docs):
    documents = docs.toArrow()  # noqa: F841  (DuckDB sees it by name)
    got = sorted(map(tuple, duckdb.sql(fill_middle.SQL).fetchall()), key=repr)
    assert got == rows_of(fill_middle.digests(docs))


def test_fill_middle_texts(docs):
    """The transformed table has the other columns as they were, and each text comes back."""
    out = fill_middle.transform(docs)
    assert out.columns == docs.columns
    before = collections.Counter((r[0], r[1] or "", *r[2:]) for r in corpus())
    after = collections.Counter()
    for r in out.collect():
        form = "plain" if not r.text or any(brute_fim(r.doc_id, t)[2] == "plain" for i, t in ((x[0], x[1]) for x in corpus()) if i == r.doc_id and (t or "") == r.text) else "psm" if r.text.startswith("<P>") else "spm"
        after[(r.doc_id, fill_middle.restore(r.text, form), *r[2:])] += 1
    assert before == after


def test_fill_middle_units_and_rates():
    points = np.frombuffer("ab  cd\n\ne f".encode("utf-32-le"), "<u4")
    assert fill_middle.boundaries(points).tolist() == [0, 7, 8, 11]
    assert fill_middle.boundaries(points, "word").tolist() == [0, 4, 8, 10, 11]
    assert fill_middle.boundaries(points, "character").tolist() == list(range(12))
    forms = collections.Counter(fill_middle.cut(k, "a b c d e", fill_middle.Settings(unit="word", rate=40, spm_rate=25)).form for k in range(4000))
    assert abs(forms["plain"] / 4000 - 0.6) < 0.03 and abs(forms["spm"] / (forms["spm"] + forms["psm"]) - 0.25) < 0.04


# -- 13 ----------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(rows, target, s):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def features(t):
        w = WORD.findall(lower(t))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, s.longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % s.buckets
    corpus_n, target_n = collections.Counter(), collections.Counter()
    for texts, into in (([r[1] for r in rows], corpus_n), (target, target_n)):
        for t in texts:
            into.update(map(bucket, features(t)[1]))
    n, m = sum(corpus_n.values()), sum(target_n.values())
    out, able = [], []
    for r in rows:
        words, found = features(r[1])
        weight = sum(math.floor(1000 * math.log((target_n[b] + 1) * (n + s.buckets) / ((corpus_n[b] + 1) * (m + s.buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{s.seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        row = (r[0], len(found), weight, score)
        (able if words >= s.least_words else out).append(row)
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = s.percent * len(able) // 100
    return sorted([(*x, None) for x in out] + [(*x, k + 1 if k < drawn else None) for k, x in enumerate(able)], key=repr)


@pytest.mark.parametrize("s", [resampling.Settings(), resampling.Settings(buckets=97, longest=2, least_words=3, percent=55, block_bytes=500)])
def test_resampling_against_brute_force(spark, docs, s):
    target = ["w1 w2 W3 w4", None, "", "w5 " * 40]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = rows_of(resampling.resample(docs, frame, s))
    assert got == brute_resample(corpus(), target, s)
    assert any(r[4] for r in got)


def test_resampling_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, none).count() == 0
    assert rows_of(resampling.resample(docs, none)) == brute_resample(corpus(), [], resampling.Settings())


def test_resampling_many_equal_rows(spark):
    """Copies of one row, ids included, and of one text: ranks are 1 to n without gaps."""
    rows = [(7, "a " * 30)] * 3000 + [(k, "b " * 30) for k in range(1000)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([("b",)], "text string")).collect()
    assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, 401)) and len(got) == 4000
    assert sorted((tuple(r) for r in got), key=repr) == brute_resample(rows, ["b"], resampling.Settings())


def test_drawn_documents(spark, docs):
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    s = resampling.Settings(percent=30)
    ids = {r.doc_id for r in resampling.resample(docs, target, s).collect() if r.rank is not None}
    out = resampling.drawn_documents(docs, target, s)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((r for r in corpus() if r[0] in ids), key=repr)


def test_resampling_blocks_are_held_a_few_at_a_time(spark, monkeypatch):
    import pyarrow.dataset as ds

    written = []
    monkeypatch.setattr(resampling, "staged", lambda df, tag, **options: written.append(out := staged(df, tag, **options)) or out)
    rows = [(k, " ".join(f"w{(k * 7919 + i * i) % 99991}" for i in range(20_000))) for k in range(120)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert resampling.resample(documents, documents.limit(1)).count() == len(rows)
    sizes = [f.row_group(g).total_byte_size for f in (x.metadata for x in ds.dataset([p.removeprefix("file:") for p in written[0].inputFiles()]).get_fragments()) for g in range(f.num_row_groups)]
    assert len(sizes) > 3 and max(sizes) < 1 << 20 < sum(sizes)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
