"""Text operators against plain Python on whole small tables and on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import fingerprint, html, jaccard, quality, queries, substrings, textops, toxicity
from proofloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997} x{i}" for i in range(40_000))
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "ONE two"), (6, LONG), (7, LONG + " tail"), (None, "one two"), (8, "a b c d e f g h i j k l m n o p"), (9, "x a b  c d\te f\ng h i j k l m y"), (10, "é ü 漢字 \U0001f600 z"), (11, "And " * 500)]
KINDS = "doc_id long, text string, tid long, n int, g string, c long"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(d, t, 1, 2, "g", 3) for d, t in AWKWARD], KINDS)


def rows_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]


# --- n-gram Jaccard join
def sets(docs):
    out = []
    for d, t in docs:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()))
    return out


def linked(docs):
    own = sets(docs)
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            a, b = own[i][1], own[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(own):
        if d is not None:
            low[find(i)].append(d)
    return [(d, len(s), min(low[find(i)], default=None) if s else d) for i, (d, s) in enumerate(own)]


def order(rows):
    return sorted(rows, key=str)


def test_jaccard_awkward_rows(awkward, spark):
    got = [tuple(r) for r in jaccard.link(awkward).select("doc_id", "n_shingles", "component_id").collect()]
    assert order(got) == order(linked(AWKWARD))
    assert jaccard.link(awkward.limit(0)).collect() == []


def test_jaccard_near_copies_and_common_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    base, passage = word(90), word(60)
    docs = []
    for i in range(160):  # near copies whose hub is often too far away
        ws = list(base)
        for k in rng.integers(0, 90, int(rng.integers(0, 4))):
            ws[k] = f"e{i}_{k}"
        docs.append((i, " ".join(ws)))
    docs += [(200 + i, " ".join(word(30) + passage + word(int(rng.integers(5, 200))))) for i in range(80)]
    docs += [(300 + i, docs[200 + i % 7][1]) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = order(linked(docs))
    saved = jaccard.CHUNK_ROWS, jaccard.HEAVY
    try:
        for jaccard.CHUNK_ROWS, jaccard.HEAVY in ((512, 512), (16, 3)):
            got = [tuple(r) for r in jaccard.link(frame).select("doc_id", "n_shingles", "component_id").collect()]
            assert order(got) == want
    finally:
        jaccard.CHUNK_ROWS, jaccard.HEAVY = saved


def test_bitmaps_bound_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(300):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in rng.integers(1, 400, 3))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        p, q = jaccard.parity(x), jaccard.parity(y)
        width = 8 * min(len(p), len(q))
        differ = int(np.bitwise_count(jaccard.folded(p, width) ^ jaccard.folded(q, width)).sum())
        overlap = len(np.intersect1d(x, y))
        assert overlap <= (len(x) + len(y) - differ) // 2
        if 100 * overlap >= 80 * (len(x) + len(y) - overlap):
            assert jaccard.may_link(len(x), len(y), differ)


def test_jaccard_repeated_and_missing_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("z" + w if i in at else w for i, w in enumerate(base))
    docs = [(1, near()), (1, "another text of the same id with enough words in it"), (2, near(59)), (None, near(0)), (3, near(0, 58)), (None, "alone here with five words"), (2, near(30))]
    got = [tuple(r) for r in jaccard.link(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()]
    assert order(got) == order(linked(docs))


# --- substring dedup
def deduped(docs):
    low = {}
    words = [(d, (t or "").encode().split()) for d, t in docs]
    for d, ws in words:
        for i in range(len(ws) - 12) if d is not None else []:
            k = tuple(ws[i : i + 13])
            low[k] = min(low.get(k, d), d)
    out = []
    for d, ws in words:
        gone = {j for i in range(len(ws) - 12) if d is not None and low[tuple(ws[i : i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(ws) if j not in gone)).hexdigest()))
    return out


def test_substrings_awkward_rows(awkward):
    got = [tuple(r)[:4] for r in substrings.dedup(awkward).collect()]
    assert order(got) == order(deduped(AWKWARD))
    assert substrings.dedup(awkward.limit(0)).collect() == []
    back = substrings.rewrite(awkward)
    assert back.columns == awkward.columns and back.count() == len(AWKWARD)


@pytest.mark.parametrize(("hot", "salts"), [(200, 256), (2, 3)])
def test_substrings_shared_passages(spark, hot, salts, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SALTS", salts)
    rng = np.random.default_rng(7)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 40, n)]
    passages = [word(50) for _ in range(4)]
    docs = []
    for i in range(400):
        ws = word(int(rng.integers(0, 40)))
        for p in rng.integers(0, 6, 2):
            if p < 4:
                a = int(rng.integers(0, 30))
                ws += passages[p][a : a + int(rng.integers(5, 50))] + word(int(rng.integers(0, 9)))
        docs.append((int(rng.integers(0, 10**6)), "  ".join(ws)))
    line = word(8)
    docs += [(2 * 10**6 + i, "  ".join(word(3) + line * 40 + word(5))) for i in range(3)]  # texts that repeat themselves
    docs = list({d: (d, t) for d, t in docs}.values())
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = [tuple(r)[:4] for r in substrings.dedup(frame).collect()]
    assert order(got) == order(deduped(docs))


def test_same_tells_colliding_hashes_apart():
    data = np.frombuffer(b"aabbaabbcc", np.uint8)
    starts, ends = np.arange(0, 10, 2), np.arange(2, 12, 2)
    g = substrings.same(data, starts, ends, np.zeros(5, np.uint64))
    assert g[0] == g[2] and g[1] == g[3] and len({g[0], g[1], g[4]}) == 3


def test_words_of_a_buffer():
    import pyarrow as pa

    texts = ["a bc", "d", "", " e\tf ", "g"]
    for _, _, data, offsets in textops.chunks(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])):
        w = textops.Words(data, offsets)
        assert [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == ["a", "bc", "d", "e", "f", "g"]
        assert w.doc.tolist() == [0, 0, 1, 3, 3, 4] and w.first.tolist() == [0, 2, 3, 3, 5, 6]


# --- html
PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id=wrap><div class="cookie-notice">We use cookies, really, all the time, yes.</div>
<div class="main-content"><h1>Title &amp; here</h1><p>First paragraph, with commas, and a lot of text that goes on &lt;on&gt;.</p>
<div class="advert">Buy this, and this, and that, now, quickly, please do it right now.</div><p>Second   one<br>line,&nbsp;also long enough to be counted, I hope.</p>
<script>var x = "<p>no</p>";</script><ul><li>item one</li><li>item two</ul><form><p>Subscribe, please, now</p><input></form></div>
<div class="sidebar"><p>Related, stuff, here, many, commas, so, many, commas and text text text text.</p></div>
<div id="comments"><article class="comment"><p>Great article, I like it, very much, really long comment text, hello, hello.</p></article></div></div><footer>(c)</footer></body></html>"""


def test_html_leaves_menus_and_comments_out():
    assert html.main_text(PAGE) == "Title & here\nFirst paragraph, with commas, and a lot of text that goes on <on>.\nSecond one line, also long enough to be counted, I hope.\nitem one\nitem two"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p>just short", "just short"), ("plain text", "plain text"), ("<nav><a href=x>menu</a></nav>", ""), ("<div>" * 3000 + "deep", "deep"), ("<p>a<p>b<!-- c --><p>d", "a\nb\nd"), ("<p title='>'>x", "x"), ("<p>5 < 6 and 7 > 2", "5 < 6 and 7 > 2")])
def test_html_odd_pages(page, want):
    assert html.main_text(page) == want


BODY = "<p>First paragraph, with commas, and a lot of text that goes on and on.</p><p>Second one, also long enough to be counted, I hope so.</p>"
TEXT = "First paragraph, with commas, and a lot of text that goes on and on.\nSecond one, also long enough to be counted, I hope so."
REST = "<div class=sidebar><p>Related, stuff, in a sidebar.</p></div><footer><p>Imprint, address, and so on, of the site.</p></footer>"
TALKED = "<div id=comments>" + "<div class=comment><p>Great article, I like it, very much, a really long comment text, hello, hello, hello.</p></div>" * 5 + "</div>"


@pytest.mark.parametrize("rest", ["", REST, TALKED, REST + TALKED])
@pytest.mark.parametrize("around", ["<div class='layout no-sidebar'>%s%s</div>", "<div class='content has-header'>%s</div>%s", "<form id=aspnetForm>%s%s</form>", "<div class='layout sidebar-left'><div>%s</div>%s</div>", "<header>%s%s</header>", "<div class='layout comments-open'><div>%s</div>%s</div>"])
@pytest.mark.parametrize("body", ["<article>%s</article>", "<div id=x>%s</div>", "<article><div class='entry has-related'>%s</div></article>", "<article><div class='post-print widget'>%s</div></article>"])
def test_html_marks_that_the_text_contradicts(body, around, rest):
    assert html.main_text("<html><body>" + around % (body % BODY, rest) + "</body></html>") == TEXT


@pytest.mark.parametrize(("block", "text"), [("<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul>", "Source one\nSource two"), ("<table><tr><td><a href=a>Ann</a></td><td><a href=b>Bob</a></td></tr></table>", "Ann Bob"), ("<div><a href=a>One linked sentence.</a></div>", "One linked sentence."), ("<ul class=menu><li><a href=a>Home</a></li></ul>", ""), ("<div class=related-posts><a href=a>More</a></div>", ""), ("<div role=navigation><a href=a>More</a></div>", "")])
def test_html_links_inside_the_article(block, text):
    for around in ("<article>%s</article>", "<div id=x>%s</div>"):
        assert html.main_text(around % (BODY + block + "<p>The end.</p>")) == "\n".join(t for t in (TEXT, text, "The end.") if t)


def test_html_one_mark_on_all_parts():
    parts = "".join(f"<div class='builder-widget text'><p>Part {i}, with commas, and a lot of text.</p></div>" for i in range(5))
    assert html.main_text(f"<body><div id=x>{parts}</div>{REST}") == "\n".join(f"Part {i}, with commas, and a lot of text." for i in range(5))


def test_html_marks_stay_inside_the_article():
    page = f"<div class='layout no-sidebar'><article>{BODY}<form><p>Subscribe, please, now</p></form><div class=advert><p>Buy this, and that.</p></div></article>{TALKED}{REST}</div>"
    assert html.main_text(page) == TEXT
    assert html.main_text(f"<div hidden><article>{BODY}</article></div>") == ""
    assert html.main_text("<div class=share>" * 20_000 + BODY) == TEXT


@pytest.mark.parametrize("page", ["<div></span>" * 200_000 + "<p>x", "<ul><li><p>text, one" * 100_000, '<a ">" b ' * 200_000, "<a " * 500_000, "<table><tr><td>" + "<i></div>" * 200_000, "<p a='x " * 300_000, "<table><tr><td>" * 100_000 + "x"])
def test_html_hostile_pages_take_time_in_proportion(page):
    import time

    began = time.time()
    html.main_text(page)
    assert time.time() - began < 10


@pytest.mark.parametrize("part", ["<p class=print>A printed line, long enough to be read.</p>", "<div class=footnotes><p>A footnote, long enough to be read.</p></div>", "<div class=rating><p>A rating of a film, long enough to be read.</p></div>"])
def test_html_keeps_parts_of_a_plain_page_that_names_no_article(part):
    text = html.main_text(f"<div id=x>{BODY}</div>")
    assert text == TEXT and html.main_text(f"<div id=x>{BODY}<p>{re.sub('<[^>]*>', '', part)}</p></div>") == TEXT + "\n" + re.sub("<[^>]*>", "", part)


@pytest.mark.parametrize("word", ["print", "footnotes", "rating", "legal", "tools", "toc", "copyright", "pages", "tags"])
def test_html_keeps_parts_of_an_article_whatever_harmless_word_they_bear(word):
    parts = [f"Paragraph number {k} of the article, long enough, with a comma, to be read." for k in range(4)]
    last = "The fifth one stands in an element of its own, and it belongs to the text."
    page = f"<body><nav><a href=x>Home</a></nav><article>{''.join(f'<p>{p}</p>' for p in parts)}<div class={word}><p>{last}</p></div><div class=comments><p>I like it, really, a lot.</p></div></article>"
    assert html.main_text(page) == "\n".join([*parts, last])


@pytest.mark.parametrize("tag", ["section", "div"])
def test_html_keeps_small_parts_side_by_side(tag):
    parts = ["The first part has a paragraph, of some length, that is read.", "The second part has a paragraph, of some length, too.", "A third part, with as much text as the others, follows them."]
    page = "<body><div id=w>" + "".join(f"<{tag}><p>{p}</p></{tag}>" for p in parts) + "</div><footer>foot</footer>"
    assert html.main_text(page) == "\n".join(parts)


def test_html_tables_of_any_shape(spark):
    kinds = "page_id long, url string, html string, text string, n_chars string"
    page = "<article><p>One paragraph, long enough to be read by all.</p></article>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (None, None, None, None, None)]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, kinds)).collect())
    assert got == [("1", "One paragraph, long enough to be read by all.", 45)] * 2 + [("None", "", 0)]
    assert html.extract(spark.createDataFrame([], kinds)).count() == 0


def test_html_whole_table(spark, sf_dir):
    from html import unescape

    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    rows = queries.op6_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


# --- classifiers
def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    a, b = score[y == 1][:, None], score[y == 0][None]
    return float((a > b).mean() + 0.5 * (a == b).mean())


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.Boosted(trees=60).fit(x[:1000], y[:1000])
    assert auc(model.score(x[1000:]), y[1000:]) > 0.97

    def walk(row):  # one tree after the other, place by place
        raw = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            k = 0
            for _ in range(model.depth):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            raw += leaf[k - (2**model.depth - 1)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = queries.op1_quality_classifier(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert auc(*zip(*held, strict=True)) > 0.9


def test_training_rows_are_bounded_by_ids_and_bytes(spark):
    docs = spark.createDataFrame([(k % 20, f"text {k} " * 10) for k in range(2000)] + [(50, None), (51, "long " * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(20), 50, 51]] + [(3, 0)], "doc_id long, toxic int")
    rows = quality.sampled(docs, labels, "toxic", F.lit(True), 10).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 10
    whole = quality.sampled(docs, labels, "toxic", F.lit(True), 100).collect()
    assert len(whole) == 22 and {r.doc_id: r.label for r in whole}[3] == 0
    some = quality.sampled(docs, labels, "toxic", F.lit(True), 100, 600).collect()
    assert 1 <= len(some) < 22 and sum(len(r.text or "") for r in some) <= 600 or len(some) == 1
    assert quality.sampled(docs, labels.limit(0), "toxic", F.lit(True), 10, 600).count() == 0


def test_classifiers_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (9, 0, 1), (6, 1, 0), (1, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for model, scored in ((quality.fit(awkward, labels), quality.score), (toxicity.fit(awkward, labels), toxicity.score)):
        rows = scored(awkward, model).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert scored(awkward.limit(0), model).collect() == []
    none = quality.fit(awkward, labels.limit(0)), toxicity.fit(awkward, labels.limit(0))
    assert len({r.score for r in quality.score(awkward, none[0]).collect()}) == 1
    assert len({r.score for r in toxicity.score(awkward, none[1]).collect()}) == 1
    kept = toxicity.kept(awkward, none[1], 2.0)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, at, mask = net._batch([["alpha", "beta", "gamma"], ["beta"], ["delta", "alpha"]])
    net.words = {w: i for i, w in enumerate(words)}
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        x, _ = net.inputs(words)
        s, _ = net.forward(net.gates(x), at, mask)
        return float((np.logaddexp(0, s) - y * s).sum())

    x, parts = net.inputs(words)
    s, saved = net.forward(net.gates(x), at, mask, keep=True)
    grads = net._backward(1 / (1 + np.exp(-s)) - y, saved, at, mask, x, parts)
    for k in ("uf", "ub", "wf", "cb", "att", "out", "bias", "word"):
        flat = net.p[k].reshape(-1)
        for i in rng.integers(0, min(len(flat), 12), 3):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-3 - grads[k].reshape(-1)[i]) < 2e-3, k


def test_toxic_words_are_found_anywhere(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"{a}{b}" for a, b in rng.choice(["er", "in", "th", "ou", "an", "re"], (n, 2))]
    texts, y = [], []
    for i in range(600):
        ws = word(int(rng.integers(5, 150)))
        if i % 4 == 0:
            ws.insert(int(rng.integers(0, len(ws))), str(rng.choice(["vile", "rotten", "zzzier", "zzzan"])))
        texts.append(" ".join(ws))
        y.append(int(i % 4 == 0))
    net = toxicity.Network().fit(texts[:400], np.array(y[:400]), (0.75, 0.25))
    s = net.score(texts[400:])
    assert auc(s, y[400:]) > 0.97
    long = " ".join(word(3000) + ["vile"] + word(3000))
    assert net.score([long])[0] > net.score([long.replace("vile", "erin")])[0] + 0.3
    assert [w for w in toxicity.windows(70)] == [(0, 32), (24, 56), (48, 70)] and toxicity.windows(0) == []


# --- fingerprints
def paragraphs(t):
    """Runs of at most four words of one line."""
    out = set()
    for line in re.split("[\n\r]", t):
        words = [(m.start(), m.end()) for m in re.finditer("[^ \t]+", line)]
        out |= {line[words[k][0] : words[min(k + 3, len(words) - 1)][1]] for k in range(0, len(words), 4)}
    return out


def like(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def marked(docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (d, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, nxt), 9)))
    return out


def test_fingerprints_whole_table(spark, sf_dir):
    rows = queries.op8_document_fingerprints(spark, sf_dir).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    docs = rows_of(spark, sf_dir)
    assert order(got) == order(marked(docs))
    text = dict(docs)
    seen = defaultdict(set)
    for r in rows:
        seen[text[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in seen.values())
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_fingerprints_awkward_rows(spark, awkward):
    rows = fingerprint.fingerprints(awkward).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert order(got) == order(marked([(d, t or "") for d, t in AWKWARD]))
    assert fingerprint.fingerprints(awkward.limit(0)).collect() == []
    one = fingerprint.fingerprints(awkward.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_next_rows_of_uneven_ids(spark):
    ids = list(range(300)) + [10**12 + 7 * i for i in range(50)]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r["next"].text for r in fingerprint.followed(frame, ["text"], per=10).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_next_rows_over_many_ranges_and_without_a_broadcast(spark, monkeypatch):
    ids = sorted({i * i % 1_000_003 for i in range(6000)} | {10**15 + i for i in range(3000)})
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "a"), (None, "b")], "doc_id long, text string").repartition(7)
    monkeypatch.setattr(fingerprint, "SEND_RANGES", 0)
    got = Counter((r.doc_id, r["next"].text) for r in fingerprint.followed(frame, ["text"], per=5).collect())
    want = Counter((i, f"t{ids[(k + 1) % len(ids)]}" if k + 1 < len(ids) else "a") for k, i in enumerate(ids))
    assert got == want + Counter([(None, "b"), (None, f"t{ids[0]}")])


@pytest.mark.parametrize(("load", "growth", "tries"), [(2, 4096, 2), (100, 64, 1)])
def test_fingerprints_that_fail_to_peel_are_tried_again(spark, monkeypatch, load, growth, tries):
    """However small the sub-sketches are at first, likeness is exact in the end."""
    for name, value in (("LOAD", load), ("GROWTH", growth), ("TRIES", tries)):
        monkeypatch.setattr(fingerprint, name, value)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(400)]
    docs = [(k, " ".join(base[: int(rng.integers(50, 400))] + [f"e{k}_{i}" for i in range(int(rng.integers(0, 90)))])) for k in range(30)]
    rows = fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert order([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]) == order(marked(docs))


def test_counter_of_rows_is_kept(spark, awkward):
    assert Counter(r.doc_id for r in fingerprint.fingerprints(awkward).collect()) == Counter(d for d, _ in AWKWARD)


@pytest.mark.parametrize("n", [200, 230, 1000, 1181, 1300])
def test_fingerprints_do_not_depend_on_the_length_of_the_text(spark, n):
    """An edited text, or a near copy, that is much shorter than the text still has most of its paragraphs."""
    long = " ".join(f"w{i}" for i in range(n))[:n]
    frame = spark.createDataFrame([(1, long), (2, "ab"), (3, long), (4, long[: n - n // 6])], "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprint.fingerprints(frame).collect()}
    assert rows[1].near_edited > 0.65 and rows[3].near_next > 0.8
