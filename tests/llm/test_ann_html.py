import html as H
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import ann, html

from ..conftest import SF


def brute(ids, x, query, top):
    score = x @ x[query]
    order = [i for i in np.lexsort((ids, -score)) if i != query][:top]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_beam_codes_beat_greedy_ones():
    x = np.random.default_rng(0).normal(size=(800, 16)).astype(np.float32)
    q = ann.train(x, books=3, words=32, rounds=2)
    wide, narrow = (((q.decode(q.encode(x, beam)) - x) ** 2).sum(1).mean() for beam in (8, 1))
    assert wide <= narrow < (x**2).sum(1).mean()
    # a beam as wide as all sums is exact
    tiny = ann.train(x[:50], books=2, words=6, rounds=1)
    sums = tiny.codebooks[0][:, None] + tiny.codebooks[1][None]
    best = ((x[:50, None, None] - sums[None]) ** 2).sum(3).reshape(50, -1).min(1)
    assert ((tiny.decode(tiny.encode(x[:50], 36)) - x[:50]) ** 2).sum(1) == pytest.approx(best, rel=1e-3)


def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = rows.toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    got: dict = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, rerank=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    hits = [len({v for v, _ in got[int(ids[q])]} & {v for v, _ in brute(ids, x, q, 20)}) / 20 for q in np.flatnonzero(ids % 20 == 0)]
    assert np.mean(hits) >= 0.9
    for q in list(got)[:3]:
        at = int(np.flatnonzero(ids == q)[0])
        for v, s in got[q]:
            assert s == pytest.approx(float(x[at] @ x[int(np.flatnonzero(ids == v)[0])]), abs=1e-12)


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [2.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (0, [1.0, 0.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 3, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_lookup_tables_score_the_decoded_vectors():
    x = ann.directions(np.random.default_rng(1).normal(size=(300, 12)))[0]
    for books in (3, 4):
        q = ann.train(x, books=books, words=16, rounds=1)
        codes = ann.encode_all(q, x)
        norms = np.linspace(1, 9, 300)
        got = ann.approximate(ann.lookup_tables(q, x[:7]), ann.paired(codes, 16), norms)
        assert got == pytest.approx((x[:7] @ q.decode(codes).T) * norms, abs=1e-4)
        blocks = [(np.arange(a, a + 100), ann.paired(codes[a : a + 100], 16), norms[a : a + 100]) for a in (0, 100, 200)]
        entries, scores = ann.best_of_blocks(q, x[:7], blocks, 25)
        assert np.sort(scores, 1) == pytest.approx(np.sort(got, 1)[:, -25:]) and all(set(e) == set(np.argsort(-g)[:25]) for e, g in zip(entries, got, strict=True))


def test_recall_from_merged_candidates(spark):
    """Sixty candidates of all rows: at least 0.95 of the true neighbours."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    got: dict = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, rerank=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[int(ids[q])] & {v for v, _ in brute(ids, x, q, 20)}) / 20 for q in np.flatnonzero(ids % 20 == 0)]
    assert len(hits) == 100 and np.mean(hits) >= 0.95


def test_double_vectors_stay_doubles(spark):
    rows = [(0, [0.33, 1e-3]), (1, [1.0, 1e39]), (2, [0.1, 0.2]), (3, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert [r[2] for r in got] == [1, 2, 3]
    assert [r[3] for r in got] == pytest.approx([0.33 + 1e36, 0.33 * 0.1 + 1e-3 * 0.2, 0.33 * 1e-200], rel=1e-14, abs=0)


def test_runs_and_query_blocks_do_not_matter(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = sorted(map(tuple, ann.nearest(rows, F.col("vec_id") % 20 == 0).collect()))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "RUN_BLOCKS", 2)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    assert sorted(map(tuple, ann.nearest(rows, F.col("vec_id") % 20 == 0).collect())) == want


def test_copies_do_not_crowd_out_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 8))
    x[20:] = x[20]
    df = spark.createDataFrame([(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    for query in (0, 30):
        got = [(r.vec_id) for r in ann.nearest(df, F.col("vec_id") == query, rerank=60).orderBy("rank").collect()]
        assert got == [v for v, _ in brute(np.arange(60), x, query, 20)]


def article(source):
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
    texts = [" ".join(H.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_main_text_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    for size in (64, 4):
        got = {r.page_id: r for r in html.main_text(pages, size).collect()}
        assert {i: r.text for i, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values())


FRAME = """<!doctype html><html><head><title>t</title><style>p{}</style><script>x("</p>")</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div id="cookie-notice"><p>We use cookies</p></div><nav><ul><li>Home</ul></nav>
<main><article><header><h1>Title &lt;%s&gt;</h1></header><p>First&nbsp;%s<br>line <i>a</i>b<p>Second <aside>side</aside><div class="reader-comments"><p>bad</p></div>
<form>name <input><button>go</button></form><div hidden>no</div><div style="display: none">no</div><p class="ad">buy</p><!-- <p>gone</p> --></article></main>
<div class="sidebar">more</div><footer>&copy; us</footer></body></html>"""


def test_frame_parts_are_left_out():
    got = html.extract([FRAME % (i, "x" * i) for i in range(4)])
    assert [t for t, _ in got] == [f"Title <{i}>\n\nFirst {'x' * i} line ab\n\nSecond" if i else "Title <0>\n\nFirst line ab\n\nSecond" for i in range(4)]


def test_template_is_deduced_without_an_article():
    frame = '<body><div class="x"><ul><li>Home<li>About us</ul></div><div class="c"><h1>%s</h1><p>%s</p></div><div class="z">All content by us</div></body>'
    pages = [frame % (f"t{i}", f"body words {i} here " + " ".join(f"w{i}" for _ in range(5 * i))) for i in range(6)]
    got = html.extract(pages)
    assert [t for t, _ in got] == [f"t{i}\n\n" + " ".join(f"body words {i} here {' '.join([f'w{i}'] * (5 * i))}".split()) for i in range(6)]
    assert all(n > 10 for _, n in got)
    words = {w for _, w in html.template([html.parse(p) for p in pages])}
    assert {"Home", "About", "us", "All", "content"} <= words and "t1" not in words


def test_broken_markup_and_edges(spark):
    assert [t for t, _ in html.extract(["", None, "a < b &amp; c", "<p>only <b>one", "</div></p><article>x</section>y"])] == ["", "", "a < b & c", "only one", "x\n\ny"]
    rows = [(1, None, None, "z"), (1, "http://h/x", "", "z"), (2, "http://h/y", "<p>a</p>" * 3, "z"), (2, "http://h/y", "<p>a</p>" * 3, "z"), (None, "::", "<article>q", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in html.main_text(df).collect())
    assert got == [(0, "::", "q", 1), (1, "", "", 0), (1, "http://h/x", "", 0), (2, "http://h/y", "a\n\na\n\na", 7), (2, "http://h/y", "a\n\na\n\na", 7)]
    assert html.main_text(df.limit(0)).count() == 0


def test_pages_that_share_a_passage_keep_it():
    shared = "this very passage is on every page of the host and stays"
    pages = [f"<nav>menu</nav><article><h1>n{i}</h1><p>{shared}</p><p>own {i}</p></article>" for i in range(8)]
    assert all(shared in t for t, _ in html.extract(pages))


def test_repeated_parts_inside_an_article_are_template():
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    pages = [f'<article><div class="jumps"><ul><li>Home page<li>Our shop</ul></div><h1>n{i}</h1><p>{own(i)}</p><p>shared words</p><div class="tail"><p>Write to us</p></div></article>' for i in range(6)]
    assert [t for t, _ in html.extract(pages)] == [f"n{i}\n\n{own(i)}\n\nshared words" for i in range(6)]
    # regions that are template altogether stay
    same = [f"<main><p>The page was not found</p></main><div>{i}</div>" for i in range(6)]
    assert {t for t, _ in html.extract(same)} == {"The page was not found"}


def test_teaser_cards_do_not_replace_the_body():
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(80))
    cards = lambda i: "".join(f'<article class="card"><p>teaser {i} {k}</p></article>' for k in range(3))
    pages = [f'<body><div class="text"><p>{body(i)}</p></div><div class="cards">{cards(i)}</div></body>' for i in range(6)]
    assert [t for t, _ in html.extract(pages)] == [body(i) for i in range(6)]
    lone = [f'<body><article><p>short {i}</p></article><div class="text"><p>{body(i)}</p></div></body>' for i in range(6)]
    assert [t for t, _ in html.extract(lone)] == [f"short {i}\n\n{body(i)}" for i in range(6)]


def test_a_class_that_straddles_another_is_dropped():
    frame = "<body><div class='a'>Alpha top</div>{}<p>x{} y</p>{}<div class='z'>Omega end</div></body>"
    pages = [frame.format(*(("<i>Left</i>", i, "<i>Right</i>") if i % 3 else ("", i, ""))) for i in range(9)]
    words = {w for _, w in html.template([html.parse(p) for p in pages])}
    assert {"Alpha", "top", "Omega", "end"} <= words and not {"Left", "Right"} & words
    at = lambda *rows: [np.array(rows)]
    assert html._nested(at([3, 4]), at([1, 2, 5])) and html._nested(at([1, 9]), at([3, 4, 5])) and html._nested(at([1, 2], [7, 8]), at([4, 5]))
    assert html._nested(at([0, 9]), at([1, 2], [4, 5])) and html._nested(at([1, 5, 9]), at([2, 3], [6, 7]))
    assert not html._nested(at([2, 6]), at([1, 4, 9])) and not html._nested(at([1, 5, 9]), at([3, 6])) and not html._nested(at([2, 3], [5, 8]), at([1, 6]))
    assert not html._nested(at([0, 4]), at([1, 2], [3, 5]))


def test_results_do_not_hang_on_tag_names(spark):
    """Without article, main, menu and footer tags the template gives the same texts, but for two pages of the smallest hosts."""
    groups: dict = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        groups.setdefault(re.sub(r"^\w+://([^/?#:]+).*", r"\1", r.url), []).append(r.html)
    same, n = 0, 0
    for pages in groups.values():
        want = [t for t, _ in html.extract(pages)]
        for tags in ("article|main", "article|main|nav|footer"):
            got = [t for t, _ in html.extract([re.sub(rf"(</?)(?:{tags})\b", r"\1div", p) for p in pages])]
            if len(pages) >= 3:
                assert got == want
            elif tags == "article|main":
                same, n = same + sum(a == b for a, b in zip(got, want, strict=True)), n + len(want)
    assert same == n


def test_the_template_decides(monkeypatch):
    own = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    pages = [f'<body><div><ul><li>Start<li>Our shop<li>Jobs at our shop</ul></div><div><h1>n{i}</h1><p>{own(i, 20 + 9 * i)}</p></div><div><p>{own(50 + i, 7)}</p></div></body>' for i in range(6)]
    want = [f"n{i}\n\n{own(i, 20 + 9 * i)}" for i in range(6)]
    assert [t for t, _ in html.extract(pages)] == want
    framed = [f"<article><p>Menu of this site</p><h1>n{i}</h1><h2>{own(i, 30)}</h2></article>" for i in range(5)]
    assert [t for t, _ in html.extract(framed)] == [f"n{i}\n\n{own(i, 30)}" for i in range(5)]
    monkeypatch.setattr(html, "template", lambda pages: set())
    assert [t for t, _ in html.extract(framed)] != [f"n{i}\n\n{own(i, 30)}" for i in range(5)]


@pytest.mark.parametrize("name, frame", [("post-comments", True), ("entry-footer", True), ("article-ad", True), ("story-related", True), ("relatedContent", True), ("sponsored-post", True), ("main-nav", True), ("pageFooter", True), ("remarks", True), ("has-sidebar", False), ("no-ads", False), ("entry-header", False), ("page-header", False), ("header", True), ("search-content", False), ("content", False), ("readable", False), ("ad_slot", True)])
def test_names_of_parts(name, frame):
    page = f'<body><main><article><p>text</p><div class="x {name}"><p>part</p></div></article></main></body>'
    assert html.extract([page])[0][0] == ("text" if frame else "text\n\npart")


def test_articles_of_readers():
    body = " ".join(f"b{k}" for k in range(60))
    reply = "<article><p>reader said so</p></article>"
    for page in (f"<main><article><p>{body}</p></article>{reply}{reply}</main>", f"<article><p>{body}</p><section>{reply}</section></article>", f"<article><p>{body}</p></article><div>{reply}</div>"):
        assert html.extract([page])[0][0] == body
    alike = f"<main><article><p>{body} one</p></article><article><p>{body} two</p></article></main>"
    assert html.extract([alike])[0][0] == f"{body} one\n\n{body} two"


def test_long_attributes_and_open_quotes():
    for size in (9_000, 200_000):
        assert html.extract([f"<article><p title=\"{'a > b ' * (size // 6)}\">text</p><img alt='{'x<y>' * (size // 4)}'></article>"])[0][0] == "text"
    assert html.extract(['<p>a</p><p title="b>c</p><p>d</p>'])[0][0] == "a\n\nc\n\nd"
    assert html.extract(["<p>" + "<a href='x" * 30_000])[0][0] == ""


def naive_template(pages):
    """The definitions of the module, token by token."""
    least = max(3, -(-len(pages) // 2))
    tokens = sorted({t for p in pages for t in p.tokens}, key=lambda t: next((i, p.tokens.index(t)) for i, p in enumerate(pages) if t in p.tokens))
    at = {t: [[i for i, x in enumerate(p.tokens) if x == t] for p in pages] for t in tokens}
    vector = {t: tuple(map(len, at[t])) for t in tokens}
    classes = [v for v in set(vector.values()) if sum(n > 0 for n in v) >= least]
    classes.sort(key=lambda v: (-sum(n > 0 for n in v), -v.count(1), v))
    out, settled = set(), []
    for v in classes:
        keys = [t for t in tokens if vector[t] == v]
        kept = []
        for t in keys:
            rows = [list(zip(*(at[k][p] for k in (*kept, t)), strict=True)) for p in range(len(pages))]
            flat = [[x for row in page for x in row] for page in rows]
            if not kept or all(f == sorted(f) for f in flat):
                kept.append(t)
        mine = [list(zip(*(at[k][p] for k in kept), strict=True)) for p in range(len(pages))]
        good = True
        for other in settled if len(kept) > 1 else []:
            for a, b in zip(mine, other, strict=True):
                marks = [x for row in b for x in row]
                for row in a:
                    between = [x for x in marks if row[0] < x < row[-1]]
                    if not between:
                        continue
                    inside = [r for r in b if r[0] in between or r[-1] in between or any(x in between for x in r)]
                    whole = all(x in between for r in inside for x in r)
                    one_gap = all(len({sum(x > k for k in row) for x in r}) == 1 for r in inside)
                    good = good and whole and one_gap
        if good:
            out.update(kept)
            if len(kept) > 1:
                settled.append(mine)
    return out


def test_classes_equal_brute_force():
    rng = random.Random(4)
    seen = Counter()
    for _ in range(60):
        parts = [f"<div class='k{k}'>{' '.join(rng.choice(['Top', 'of', 'the', 'site', 'more']) for _ in range(rng.randrange(1, 4)))}</div>" for k in range(4)]
        pages = []
        for i in range(rng.randrange(3, 8)):
            some = [p for p in parts if rng.random() < 0.9]
            if rng.random() < 0.2:
                rng.shuffle(some)
            rows = "".join(f"<li>item <i>n{rng.randrange(9)}</i> end" for _ in range(rng.randrange(0, 4)))
            pages.append(html.parse("<body>" + "".join(some[:2]) + f"<ul>{rows}</ul><p>own {i}</p>" + "".join(some[2:]) + "</body>"))
        got = html.template(pages)
        assert got == naive_template(pages)
        seen[len(got) > 8] += 1
    assert seen[True] > 20


def test_repeated_rows_come_back_as_often(spark):
    rows = [(None, None, "<p>same</p>")] * 150 + [(1, "http://h/a", "<p>x</p>")] * 2
    got = Counter(tuple(r) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "url", "text").collect())
    assert got == {(None, None, "same"): 150, (1, "http://h/a", "x"): 2}
