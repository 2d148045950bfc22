"""The block cutter, the gradients, and the labeller's accuracy on pages that it wasn't trained on."""

import numpy as np
import pytest

from quern.llm import html_lstm as h


def test_blocks():
    page = "<html><head><title>No</title></head><body><nav><a href='>'>Home</a> now</nav><!-- x <p>no</p> --><div class='ad box'>Buy</div><article><p>One <b>two</b><p>three &amp; four<br>five</article><script>if (a < b) {}</script></body>tail"
    got = [(b[0][-1], b[1]) for b in h.blocks(page)]
    assert got == [("nav", "Home now"), ("div.ad.box", "Buy"), ("p", "One two"), ("p", "three & four five"), ("html", "tail")]
    assert h.blocks(None) == h.blocks("") == h.blocks("<p></p> \n") == h.blocks("<!-- open <p>x") == []
    assert [b[1] for b in h.blocks("plain < text > here")] == ["plain < text > here"]
    assert h.blocks(page)[0][2] == pytest.approx(4 / 8)


def test_gradients():
    r = np.random.default_rng(0)
    x, w, c = r.standard_normal((4, 3, h.WIDTH)), r.standard_normal((h.WIDTH + h.HIDDEN, 4 * h.HIDDEN)) * 0.1, r.standard_normal(4 * h.HIDDEN) * 0.1
    target = r.standard_normal((4, 3, h.HIDDEN))
    loss = lambda: float((h._run(x, w, c).astype(float) * target).sum())
    keep = []
    h._run(x, w, c, keep)
    dw, dc = h._back(x, w, keep, target)
    for i, j in [(0, 0), (5, 20), (h.WIDTH + 3, 40), (h.WIDTH + 1, 60)]:
        old, step = w[i, j], 1e-2
        w[i, j] = old + step
        up = loss()
        w[i, j] = old - step
        down = loss()
        w[i, j] = old
        assert dw[i, j] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-3)
    assert np.isfinite(dc).all()


def test_padding_plays_no_part():
    r = np.random.default_rng(1)
    weights = h.initial()
    weights["v"] = r.standard_normal(weights["v"].shape).astype(np.float32)
    pages = [r.standard_normal((n, h.WIDTH)).astype(np.float32) for n in (3, 9, 1, 0, 30)]
    together, alone = h.predict(pages, weights), [h.predict([p], weights)[0] for p in pages]
    for a, b in zip(together, alone):
        np.testing.assert_allclose(a, b, atol=1e-5)


def test_held_out_accuracy(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    weights = h.train(pages[:150])
    cut = [h.blocks(p) for p in pages[150:]]
    truth = np.array([h.taught(b[0]) for p in cut for b in p])
    hidden = [h.vectors(p) for p in cut]
    assert ((np.concatenate(h.predict(hidden, weights)) >= 0.5) == truth).mean() > 0.98
    for v in hidden:
        v[:, : h.PATHS] = 0
    assert ((np.concatenate(h.predict(hidden, weights)) >= 0.5) == truth).mean() > 0.95


def test_untaught_pages_are_all_content(spark):
    df = spark.createDataFrame([(1, "<p>a b</p><p>c</p>"), (1, "<p>a b</p><p>c</p>"), (2, None), (None, "x")], "page_id long, html string")
    rows = [(r["page_id"], r["block"], r["content"], r["score"], r["text"]) for r in h.label(df).collect()]
    assert sorted(rows, key=repr) == sorted([(1, 0, True, 0.5, "a b"), (1, 1, True, 0.5, "c")] * 2 + [(None, 0, True, 0.5, "x")], key=repr)


def test_deeply_nested_pages():
    """The deciding tag stands ten block-level tags above the text, and nothing else tells blocks apart."""
    r = np.random.default_rng(2)

    def page():
        parts = []
        for _ in range(8):
            tag = r.choice(["nav", "aside", "footer", "article"])
            parts.append(f"<{tag}>" + "<div>" * 10 + " ".join(f"w{k}" for k in r.integers(0, 50, 12)) + "</div>" * 10 + f"</{tag}>")
        return f"<html><body>{''.join(parts)}</body></html>"

    pages = [page() for _ in range(240)]
    weights = h.train(pages[:200])
    cut = [h.blocks(p) for p in pages[200:]]
    truth = np.array([h.taught(b[0]) for p in cut for b in p])
    assert ((np.concatenate(h.predict([h.vectors(p) for p in cut], weights)) >= 0.5) == truth).mean() > 0.98


def test_deciding_tags_have_buckets_of_their_own():
    tags = ["div", "ul", "li", "p", "section", "table", "tr", "td", "body", "html", "h1", "h2", "h3", "article", "main", "nav", "footer", "aside", "header", "menu", "form"]
    assert len({h._bucket(t, h.PATHS) for t in tags}) == len(tags)


def test_all_classes_and_open_tags_count():
    page = "<div class='box wide SIDEBAR' id=main data-id=nav>x</div><ul><li><div><div><div><p>one<li>two</ul><p>a<div>b</div><table><tr><td>c<td>d<tr><td>e</table>"
    got = [("/".join(b[0]), b[1]) for b in h.blocks(page)]
    assert got == [("div.box.wide.sidebar.main", "x"), ("ul/li/div/div/div/p", "one"), ("ul/li", "two"), ("p", "a"), ("div", "b"), ("table/tr/td", "c"), ("table/tr/td", "d"), ("table/tr/td", "e")]
    assert h.taught(("div.box.wide.sidebar",)) == 0 and h.taught(("article.box",)) == 1
    a, b = (h.vectors([((f"{tag}", *["div"] * 12), "same words", 0.0)]) for tag in ("article", "nav"))
    assert (a != b).any()


def plain_labels(pages, weights):
    """The query's rows with one page, one block and one gate at a time."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    size, rows = h.HIDDEN, []
    for page_id, page in pages:
        cut = h.blocks(page)
        x = h.vectors(cut).astype(np.float64)
        states = {}
        for side, order in (("f", range(len(cut))), ("b", range(len(cut) - 1, -1, -1))):
            w, c = weights[f"w{side}"].astype(np.float64), weights[f"c{side}"]
            hidden = cell = np.zeros(size)
            for t in order:
                both = np.concatenate([x[t], hidden])
                forget, take, give, new = (both @ w[:, k * size : (k + 1) * size] + c[k * size : (k + 1) * size] for k in range(4))
                cell = sigmoid(forget) * cell + sigmoid(take) * np.tanh(new)
                hidden = sigmoid(give) * np.tanh(cell)
                states[side, t] = hidden
        for t, (path, text, _) in enumerate(cut):
            score = float(sigmoid(np.concatenate([states["f", t], states["b", t]]) @ weights["v"][:, 0] + weights["d"][0]))
            rows.append((page_id, t, "/".join(path), text, score))
    return rows


def test_query_matches_a_plain_version(spark, sf):
    from quern.llm import queries

    table = spark.read.parquet(f"{sf}/pages.parquet")
    pages = [(r["page_id"], r["html"]) for r in table.collect()]
    sample = sorted((__import__("hashlib").md5(f"page:{k}".encode()).hexdigest(), page) for k, page in pages if page)[: h.SAMPLE_PAGES]
    wanted = plain_labels(pages, h.train([page for _, page in sample]))
    got = {(r["page_id"], r["block"]): r for r in queries.op5_html_blocks(spark, sf).collect()}
    assert len(got) == len(wanted) > 100
    for page_id, block, path, text, score in wanted:
        r = got[page_id, block]
        assert (r["path"], r["text"]) == (path, text) and r["score"] == pytest.approx(score, abs=2e-3)
        assert r["content"] == (score >= 0.5) or abs(score - 0.5) < 2e-3
