"""HTML extraction: a recurrent block labeller.

A page is cut into its leaf blocks: the texts between block-level tags, each with the path of
the tags that are open, each with all its classes and its id. A block's vector holds the hashed
steps of the whole path (the nearer to the text the heavier, but none below half), hashed words,
and a few measures (length, share of linked text, share of signs, place). A bidirectional LSTM in
numpy reads the page's whole sequence, so every block is classified as content or not with what
stands before and after it.

It is trained here, on a bounded sample of pages (`sample_pages`, those of the smallest hash):
the teacher is the pages' own markup, where it says what is content (article, main) or not
(nav, footer, aside, header, a class such as ad). Half of the training pages hide their paths, so that
words and neighbours count where markup says nothing.

Defined results: a null, empty or textless page gives no rows, an empty table none either; script, style, comments and the
head are no text; an unclosed comment or script reaches to the end of the page. Where no page
of the sample has blocks that the teacher knows, every block is content with score 0.5.
Repeated rows give repeated results; extra columns play no part; pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, md5_key

#: Pages that the labeller is trained on, at most.
SAMPLE_PAGES = 384
PATHS, WORDS, MEASURES, HIDDEN = 160, 128, 6, 16
WIDTH = PATHS + WORDS + MEASURES

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*>",
    re.S | re.I,
)
_CLASS = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[\w-]+")
_WORD = re.compile(r"\w+")
_INLINE = frozenset("a abbr b bdi bdo big br cite code data em font i img kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an open tag stays open in, where another of its kind begins.
_WITHIN = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "tr": frozenset(["table"])}
_CONTENT = frozenset(["article", "main"])
_BOILERPLATE = frozenset("nav footer aside header menu form .ad .ads .advert .sidebar .nav .navbar .footer .header .menu .cookie .comments .share .social .related".split())


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of linked text) of each leaf block."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    if not page:
        return out
    stack: list[str] = []
    tags: list[str] = []
    texts: list[str] = []
    at, linked, path = 0, 0, ()

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(texts)).split())
        if text:
            out.append((path, text, min(1.0, linked / len(text))))
        texts.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal path, linked
        if piece and not piece.isspace():
            if not texts:
                path = tuple(x for x in stack if x not in _INLINE)
            if "a" in tags:
                linked += len(piece.strip())
            texts.append(piece)
        elif piece and texts:
            texts.append(" ")

    for m in _TAG.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            end()
        elif name == "br" and texts:
            texts.append(" ")
        if m.group(2):
            if name in tags:
                k = len(tags) - 1 - tags[::-1].index(name)
                del tags[k:], stack[k:]
        elif name not in _VOID and not m.group(4).endswith("/"):
            k = _closed(tags, name)
            del tags[k:], stack[k:]
            named = [x for c in _CLASS.finditer(m.group(4)) for x in _NAME.findall("".join(filter(None, c.groups())).lower())] if m.group(4) else []
            tags.append(name)
            stack.append(".".join([name, *named]))
    take(page[at:])
    end()
    return out


def _closed(tags: list[str], name: str) -> int:
    """How many of the open tags stay open where tag name begins: a paragraph ends at any block, an item at the next of its list."""
    if name in _WITHIN:
        for k in range(len(tags) - 1, -1, -1):
            if tags[k] == name or name in ("dt", "dd") and tags[k] in ("dt", "dd"):
                return k
            if tags[k] in _WITHIN[name]:
                break
    elif name not in _INLINE:
        for k in range(len(tags) - 1, -1, -1):
            if tags[k] == "p":
                return k
            if tags[k] not in _INLINE:
                break
    return len(tags)


def taught(path: tuple[str, ...]) -> int | None:
    """1 for content, 0 for boilerplate, None where the markup doesn't say."""
    for step in reversed(path):
        tag, *kinds = step.split(".")
        if tag in _BOILERPLATE or any(f".{kind}" in _BOILERPLATE for kind in kinds):
            return 0
        if tag in _CONTENT:
            return 1
    return None


_BUCKET: dict[str, int] = {}


def _bucket(word: str, of: int) -> int:
    k = _BUCKET.get(word)
    if k is None:
        if len(_BUCKET) > 200_000:
            _BUCKET.clear()
        k = _BUCKET[word] = crc32(word.encode("utf-8", "surrogatepass"))
    return k % of


def vectors(page: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """One row a block: hashed path, hashed words, measures."""
    x = np.zeros((len(page), WIDTH), np.float32)
    for i, (path, text, linked) in enumerate(page):
        weight = 0.5
        for step in reversed(path):
            tag, *kinds = step.split(".")
            for k in (_bucket(tag, PATHS), *(_bucket(f"{tag}.{kind}", PATHS) for kind in kinds)):
                x[i, k] = max(x[i, k], 0.5 + weight)
            weight *= 0.9
        words = _WORD.findall(text.lower())
        if words:
            counts = np.bincount([_bucket(w, WORDS) for w in words], minlength=WORDS)
            x[i, PATHS : PATHS + WORDS] = np.sqrt(counts / len(words))
        signs = len(text) - sum(map(len, words))
        x[i, PATHS + WORDS :] = (np.log1p(len(words)) / 5, linked, signs / len(text), i / len(page), (len(page) - 1 - i) / 10 if len(page) - i < 10 else 1, text[-1] in ".!?…")
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    weights = {}
    for side in "fb":
        weights[f"w{side}"] = (r.standard_normal((WIDTH + HIDDEN, 4 * HIDDEN)) / np.sqrt(WIDTH + HIDDEN)).astype(np.float32)
        weights[f"c{side}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)  # open to memory at first
    weights["v"], weights["d"] = np.zeros((2 * HIDDEN, 1), np.float32), np.zeros(1, np.float32)
    return weights


def _run(x: np.ndarray, w: np.ndarray, c: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [t, page, HIDDEN] of an LSTM over x [t, page, WIDTH]."""
    t, n = x.shape[:2]
    h = s = np.zeros((n, HIDDEN), np.float32)
    inputs = x.reshape(t * n, -1) @ w[:WIDTH] + c
    inputs, out = inputs.reshape(t, n, -1), np.empty((t, n, HIDDEN), np.float32)
    for k in range(t):
        z = inputs[k] + h @ w[WIDTH:]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, s = s, f * s + i * g
        tanh = np.tanh(s)
        if keep is not None:
            keep.append((h, before, f, i, o, g, tanh))
        h = out[k] = o * tanh
    return out


def _back(x: np.ndarray, w: np.ndarray, keep: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, dc = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
    dh = ds = np.zeros_like(dout[0])
    for k in range(len(keep) - 1, -1, -1):
        h, before, f, i, o, g, tanh = keep[k]
        dh = dh + dout[k]
        ds = ds + dh * o * (1 - tanh**2)
        dz = np.concatenate([ds * before * f * (1 - f), ds * g * i * (1 - i), dh * tanh * o * (1 - o), ds * i * (1 - g**2)], axis=1)
        dw[:WIDTH] += x[k].T @ dz
        dw[WIDTH:] += h.T @ dz
        dc += dz.sum(0)
        dh, ds = dz @ w[WIDTH:].T, ds * f
    return dw, dc


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, index that turns backward states round) of pages of like length."""
    lengths = np.array([len(p) for p in pages])
    t = int(lengths.max())
    x = np.zeros((t, len(pages), WIDTH), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    # each page is reversed within its own length, so that padding comes last in both directions
    turn = np.where(np.arange(t)[:, None] < lengths, lengths - 1 - np.arange(t)[:, None], np.arange(t)[:, None])
    return x, np.take_along_axis(x, turn[:, :, None], axis=0), turn


def predict(pages: list[np.ndarray], weights: dict[str, np.ndarray], together: int = 128) -> list[np.ndarray]:
    """Probability of content for every block of every page."""
    out: list = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        # pages together stay below a fixed number of padded blocks
        n = max(1, min(together, len(order) - at))
        while n > 1 and n * len(pages[order[at + n - 1]]) > 16_384:
            n //= 2
        some = order[at : at + n]
        at += n
        x, y, turn = _padded([pages[k] for k in some])
        both = np.concatenate([_run(x, weights["wf"], weights["cf"]), np.take_along_axis(_run(y, weights["wb"], weights["cb"]), turn[:, :, None], axis=0)], axis=2)
        p = _sigmoid(both @ weights["v"] + weights["d"])[:, :, 0]
        for j, k in enumerate(some):
            out[k] = p[: len(pages[k]), j]
    return out


def train(pages: list[str | None], epochs: int = 12, rate: float = 0.01, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights from pages by the teacher's labels: Adam on the mean cross-entropy of the blocks that it knows."""
    r, weights = np.random.default_rng(seed), initial(seed)
    cut = [b for b in map(blocks, pages) if b]
    data = [(vectors(b), np.array([-1 if (y := taught(p)) is None else y for p, _, _ in b])) for b in cut]
    data = sorted((d for d in data if (d[1] >= 0).any()), key=lambda d: len(d[1]))
    groups = [data[k : k + 16] for k in range(0, len(data), 16)]
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v = {k: np.zeros_like(x) for k, x in weights.items()}
    step = 0
    for _ in range(epochs):
        for g in r.permutation(len(groups)):
            step += 1
            xs = []
            for x, _ in groups[g]:
                if r.random() < 0.5:
                    x = x.copy()
                    x[:, :PATHS] = 0
                xs.append(x)
            x, back, turn = _padded(xs)
            y = np.full(x.shape[:2], -1)
            for k, (_, labels) in enumerate(groups[g]):
                y[: len(labels), k] = labels
            kf: list = []
            kb: list = []
            hf, hb = _run(x, weights["wf"], weights["cf"], kf), _run(back, weights["wb"], weights["cb"], kb)
            both = np.concatenate([hf, np.take_along_axis(hb, turn[:, :, None], axis=0)], axis=2)
            p = _sigmoid(both @ weights["v"] + weights["d"])[:, :, 0]
            dz = np.where(y >= 0, p - y, 0).astype(np.float32)[:, :, None] / max(1, int((y >= 0).sum()))
            dboth = dz @ weights["v"].T
            grads = {"v": (both * dz).sum((0, 1))[:, None], "d": dz.sum((0, 1))}
            grads["wf"], grads["cf"] = _back(x, weights["wf"], kf, dboth[:, :, :HIDDEN])
            grads["wb"], grads["cb"] = _back(back, weights["wb"], kb, np.take_along_axis(dboth[:, :, HIDDEN:], turn[:, :, None], axis=0))
            norm = np.sqrt(sum(float((q**2).sum()) for q in grads.values()))
            for k, q in grads.items():
                q = q * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q**2
                weights[k] = (weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return weights


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, page_id: str = "page_id", html: str = "html", seed: int = 0) -> dict[str, np.ndarray]:
    """Weights trained on the sample: the pages of the smallest hash of their id."""
    keyed = pages.filter(F.length(html) > 0).select(md5_key("page", F.col(page_id)).alias("k"), F.col(html).alias("h"))
    # by far most pages can't be among the smallest, so that tasks send a few pages in all and not a sample each
    share = 4 * sample_pages / max(1, pages.count())
    few = keyed.filter(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") < int(share * 2**32)) if share < 1 else keyed
    sample = few.orderBy("k", "h").limit(sample_pages).collect()
    if share < 1 and len(sample) < sample_pages:
        sample = keyed.orderBy("k", "h").limit(sample_pages).collect()
    return train([row["h"] for row in sample], seed=seed)


def _labeller(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [blocks(p) for p in part.column("html").to_pylist()]
                found = predict([vectors(p) for p in pages], weights)
                row = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
                score = np.round(np.concatenate([np.zeros(0), *found]).astype(np.float64), 3)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id").take(pa.array(row)),
                        pa.array([i for p in pages for i in range(len(p))], pa.int32()),
                        pa.array(["/".join(b[0]) for p in pages for b in p], pa.string()),
                        pa.array(score >= 0.5),
                        pa.array(score),
                        pa.array([b[1] for p in pages for b in p], pa.string()),
                    ],
                    names=["page_id", "block", "path", "content", "score", "text"],
                )

    return run


def label(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, page_id: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, block, path, content, score, text) of every block of every page; no shuffle."""
    weights = fit(pages, sample_pages, page_id, html) if weights is None else weights
    bounded_batches(pages.sparkSession)
    light = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    kind = light.schema["page_id"].dataType.simpleString()
    return light.mapInArrow(_labeller(weights), f"page_id {kind}, block int, path string, content boolean, score double, text string")
