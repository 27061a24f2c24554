"""Main-text extraction: boosted trees over page elements, decoded so that no kept element stands in a dropped one."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .dom import FURNITURE, Page, features

#: Tags whose content is never main text.
NEVER = frozenset("script style head title noscript template nav form footer aside button select textarea iframe".split())


def distant_labels(page: Page) -> np.ndarray:
    """Labels of a page that marks its article: elements in it count as main text but for furniture by tag or name, and all others don't."""
    words = {w for name in FURNITURE for w in FURNITURE[name]}
    keep = np.zeros(len(page.tags))
    inside, out = np.zeros(len(page.tags), bool), np.zeros(len(page.tags), bool)
    for k in range(1, len(page.tags)):
        p = page.parents[k]
        out[k] = out[p] or page.tags[k] in NEVER or (page.tags[k] != "article" and any(w in words for w in page.words[k]))
        inside[k] = inside[p] or page.tags[k] == "article"
        keep[k] = inside[k] and not out[k]
    return keep


def _composed(rng: random.Random, texts: list[str]) -> tuple[str, str]:
    """A made-up page and the marker that its main elements carry: main text of some paragraphs among furniture of many kinds."""

    def say(low: int, high: int) -> str:
        words = rng.choice(texts).split() or ["text"]
        n = rng.randint(low, high)
        at = rng.randrange(max(1, len(words) - n))
        return html.escape(" ".join(words[at : at + n]))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{say(1, 3)}</a></li>' for k in range(n))

    def named(kind: str) -> str:
        word = rng.choice(FURNITURE[kind])
        return rng.choice(["", "main-", "site-", "page-", "block-"]) + word + rng.choice(["", "-box", "-wrap", "_inner", "-1"])

    def attr(kind: str) -> str:
        return f'{rng.choice(["class", "class", "id"])}="{named(kind)}"'

    def furniture(kind: str) -> str:
        tag = rng.choice({"menu": ["nav", "div", "ul"], "edge": ["header", "footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section"], "advert": ["div", "aside", "section"], "form": ["form"], "comment": ["section", "div", "ol"], "social": ["div", "ul"]}[kind])
        plain = kind in ("menu", "edge", "side", "form") and tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        body = {
            "menu": lambda: links(rng.randint(3, 9)) if tag == "ul" else f"<ul>{links(rng.randint(3, 9))}</ul>",
            "edge": lambda: rng.choice([f"&copy; {say(3, 20)}", f"<p>{say(3, 25)}</p><a href='/'>{say(1, 3)}</a>", f"<h1>{say(1, 4)}</h1><p>{say(2, 8)}</p>"]),
            "side": lambda: f"<h3>{say(1, 3)}</h3>" + rng.choice([f"<ul>{links(4)}</ul>", f"<p>{say(10, 60)}</p>"]),
            "notice": lambda: rng.choice([f"<p>{say(6, 30)}</p><button>OK</button>", say(6, 30)]),
            "advert": lambda: rng.choice([say(4, 30), f"<p>{say(4, 40)}</p>", f"<a href='/x'>{say(2, 9)}</a>"]),
            "form": lambda: f"<label>{say(1, 4)}</label><input name=q><button>{say(1, 2)}</button>" + rng.choice(["", f"<p>{say(4, 20)}</p>"]),
            "comment": lambda: "".join(rng.choice([f"<div class='comment'><p>{say(5, 60)}</p></div>", f"<p>{say(5, 60)}</p>", f"<li><b>{say(1, 2)}</b> {say(5, 40)}</li>"]) for _ in range(rng.randint(1, 4))),
            "social": lambda: f"<a href='/s'>{say(1, 2)}</a><a href='/t'>{say(1, 2)}</a>",
        }[kind]()
        return f"<{tag}{'' if plain else ' ' + attr(kind)}>{body}</{tag}>"

    def paragraphs() -> str:
        out = [rng.choice([f"<h1>{say(2, 10)}</h1>", f"<h2>{say(2, 10)}</h2>", ""])]
        for _ in range(rng.randint(1, 9)):
            out.append(rng.choice([f"<p>{say(1, 120)}</p>"] * 5 + [f"<p>{say(8, 50)}<p><b>{say(1, 9)}</b><br>{say(4, 30)}</p>", f"<p><b>{say(1, 40)}<br>", f"<ul><li>{say(2, 20)}</li><li>{say(2, 20)}</li></ul>", f"<blockquote>{say(5, 40)}</blockquote>", f"<h3>{say(1, 6)}</h3>", f"<div>{say(5, 90)}</div>", f"<p>{say(5, 30)} <a href='/a'>{say(1, 4)}</a> {say(1, 20)}</p>", f"<table><tr><td>{say(1, 9)}</td><td>{say(1, 9)}</td></tr></table>", f"<pre>{say(4, 30)}</pre>"]))
            if rng.random() < 0.12:
                out.append(furniture(rng.choice(["advert", "side", "social", "notice", "form"])))
        if rng.random() < 0.15:
            out.append(furniture("comment"))
        return "".join(out)

    kinds = list(FURNITURE)
    top = "".join(furniture(rng.choice(["menu", "edge", "advert", "notice", "social"])) for _ in range(rng.randint(0, 4)))
    tail = "".join(furniture(rng.choice(kinds)) for _ in range(rng.randint(0, 4)))
    box = rng.choice(["article"] * 4 + ["main", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry"', "div", 'div class="article-text"'])
    main = f'<{box} data-x="mainmark">{paragraphs()}</{box.split()[0]}>'
    if rng.random() < 0.25:
        main = f'<div class="{rng.choice(["wrapper", "container", "page", "row"])}">{main}{furniture("side") if rng.random() < 0.4 else ""}</div>'
    return f"<!DOCTYPE html><html><head><title>{say(2, 9)}</title><style>p{{margin:0}}</style><script>var a=1;</script></head><body>{top}{main}{tail}</body></html>", "mainmark"


def training(sources: list[str], made: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of elements: of the given pages by distant supervision, and of made-up ones from their texts."""
    rng = random.Random(seed)
    xs, ys, texts = [], [], []
    for source in sources:
        page = Page(source)
        keep = distant_labels(page)
        texts.append(page.text(keep))
        if keep.any():
            xs.append(features(page))
            ys.append(keep)
    texts = [t for t in texts if t] or ["one of the many words of a plain text, and some more of them."]
    words = {w for name in FURNITURE for w in FURNITURE[name]}
    for _ in range(made):
        source, mark = _composed(rng, texts)
        page = Page(source)
        inside, out = np.zeros(len(page.tags), bool), np.zeros(len(page.tags), bool)
        for k in range(1, len(page.tags)):
            p = page.parents[k]
            begins = mark in page.words[k]
            page.words[k] = tuple(w for w in page.words[k] if w != mark)
            inside[k] = inside[p] or begins
            out[k] = not begins and (out[p] or page.tags[k] in NEVER or page.tags[k] == "header" or any(w in words for w in page.words[k]))
        xs.append(features(page))
        ys.append((inside & ~out).astype(float))
    return np.concatenate(xs), np.concatenate(ys)


def decode(page: Page, scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The elements to keep: of all choices in which dropping an element drops what is in it, the one of the largest sum of scores.

    An element that only holds others may be passed through: its own score counts by its own text,
    and ancestors of kept elements without text of their own cost next to nothing.
    """
    n = len(scores)
    value = scores * weights
    best = value.copy()
    for k in range(n - 1, 0, -1):
        best[page.parents[k]] += max(best[k], 0.0)
    keep = np.zeros(n, bool)
    keep[0] = True
    for k in range(1, n):
        keep[k] = keep[page.parents[k]] and best[k] > 0 and page.tags[k] not in NEVER
    return keep


def _weights(page: Page) -> np.ndarray:
    """How much an element's score counts: by the length of its own text."""
    own = np.full(len(page.tags), 0.01)
    for node, piece in page.events:
        if piece:
            own[node] += len(piece.strip())
    return np.log1p(own)


def fitted(pages: DataFrame, *, most_pages: int = 200, longest: int = 50_000, made: int = 400) -> boosting.Trees:
    """Trees learned from at most ``most_pages`` pages of at most ``longest`` characters, chosen by a hash of their html, and ``made`` made-up pages."""
    able = pages.where(F.col("html").isNotNull() & (F.char_length("html") <= longest))
    order = F.xxhash64("html", F.lit("page sample"))
    # a share of about twice as many pages first, so that tasks don't send that many each
    share = min(1.0, 2 * most_pages / max(1, able.count()))
    some = able.where(F.pmod(order, F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(order, "html").limit(most_pages)
    return boosting.fit(*training([r[0] for r in some.select("html").collect()], made))


def extract(pages: DataFrame, model: boosting.Trees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: its main text from the whole html.

    Character references are decoded, white space within a block becomes one blank, blocks are
    trimmed and joined in page order by two line ends; an empty result is an empty string. A null
    html counts as empty; repeated rows give equal results; other columns are ignored.
    """
    model = model or fitted(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the number and depth of the trees
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                group, size, first = [], 0, at
                while at < batch.num_rows and size < 1 << 20:  # few enough pages at a time for their elements to fit
                    source = batch.column(2)[at].as_py() or ""
                    group.append(Page(source))
                    size += len(source) + 100
                    at += 1
                rows = [features(p) for p in group]
                scores = np.split(trees.scores(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [p.text(decode(p, s, _weights(p))) for p, s in zip(group, scores)]
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
