"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags. Each block has features of its
ancestors (tags, words of class, id and role) and of its text; a chain over a page's blocks labels each as
article or not, with learned weights and transitions, decoded by Viterbi. The field is trained on
labelled pages: a bounded sample of the table's pages whose landmarks (article, main, nav, aside, footer ...)
tell the label, and pages laid out in many other ways, with labels, from the words of that sample.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholiast.llm.store import hashed_sample

#: Pages in the training sample: those with the smallest hashed page_id.
SAMPLE = 300
FEATURES = 1 << 14
# fixed values: names of HTML elements
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
# elements whose content is raw text: those that pages don't show, and the one that they do
_SKIP = frozenset("script style textarea title iframe noembed noframes".split())
_RAW = frozenset(["xmp"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_INSIDE = frozenset("ul ol dl table menu div section article body".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STEP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


class Tags:
    """Where the tags of a page end: quotes count as values of attributes only, and one that is never closed counts as text."""

    def __init__(self, page: str):
        self.page, self.last = page, {mark: page.rfind(mark) for mark in "\"'"}
        self.dead: set[int] = set()  # places from which quoted values run to the end of the page

    def end(self, at: int) -> int:
        """Index behind the > of a tag whose name ends at `at`; there is one."""
        start, seen = at, []
        while at not in self.dead:
            m = _STEP.search(self.page, at)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            seen.append(at)
            at = self.page.find(m[1], m.end()) + 1 if self.last[m[1]] >= m.end() else m.end()
        self.dead.update(seen)
        return self.page.find(">", start) + 1


class Block:
    __slots__ = ("text", "path", "inside", "names", "links", "bold", "label")

    def __init__(self, text: str, path: tuple[str, ...], inside: tuple[int, ...], names: frozenset[str], links: int, bold: int, label: str):
        #: Names of the open elements, and their numbers in page order.
        self.path, self.inside = path, inside
        self.text, self.names, self.links, self.bold, self.label = text, names, links, bold, label

    def box(self) -> tuple[int, ...]:
        """Numbers of the block-level elements around the innermost one."""
        return tuple(i for i, t in zip(self.inside, self.path, strict=True) if t in _BLOCK)[:-1]


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. White space inside a block is one space; blocks without other text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str, int]] = []
    number = 0
    text: list[str] = []
    linked = bold = 0
    depth_link = depth_bold = depth_inert = 0
    tags = Tags(page)
    names: frozenset[str] = frozenset()

    def end_block() -> None:
        nonlocal linked, bold
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                label = next((x[2] for x in reversed(stack) if x[2]), "")
                out.append(Block(joined, tuple(x[0] for x in stack), tuple(x[3] for x in stack), names, linked, bold, label))
            text.clear()
        linked = bold = 0

    def said(x: str) -> None:
        nonlocal linked, bold
        if x and not depth_inert:
            x = entities.unescape(x)
            text.append(x)
            linked += len(x) * (depth_link > 0)
            bold += len(x) * (depth_bold > 0)

    def pop_to(i: int) -> None:
        nonlocal names, depth_link, depth_bold, depth_inert
        for name, *_ in stack[i:]:
            depth_inert -= name == "template"
            depth_link -= name == "a"
            depth_bold -= name in ("b", "strong")
        del stack[i:]
        names = frozenset().union(*(x[1] for x in stack)) if stack else frozenset()

    at, last = 0, page.rfind(">")
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            said(page[at:])
            break
        said(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = len(page) if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = len(page) if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            said("<")
            at = lt + 1
            continue
        at = tags.end(m.end())
        closing, name, rest = m[1], m[2].lower(), page[m.end() : at - 1]
        block = name in _BLOCK
        if closing:
            if block:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            continue
        if name in _SKIP or name in _RAW:
            if rest.endswith("/"):
                continue
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if name in _RAW:
                end_block()
                text.append(page[at : close.start() if close else len(page)])
                end_block()
            at = close.end() if close else len(page)
            continue
        if name == "br":
            text.append(" ")
            continue
        if block:
            end_block()
            closes = _CLOSES.get(name)
            if closes or "p" in (x[0] for x in stack):
                for i in range(len(stack) - 1, -1, -1):
                    own = stack[i][0]
                    if closes and own in closes or own == "p":
                        pop_to(i)
                        if not closes:
                            break
                    elif own in _INSIDE:
                        break
        if name in _VOID or rest.endswith("/") and not block:
            continue
        found, label = set(), ""
        if rest:
            for a in _ATTRIBUTE.finditer(rest):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-label":
                    label = value
                else:
                    found.update(_NAME.findall(value.lower()))
        number += 1
        stack.append((name, frozenset(found), label, number))
        if found:
            names = names | found
        depth_inert += name == "template"
        depth_link += name == "a"
        depth_bold += name in ("b", "strong")
    end_block()
    return out


def features(blocks: list[Block]) -> list[list[int]]:
    """Hashed features of each block."""
    n, out = len(blocks), []
    title = next((b for b in blocks if "h1" in b.path), None)
    # what surrounds the first h1, without a header of its own
    beside = [i for i, t in zip(title.inside, title.path, strict=True) if t in _BLOCK and t not in ("h1", "header", "hgroup")] if title else []
    for i, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        f = [f"words {min(9, int(math.log2(words)))}", f"linked {min(4, 4 * b.links // max(1, size))}", f"bold {min(2, 2 * b.bold // max(1, size))}", f"end {b.text[-1] in '.!?:' + chr(34)}", f"commas {min(3, b.text.count(','))}", "last" if i == n - 1 else "first" if i == 0 else "middle", f"copyright {b.text[0] == chr(169) or 'copyright' in b.text[:40].lower()}", "always"]
        leaf = next((t for t in reversed(b.path) if t in _BLOCK), "none")
        f.append(f"leaf {leaf}")
        f += [f"in {t}" for t in set(b.path) if t not in ("html", "body", leaf) and t in _BLOCK]
        f += [f"name {t}" for t in b.names]
        f.append("no h1" if not title else f"beside h1 {len(beside) > 2 and beside[-1] in b.inside}" if b is not title else "h1")
        out.append([zlib.crc32(x.encode()) % FEATURES for x in f])
    return out


def steps(blocks: list[Block]) -> list[int]:
    """Kind of the step to each block from the one before: 0 in the same box, 1 to an inner one, 2 to an outer one, 3 to another."""
    boxes = [b.box() for b in blocks]
    kind = lambda x, y: 0 if x == y else 1 if y[: len(x)] == x else 2 if x[: len(y)] == y else 3
    return [3, *(kind(x, y) for x, y in zip(boxes[:-1], boxes[1:], strict=True))][: len(blocks)]


class Field:
    """Weights of two labels (0 other, 1 article) and of the four kinds of steps between them."""

    def __init__(self):
        self.weight, self.step, self.start = np.zeros((FEATURES, 2)), np.zeros((4, 2, 2)), np.zeros(2)

    def fit(self, pages: list[tuple[list[list[int]], list[int], list[int]]], rounds: int = 12, rate: float = 0.1, decay: float = 1e-4) -> Field:
        """Maximum likelihood with a quadratic penalty by AdaGrad; gradients by forward and backward sums."""
        total = [np.full_like(x, 1e-8) for x in (self.weight, self.step, self.start)]
        order = np.random.default_rng(5)
        for _ in range(rounds):
            for j in order.permutation(len(pages)):
                rows, kinds, labels = pages[j]
                step = self.step[kinds]
                n = len(rows)
                local = np.array([self.weight[r].sum(0) for r in rows])
                local[0] += self.start
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = local[0]
                for i in range(1, n):
                    forward[i] = local[i] + np.logaddexp(forward[i - 1][0] + step[i, 0], forward[i - 1][1] + step[i, 1])
                for i in range(n - 2, -1, -1):
                    x = step[i + 1] + local[i + 1] + backward[i + 1]
                    backward[i] = np.logaddexp(x[:, 0], x[:, 1])
                log_z = np.logaddexp(*forward[-1])
                node = np.exp(forward + backward - log_z)
                node[np.arange(n), labels] -= 1
                g_step = np.zeros((4, 2, 2))
                if n > 1:
                    np.add.at(g_step, kinds[1:], np.exp(forward[:-1, :, None] + step[1:] + (local + backward)[1:, None, :] - log_z))
                    np.add.at(g_step, (kinds[1:], labels[:-1], labels[1:]), -1)
                    g_step += decay * self.step
                flat = np.concatenate(rows)
                ids, back = np.unique(flat, return_inverse=True)
                g = np.zeros((len(ids), 2))
                np.add.at(g, back, np.repeat(node, [len(r) for r in rows], axis=0))
                g += decay * self.weight[ids]
                total[0][ids] += g * g
                self.weight[ids] -= rate * g / np.sqrt(total[0][ids])
                for k, (p, d) in enumerate(((self.step, g_step), (self.start, node[0])), 1):
                    total[k] += d * d
                    p -= rate * d / np.sqrt(total[k])
        return self

    def labels(self, rows: list[list[int]], kinds: list[int]) -> list[int]:
        """Most probable labels of a page's blocks, by Viterbi; ties to 0."""
        if not rows:
            return []
        w = [self.weight[r].sum(0).tolist() for r in rows]
        step = self.step.tolist()
        a, b = w[0][0] + self.start[0], w[0][1] + self.start[1]
        back = []
        for (x, y), kind in zip(w[1:], kinds[1:], strict=True):
            (s00, s01), (s10, s11) = step[kind]
            from0, from1 = b + s10 > a + s00, b + s11 > a + s01
            back.append((int(from0), int(from1)))
            a, b = x + (b + s10 if from0 else a + s00), y + (b + s11 if from1 else a + s01)
        out = [int(b > a)]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]


# fixed values: how pages name the parts that are not the article, and those that are
_OTHER_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "div", "div", "div", "div", "section", "ul")
_OTHER_NAMES = "ad ads advert advertisement sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs topbar header masthead footer copyright legal sidebar aside widget related recommended popular trending cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login search share social comment comments respond reply discussion disqus pagination pager tags toc skip alert".split()
_MAIN_NAMES = "content article post entry story main body text maincontent page".split()


def laid_out(words: list[str], seed: int) -> str:
    """A page in one of many layouts, whose elements have data-label 1 (article) or 0."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]

    def said(n: int, end: str = ".") -> str:
        at = int(r.integers(max(1, len(words) - n)))
        return entities.escape(" ".join(words[at : at + n]).rstrip(".,") + end, quote=False)

    def other(inside: bool = False) -> str:
        tag, name = pick(_OTHER_TAGS), pick(_OTHER_NAMES)
        named = f' class="{name}"' if tag in ("div", "section", "ul") or r.random() < 0.3 else ""
        named = named.replace("class", "id") if r.random() < 0.2 else named
        if inside and tag in ("nav", "header", "footer"):
            tag, named = "div", f' class="{name}"'
        kind = r.random()
        if tag == "ul" or kind < 0.35:
            items = "".join(f'<li><a href="/{i}">{said(int(r.integers(1, 4)), "")}</a></li>' for i in range(int(r.integers(2, 8))))
            return f'<{tag}{named} data-label="0">{items if tag == "ul" else f"<ul>{items}</ul>"}</{tag}>'
        if kind < 0.5:
            return f'<{tag}{named} data-label="0">&copy; {said(int(r.integers(3, 14)))}</{tag}>'
        if kind < 0.75:
            return f'<{tag}{named} data-label="0">{said(int(r.integers(2, 18)))}</{tag}>'
        inner = "".join(f"<p>{said(int(r.integers(4, 40)))}</p>" for _ in range(int(r.integers(1, 5))))
        return f'<{tag}{named} data-label="0"><h3>{said(2, "")}</h3>{inner}</{tag}>'

    def paragraph() -> str:
        kind, t = r.random(), said(int(r.integers(2, 110)))
        if kind < 0.7:
            return f"<p>{t}</p>" if r.random() < 0.85 else f"<p><b>{t}<br>"
        if kind < 0.8:
            return f"<h2>{said(int(r.integers(2, 9)), '')}</h2>"
        if kind < 0.88:
            items, kind = [said(int(r.integers(4, 25))) for _ in range(int(r.integers(2, 5)))], pick(("ul", "ol", "dl"))
            return f"<{kind}>" + "".join(f"<dt>{said(1, '')}</dt><dd>{x}</dd>" if kind == "dl" else f"<li>{x}</li>" for x in items) + f"</{kind}>"
        return pick((f"<blockquote>{t}</blockquote>", f"<p>{t} <a href='/x'>{said(3, '')}</a> {said(5)}</p>", f"<div>{t}</div>", f"<pre>{t}</pre>", f"<table><tr><td>{said(3, '')}</td><td>{said(4)}</td></tr></table>", f"<figure><figcaption>{said(6)}</figcaption></figure>", f"<section><h3>{said(3, '')}</h3><p>{t}</p></section>"))

    body = [f"<h1>{said(int(r.integers(3, 12)), '')}</h1>"] if r.random() < 0.9 else []
    if body and r.random() < 0.25:
        body = [f'<header data-label="1">{body[0]}</header>']
    for _ in range(int(r.integers(1, 14))):
        body.append(paragraph())
        if r.random() < 0.15:
            body.append(other(inside=True))
    if r.random() < 0.25:
        body.append(f'<{(t := pick(("div", "section")))} class="{pick(("comments", "comment-list", "responses", "discussion"))}" data-label="0">' + "".join(f"<p>{said(int(r.integers(3, 60)))}</p>" for _ in range(int(r.integers(1, 5)))) + f"</{t}>")
    kind = r.random()
    tag = "article" if kind < 0.4 else "main" if kind < 0.55 else pick(("div", "section", "div"))
    named = f' {pick(("class", "id"))}="{pick(_MAIN_NAMES)}{pick(("", "-" + pick(_MAIN_NAMES)))}"' if tag in ("div", "section") or r.random() < 0.3 else ""
    article = f'<{tag}{named} data-label="1">{"".join(body)}</{tag}>'
    above = "".join(other() for _ in range(int(r.integers(0, 4))))
    below = "".join(other() for _ in range(int(r.integers(0, 4))))
    if r.random() < 0.2:
        article = f"<div class='{pick(('wrapper', 'container', 'row', 'page'))}'>{article}{other() if r.random() < 0.5 else ''}</div>"
    return f"<html><body>{above}{article}{below}</body></html>"


_AWAY = frozenset("nav aside footer form menu dialog".split())


def train(pages: DataFrame, sample: int = SAMPLE) -> Field:
    """A field learned from `sample` pages and three laid-out pages from the words of each; the same for the same sample."""
    rows = hashed_sample(pages.filter("html is not null").select("page_id", F.col("html").cast("string").alias("html")), ["page_id", "html"], sample)
    known: list[tuple[list[list[int]], list[int], list[int]]] = []
    for number, page in enumerate(rows.column("html").to_pylist()):
        blocks = leaf_blocks(page)
        if any("article" in b.path or "main" in b.path for b in blocks):
            known.append((features(blocks), steps(blocks), [int(("article" in b.path or "main" in b.path) and not _AWAY & set(b.path) and not b.names & set(_OTHER_NAMES)) for b in blocks]))
        words = " ".join(b.text for b in blocks).split() or ["text"]
        for i in range(3):
            made = leaf_blocks(laid_out(words, 3 * number + i))
            if made:
                known.append((features(made), steps(made), [int(b.label == "1") for b in made]))
    return Field().fit(known)


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    text joins the article's blocks by two line ends, with character references decoded and white space
    inside a block as one space; null or empty html, and pages without an article, give ''. n_chars counts code
    points. Every page is read whole, however long; extra columns are ignored and repeated rows stay. Labels of
    equal probability go to "not article". The field is learned from at most `sample` pages, whole ones.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page or "")
                texts.append("\n\n".join(b.text for b, keep in zip(blocks, field.labels(features(blocks), steps(blocks)), strict=True) if keep))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
