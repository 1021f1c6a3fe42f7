"""Main text of web pages by consensus host paths.

Each page scores its containers; the path of tags and classes, digits generalised, of the one that holds its text is a
vote. Votes are counted per host in Spark, and every page is extracted again at its host's winning path (a page that
lacks that path uses its own vote).

What goes from inside of the chosen container is only what is marked as menu, header, footer, sidebar, notice, advert,
form, script, style or comments; a form around the article, or around half of the page's text, is no form in this sense.
What a page has beside the chosen container, without an article element around, is its article too. Words that may name such a thing or a part of an article ("related", "banner") lower a
container's score, and what they mark goes only if most of its text is links.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import map_batches, pieces

TAG = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|([!?])[^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z))""", re.S)
ATTRS = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Element names by kind, and words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object select textarea head title audio video".split())
JUNK_TAGS = frozenset("nav aside footer menu dialog".split())
CONTAINERS = frozenset("article main section div td body blockquote ul ol table tbody tr dl figure details center header footer nav aside form menu dialog fieldset html".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption hr th thead tfoot caption summary hgroup legend".split())
JUNK_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion sidebar comment comments disqus cookie cookies notice notices consent gdpr menu menus nav navbar navigation breadcrumb breadcrumbs footer newsletter form forms".split())
#: May stand beside a word of the above in a name of the same thing, as in comment-list or cookiebar.
PLAIN_WORDS = frozenset("area bar block body bottom box child children container content count entry header in info inline inner item items label left line link links list main meta n note one page panel post primary right row secondary section site slot small space text thread title top unit widget wrap wrapper zone".split())
#: May name a part of an article just as well.
WEAK_WORDS = frozenset("alert banner header hidden login masthead modal overlay pager pagination popup recommended recommendations related respond search share sharing signup skip social subscribe subscription toc toolbar widget widgets".split())
JUNK_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog menu menubar".split())
WEIGHT = {"article": 3.0, "main": 2.5, "body": 0.1, "html": 0.05}
WEAK_WEIGHT = 0.1
#: Text that is shorter and does not end like a sentence may be a label of the page; alone it does not make what is beside the
#: chosen container a part of the article.
LABEL = 60
#: A page whose own best container has so many times the text of the host's is extracted at the host's path alone.
OUTVOTED = 4

_sentence = re.compile(r"""[.!?…:;。！？：；]["'”’»)\]]*$""")
_raw_ends = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_words = re.compile(r"[a-z]+")
_digits = re.compile(r"\d+")
_glued = re.compile("(" + "|".join(sorted((w for w in JUNK_WORDS if len(w) > 5), key=len, reverse=True)) + ")([a-z]*)")


def _names_junk(token: str) -> bool:
    """All words of a class or id name such a thing or are plain, and one does."""
    found = False
    for word in _words.findall(token):
        m = _glued.fullmatch(word)
        if word in JUNK_WORDS or m and m[2] in PLAIN_WORDS:
            found = True
        elif word not in PLAIN_WORDS:
            return False
    return found


def _kind(tag: str, attrs: dict[str, str], in_article: bool) -> str:
    """"junk", "weak" or ""."""
    if tag in JUNK_TAGS or attrs.get("role") in JUNK_ROLES or tag == "header" and not in_article:
        return "junk"
    if tag in ("html", "body", "article", "main"):
        return ""
    tokens = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    if any(_names_junk(t) for t in tokens):
        return "junk"
    return "weak" if any(WEAK_WORDS.intersection(_words.findall(t)) for t in tokens) else ""


def parse(page: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, str, bool]]]:
    """Blocks (container, text, characters of links) outside of junk, and containers (parent, tag, label, weak)."""
    nodes: list[tuple[int, str, str, bool]] = [(-1, "", "", False)]
    blocks: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, container, in junk
    buf: list[str] = []
    links = anchors = articles = at = 0
    search, n = TAG.search, len(page)

    def flush() -> None:
        nonlocal links
        if buf:
            text = " ".join(entities.unescape("".join(buf)).split())
            if text:
                blocks.append((stack[-1][1], text, links))
            buf.clear()
        links = 0

    while at < n:
        m = search(page, at)
        end = m.start() if m else n
        if end > at and not stack[-1][2]:
            piece = page[at:end]
            buf.append(piece)
            if anchors:
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if m[3]:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        flush()
                        articles -= sum(x[0] in ("article", "main") for x in stack[k:])
                        del stack[k:]
                        break
            continue
        if name in RAW:
            close = _raw_ends[name].search(page, at)
            if not m[5].endswith("/"):
                at = close.end() if close else n if name in ("script", "style") else at
            if name not in ("svg", "select", "object"):
                flush()
            continue
        if name == "br":
            buf.append(" ")
        elif name == "a":
            anchors += 1
        if name not in BLOCKS:
            continue
        flush()
        tag, node, junk = stack[-1]
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or tag == name in ("li", "dt", "dd", "td", "tr", "th"):
            stack.pop()  # its end tag was left out
            tag, node, junk = stack[-1]
        if name in VOID:
            continue
        anchors = 0 if name in CONTAINERS else anchors
        if name in CONTAINERS:
            attrs = {a.lower(): b or c or d or "" for a, b, c, d in ATTRS.findall(m[5])} if m[5].strip() else {}
            if not junk:
                kind = _kind(name, attrs, articles > 0)
                junk = kind == "junk"
                label = f"{name}.{_digits.sub('N', (attrs.get('class', '').split() or [''])[0])}" if attrs.get("class") else name
                nodes.append((node, "main" if attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody" else name, label, kind == "weak"))
                node = len(nodes) - 1
            articles += name in ("article", "main")
        elif not junk and m[5].strip():
            junk = _kind(name, {a.lower(): b or c or d or "" for a, b, c, d in ATTRS.findall(m[5])}, articles > 0) == "junk"
        stack.append((name, node, junk))
    flush()
    for test, kept_out in ((any(weak for *_, weak in nodes), _link_lists), (any(tag == "form" for _, tag, *_ in nodes), _small_forms)):
        if test:
            gone = kept_out(blocks, nodes)
            blocks = [b for b in blocks if not gone[b[0]]]
    return blocks, nodes


def _small_forms(blocks, nodes) -> list[bool]:
    """Whether a container is, or lies in, a form that is no frame of the page: it holds neither an article nor half of all text
    that is no link."""
    prose, holds = [0] * len(nodes), [tag in ("article", "main") for _, tag, *_ in nodes]
    for node, text, links in blocks:
        prose[node] += max(len(text) - links, 0)
    for k in range(len(nodes) - 1, 0, -1):
        prose[nodes[k][0]] += prose[k]
        holds[nodes[k][0]] |= holds[k]
    gone = [False] * len(nodes)
    for k in range(1, len(nodes)):
        gone[k] = gone[nodes[k][0]] or nodes[k][1] == "form" and not holds[k] and 2 * prose[k] < prose[0]
    return gone


def _link_lists(blocks, nodes, any_kind: bool = False) -> list[bool]:
    """Whether a container is, or lies in, a weak one (or, if so stated, any one) of whose text half or more is links."""
    size, linked = [0] * len(nodes), [0] * len(nodes)
    for node, text, links in blocks:
        size[node] += len(text)
        linked[node] += min(links, len(text))
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        size[nodes[k][0]] += size[k]
        linked[nodes[k][0]] += linked[k]
    gone = [False] * len(nodes)
    for k in range(1, len(nodes)):
        gone[k] = gone[nodes[k][0]] or (any_kind or nodes[k][3]) and size[k] > 0 and 2 * linked[k] >= size[k]
    return gone


def paths(nodes: list[tuple[int, str, str, bool]]) -> list[str]:
    """Generalised path of each container, from below html and body."""
    out = [""] * len(nodes)
    for k, (parent, tag, label, _) in enumerate(nodes):
        if k:
            out[k] = out[parent] if tag in ("html", "body") else f"{out[parent]}>{label}"
    return out


def highest(blocks: list[tuple[int, str, int]], nodes: list[tuple[int, str, str, bool]]) -> tuple[int, float]:
    """The container with the highest score, and that score."""
    score = [0.0] * len(nodes)
    for node, text, links in blocks:
        worth = len(text) - 2 * min(links, len(text))
        score[node] += worth
        if nodes[node][0] >= 0:
            score[nodes[node][0]] += worth / 2
    weighed = [s * WEIGHT.get(nodes[k][1], 1.0) * (WEAK_WEIGHT if nodes[k][3] else 1.0) for k, s in enumerate(score)]
    best = max(range(len(nodes)), key=lambda k: (weighed[k], -k))
    return best, max(weighed[best], 0.0)


def whole(best: int, blocks: list[tuple[int, str, int]], nodes: list[tuple[int, str, str, bool]]) -> int:
    """From a container up to the article around it or, without one, to the outermost that has more prose beside it: sentences,
    however short, or longer text. Text that is mostly links, or stands in a weak container, does not count."""
    above = best
    while above > 0:
        if nodes[above][1] in ("article", "main"):
            return above
        above = nodes[above][0]
    weak, prose = [False] * len(nodes), [0] * len(nodes)
    for k in range(1, len(nodes)):
        weak[k] = nodes[k][3] or weak[nodes[k][0]]
    for node, text, links in blocks:
        prose[node] += 2 * links < len(text) and (not weak[node] or weak[best]) and (len(text) >= LABEL or _sentence.search(text) is not None)
    for k in range(len(nodes) - 1, 0, -1):
        prose[nodes[k][0]] += prose[k]
    top = best
    while best > 0:
        up = nodes[best][0]
        if prose[up] > prose[best]:
            top = up
        best = up
    return top


def vote(page: str) -> tuple[str | None, float]:
    """Generalised path of the page's best container ('' for the whole body), and its score; an empty page has no vote."""
    blocks, nodes = parse(page)
    if not blocks:
        return None, 0.0
    best, score = highest(blocks, nodes)
    return paths(nodes)[whole(best, blocks, nodes)], score


def main_text(page: str | None, path: str | None) -> str:
    """Blocks of the containers at ``path``, or else at the path of the page's own best one, joined by newlines."""
    blocks, nodes = parse(page or "")
    if not blocks:
        return ""
    own = paths(nodes)
    body = ("", "html", "body")
    for step in range(2):
        best = highest(blocks, nodes)[0]
        at = own[best] if step else path
        chosen = {k for k in range(1, len(nodes)) if own[k] == at and nodes[k][1] not in body} if at else {best} if step else set()
        # what this page has beside them belongs to the article as well, but lists of links, and but where the host says
        # otherwise: a page most of whose text lies elsewhere is the odd one
        frames = {k for k in chosen if nodes[k][1] in body}
        core = _within(chosen - frames, nodes)
        size = [sum(len(t) for node, t, _ in blocks if part[node]) for part in (core, _within({best}, nodes))]
        outvoted = chosen and not frames and not core[best] and size[1] > OUTVOTED * size[0]
        inside = core if outvoted else _within(chosen | {whole(k, blocks, nodes) for k in chosen}, nodes)
        lists = _link_lists(blocks, nodes, True) if inside != core else core
        if texts := [t for node, t, links in blocks if core[node] or inside[node] and not lists[node] and 2 * links < len(t)]:
            return "\n".join(texts)
    return "\n".join(t for _, t, _ in blocks)  # nothing but links


def _within(chosen: set[int], nodes) -> list[bool]:
    inside = [False] * len(nodes)
    for k in range(len(nodes)):
        inside[k] = k in chosen or k > 0 and inside[nodes[k][0]]
    return inside


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the path with most votes, then the higher score, then first in order; '' is the whole body."""

    def run(batch: pa.RecordBatch):
        for part in pieces(batch, 64):
            votes = [vote(h) for h in part.column("html").to_pylist()]
            yield {"host": part.column("host"), "path": [p for p, _ in votes], "score": [s for _, s in votes]}

    rows = pages.where(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = map_batches(rows, run, "host string, path string, score double").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.min(F.struct(-F.col("n"), -F.round("score", 3), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row, from the whole html.

    Null and empty html, and html without text, give an empty text. A null url counts as a host of its own name ''. Pages
    that vote alike by two paths go by the higher score, then by the path's name.
    Repeated rows give repeated results; a null id stays null; other columns are not read.
    """
    winners = write_table(host_paths(pages, url_col, html_col), "host-paths").withColumnRenamed("host", "winner_host")  # small files: Spark broadcasts them if they are
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(winners, F.col("host") == F.col("winner_host"), "left").select("page_id", "url", "html", "path")

    def run(batch: pa.RecordBatch):
        for part in pieces(batch, 64):
            texts = [main_text(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
            yield {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")
