"""HTML pages as sequences of text blocks with their tag paths, and synthetic labelled pages to learn from."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np

#: Element names by how they shape text (fixed values of the HTML standard).
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe input label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul video audio canvas object".split())
SILENT = set("head title script style template noscript svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: What a head may hold; anything else, or text, ends it. Elements whose inside no tag from outside closes, or none that opens there.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
SEALED = set("template noscript".split())
DRAWN = set("svg math".split())
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float


@dataclass
class _Open:
    tag: str
    tokens: tuple[str, ...] = ()


class BlockReader(HTMLParser):
    """Collects a page's blocks: the text between block-level tags, white space made one space, with the path of open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.link_chars = self.chars = 0
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            path = tuple(t for o in self.stack if o.tag in BLOCK for t in o.tokens)
            self.blocks.append(Block(text, path, self.link_chars / max(1, self.chars)))
        self.parts.clear()
        self.link_chars = self.chars = 0

    def close_to(self, tags: set, stops: tuple[str, ...] | set = ()) -> None:
        """Closes the innermost of ``tags`` and all within it, unless one of ``stops`` lies between."""
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k].tag
            if tag in tags:
                del self.stack[k:]
                return
            if tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD:
            self._end_head()
        if tag in BLOCK:
            if not self._sealed():
                self.flush()
            self.close_to(DRAWN, SEALED | {"foreignobject"})  # a block ends a drawing that was left open
            if tag != "button":
                self.close_to({"p"}, SEALED | {"td", "th", "li", "div", "button", "foreignobject"})
            if tag in CLOSES:
                names, stops = CLOSES[tag]
                self.close_to(set(names.split()), SEALED.union(stops))
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            own = [tag] if tag in BLOCK else []
            for name, value in attrs:
                if name in ("class", "id", "role") and value and tag in BLOCK:
                    own += [f".{w}" for w in NAME.findall(value.lower())]
            self.stack.append(_Open(tag, tuple(own)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self._sealed():
            self.flush()
        self.close_to({tag}, SEALED - {tag})

    def _sealed(self) -> bool:
        return any(o.tag in SEALED for o in self.stack)

    def _end_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        if any(o.tag in SILENT for o in self.stack):
            return
        self.parts.append(data)
        n = len(data.strip())
        self.chars += n
        if any(o.tag == "a" for o in self.stack):
            self.link_chars += n


def read_blocks(html: str | None) -> list[Block]:
    if not isinstance(html, str) or not html:
        return []
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


@lru_cache(maxsize=1)
def invented_words(n: int = 8000) -> list[str]:
    parts = "an er ti th on re le de la en ch ung ció ou st in es qu ma ro".split()
    rng = np.random.RandomState(3)
    return ["".join(rng.choice(parts, rng.randint(1, 4))) for _ in range(n)]


@dataclass
class PageMaker:
    """Random pages of many layouts whose blocks' labels are known; words are invented, so that none gives a label away by itself."""

    seed: int
    rng: np.random.RandomState = field(init=False)

    def __post_init__(self) -> None:
        self.rng = np.random.RandomState(self.seed)

    def pick(self, options: str) -> str:
        return self.rng.choice(options.split())

    def words(self, low: int, high: int) -> str:
        every = invented_words()
        text = " ".join([every[k] for k in self.rng.randint(0, len(every), self.rng.randint(low, high)).tolist()])
        return text.capitalize() + self.rng.choice([".", "", "!", ":"], p=[0.7, 0.2, 0.05, 0.05])

    def mark(self, name: str) -> str:
        """Attributes that carry ``name`` in one of the usual ways, among meaningless ones."""
        extra = self.rng.choice(["", " col", " wrapper", " box", " block", " inner", " widget"])
        key = "id" if self.rng.rand() < 0.2 else "class"
        return f' {key}="{name}{extra}"'

    def links(self, n: int) -> str:
        items = [f'<li><a href="#">{self.words(1, 4)}</a></li>' for _ in range(n)]
        return f"<ul>{''.join(items)}</ul>"

    def outside(self) -> str:
        """A piece of page furniture; nothing of it is main text."""
        kind = self.rng.randint(12)
        n = self.rng.randint(2, 8)
        if kind == 0:
            return f"<nav{self.mark('menu') if self.rng.rand() < 0.4 else ''}>{self.links(n)}</nav>"
        if kind == 1:
            return f"<header{self.mark('site-header') if self.rng.rand() < 0.4 else ''}><div>{self.words(1, 5)}</div><p>{self.words(2, 9)}</p></header>"
        if kind == 2:
            return f"<aside{self.mark('sidebar') if self.rng.rand() < 0.5 else ''}><h3>{self.words(1, 4)}</h3>{self.links(n)}<p>{self.words(4, 40)}</p></aside>"
        if kind == 3:
            name = self.pick("ad ads advert advertisement sponsored promo banner ad-slot adbox")
            body = self.words(2, 30)
            return f"<div{self.mark(name)}>{body if self.rng.rand() < 0.5 else f'<p>{body}</p>'}</div>"
        if kind == 4:
            name = self.pick("cookie cookie-banner consent notice alert gdpr popup modal")
            return f"<div{self.mark(name)}><p>{self.words(4, 30)}</p><button>{self.words(1, 3)}</button></div>"
        if kind == 5:
            return f"<form><label>{self.words(1, 4)}</label><input><select><option>{self.words(1, 3)}</option><option>{self.words(1, 3)}</option></select><p>{self.words(2, 12)}</p><button>{self.words(1, 3)}</button></form>"
        if kind == 6:
            name = self.pick("share social related recommended newsletter subscribe breadcrumb pagination tags promo-links menu sidebar nav topbar")
            return f"<div{self.mark(name)}>{self.links(n) if self.rng.rand() < 0.6 else f'<p>{self.words(3, 30)}</p>'}</div>"
        if kind == 7:
            tag, name = self.pick("section div ul"), self.pick("comments comment-list discussion replies responses user-comments")
            inner = "li" if tag == "ul" else "div"
            each = "".join(f"<{inner}{self.mark('comment')}><span>{self.words(1, 3)}</span><p>{self.words(4, 60)}</p></{inner}>" for _ in range(n))
            return f"<{tag}{self.mark(name)}>{f'<h3>{self.words(1, 3)}</h3>' if tag != 'ul' else ''}{each}</{tag}>"
        if kind in (8, 9):
            inner = self.words(3, 30)
            return f"<footer{self.mark('footer') if self.rng.rand() < 0.3 else ''}>{self.rng.choice(['&copy; ', ''])}{inner if self.rng.rand() < 0.5 else f'<p>{inner}</p>'}</footer>"
        if kind == 10:
            return f"<div{self.mark(self.pick('footer header site-footer copyright masthead'))}><p>{self.words(3, 25)}</p></div>"
        return f"<div{self.mark(self.pick('comments comment'))}><p>{self.words(4, 60)}</p></div>"

    def inside(self) -> list[str]:
        """Pieces of main text."""
        out = [f"<h1>{self.words(2, 12)}</h1>"] if self.rng.rand() < 0.8 else []
        for _ in range(self.rng.randint(1, 10) if self.rng.rand() < 0.92 else self.rng.randint(10, 80)):
            kind = self.rng.randint(10)
            if kind < 6:
                text = self.words(3, 120)
                out.append(self.rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p>{text} <a href="#">{self.words(1, 4)}</a> {self.words(2, 20)}</p>', f"<div>{text}</div>"], p=[0.6, 0.1, 0.1, 0.15, 0.05]))
            elif kind == 6:
                out.append(f"<{(t := self.pick('h2 h3'))}>{self.words(1, 8)}</{t}>")
            elif kind == 7:
                out.append(f"<{(t := self.pick('ul ol'))}>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(self.rng.randint(1, 6))) + f"</{t}>")
            elif kind == 8:
                out.append(f"<blockquote>{self.words(4, 40)}</blockquote>" if self.rng.rand() < 0.6 else f"<pre>{self.words(3, 30)}</pre>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(self.rng.randint(1, 5))) + "</table>")
        return out

    def page(self) -> tuple[list[Block], np.ndarray]:
        """A page's blocks and which of them are main text."""
        body, main = [], self.inside()
        for k in range(len(main), 0, -1):  # furniture within the article
            if self.rng.rand() < 0.06:
                main.insert(k, f"\0{self.outside()}\0")
        shape = self.rng.rand()
        if shape < 0.7:
            tag = self.pick("article article article main section")
            head, tail = f"<{tag}{self.mark(self.pick('post story entry')) if self.rng.rand() < 0.3 or tag == 'section' else ''}>", f"</{tag}>"
        elif shape < 0.92:
            head, tail = f"<div{self.mark(self.pick('content post entry article story main post-content article-body entry-content text'))}>", "</div>"
        else:
            head = tail = ""
        if self.rng.rand() < 0.3 and head:
            wrap = self.rng.choice(["<main>", f"<div{self.mark(self.pick('container page layout content'))}>"])
            head, tail = wrap + head, tail + ("</main>" if wrap == "<main>" else "</div>")
        body += [f"\0{self.outside()}\0" for _ in range(self.rng.randint(0, 5))]
        body += [head, *main, tail]
        body += [f"\0{self.outside()}\0" for _ in range(self.rng.randint(0, 5))]
        # text of furniture is marked to read its label back
        html = "".join(re.sub(r">([^<]+)", ">\x01\\1", p.strip("\0")) if p.startswith("\0") else p for p in body)
        blocks = read_blocks(f"<html><body>{html}</body></html>")
        label = np.array(["\x01" not in b.text for b in blocks], float)
        return [Block(b.text.replace("\x01", "").strip(), b.path, b.linked) for b in blocks], label
