"""What the signals need to know of a page's HTML, from one pass over a small document tree."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions import whatwg
from pagewarden.functions.hosts import SuffixRules

#: Limits of what is looked at: characters of visible text, nodes of the tree.
MAX_TEXT, MAX_NODES = 50_000, 20_000
# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes plaintext".split())
IN_HEAD = set("base basefont bgsound link meta noframes script style template title noscript".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
SCOPE = {"html", "table", "td", "th", "caption", "button", "template", "object", "marquee", "applet"}
SPACE = " \t\n\f\r"


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], None

    def add(self, kid):
        if isinstance(kid, str) and self.kids and isinstance(self.kids[-1], str):
            self.kids[-1] += kid
            return
        self.kids.append(kid)
        if isinstance(kid, Node):
            kid.parent = self

    def walk(self):
        """Nodes and texts in document order, itself included."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.kids))

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))


class Tree(HTMLParser):
    """A document tree by the rules of the standard that matter for well-meant pages.

    Html, head and body are implied; open paragraphs, list items, options and table parts are closed by
    what follows them; formatting that was left open goes on in the next block. Content out of place in
    tables isn't moved in front of them, and blocks within formatting aren't taken apart.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Node("html"), None, None
        self.open, self.mode, self.formatting = [self.html], "start", []
        self.feed(html)
        self.close()
        self._to_body()

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    # -- modes: start, head, after_head, body, after_body
    def _to_head(self, attrs=None):
        if self.mode == "start":
            self.head = Node("head", attrs)
            self.html.add(self.head)
            self.open, self.mode = [self.html, self.head], "head"

    def _to_body(self, attrs=None):
        self._to_head()
        if self.mode in ("head", "after_head"):
            self.body = Node("body", attrs)
            self.html.add(self.body)
            self.open, self.mode = [self.html, self.body], "body"
        elif self.mode == "after_body":
            self.mode = "body"

    def _in_scope(self, *tags):
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in SCOPE and "button" not in tags:
                return False
        return False

    def _pop_to(self, *tags):
        while len(self.open) > 2:
            if self.open.pop().tag in tags:
                return

    def _resume_formatting(self):
        for k, node in enumerate(self.formatting):
            if node not in self.open:
                again = Node(node.tag, dict(node.attrs))
                self.open[-1].add(again)
                self.open.append(again)
                self.formatting[k] = again

    def handle_starttag(self, tag, attrs):
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        if tag == "html":
            for k, v in known.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head" and self.mode == "start":
            return self._to_head(known)
        if tag == "body":
            if self.body is None:
                return self._to_body(known)
            for k, v in known.items():
                self.body.attrs.setdefault(k, v)
            return
        if tag == "head":
            return
        if self.mode in ("start", "head", "after_head") and tag in IN_HEAD and tag != "noscript":
            self._to_head()
            node = Node(tag, known)
            (self.open[-1] if self.mode == "head" else self.head).add(node)
            if tag not in VOID:
                self.open.append(node)
            return
        self._to_body()
        self._insert(tag, known)

    def _insert(self, tag, attrs):
        if tag == "form" and any(n.tag == "form" for n in self.open):
            return
        if tag in CLOSES_P and self._in_scope("p"):
            self._pop_to("p")
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag == "li":
            self._close_item({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dd", "dt"):
            self._close_item({"dd", "dt"}, {"dl"})
        elif tag in ("option", "optgroup"):
            while self.open[-1].tag in ({"option"} if tag == "option" else {"option", "optgroup"}):
                self.open.pop()
        elif tag == "button" and self._in_scope("button"):
            self._pop_to("button")
        elif tag == "a" and (old := next((n for n in self.formatting if n.tag == "a"), None)):
            self.formatting.remove(old)
            if old in self.open:
                self._pop_to("a")
        elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            self._table_part(tag)
        if tag not in CLOSES_P and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup"):
            self._resume_formatting()
        node = Node("img" if tag == "image" else tag, attrs)
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)
        if tag in FORMATTING:
            self.formatting.append(node)

    def _close_item(self, tags, lists):
        for node in reversed(self.open):
            if node.tag in tags:
                return self._pop_to(*tags)
            if node.tag in lists or node.tag in SCOPE:
                return

    def _table_part(self, tag):
        if not any(n.tag == "table" for n in self.open):
            return
        closed = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}.get(tag, {"td", "th", "tr", "tbody", "thead", "tfoot"})
        while self.open[-1].tag != "table" and any(n.tag in closed for n in self.open[max(k for k, n in enumerate(self.open) if n.tag == "table") + 1 :]):
            self.open.pop()
        if tag in ("tr", "td", "th") and self.open[-1].tag == "table":
            self._push("tbody")
        if tag in ("td", "th") and self.open[-1].tag in ("tbody", "thead", "tfoot"):
            self._push("tr")

    def _push(self, tag):
        node = Node(tag)
        self.open[-1].add(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        if tag == "head":
            self._to_head()
            if self.mode == "head":
                self.open, self.mode = [self.html], "after_head"
            return
        if tag in ("body", "html"):
            self._to_body()
            self.mode = "after_body"
            return
        if self.mode in ("start", "head", "after_head"):
            if self.open[-1].tag == tag:
                self.open.pop()
            return
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag == "p" and not self._in_scope("p"):
            self._to_body()
            self._insert("p", {})
        if tag in FORMATTING:
            mine = [n for n in self.formatting if n.tag == tag]
            if mine:
                self.formatting.remove(mine[-1])
                if mine[-1] not in self.open:
                    return
        if any(n.tag == tag for n in self.open[2:]):
            self._pop_to(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        inside = self.open[-1].tag
        if inside in RAW or inside in ("title", "textarea"):
            return self.open[-1].add(data)
        if self.mode in ("start", "head", "after_head"):
            rest = data.lstrip(SPACE)
            blank = data[: len(data) - len(rest)]
            if blank and self.mode != "start":
                self.open[-1].add(blank)
            if not rest:
                return
            self._to_body()
            data = rest
        if self.mode == "after_body":
            if data.strip(SPACE) == "":
                return self.body.add(data)
            self.mode = "body"
        self._resume_formatting()
        self.open[-1].add(data)

    def handle_comment(self, data):
        (self.html if self.mode == "after_body" else self.open[-1]).add(Node("!", {"": data}))


def _units(text: str) -> int:
    """Length of a text in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _serialised(nodes: list) -> int:
    """Length of the outer HTML of a tree's nodes and texts in UTF-16 units."""
    total = 0
    for x in nodes:
        if isinstance(x, str):
            continue
        if x.tag == "!":
            total += 7 + _units(x.attrs[""])
            continue
        total += 2 + len(x.tag) if x.tag in VOID else 5 + 2 * len(x.tag)
        for k, v in x.attrs.items():
            total += 4 + len(k) + _units(v)
            if _ESCAPED.search(v):
                total += 4 * v.count("&") + 5 * v.count("\xa0") + 5 * v.count('"') + 3 * (v.count("<") + v.count(">"))
        raw = x.tag in RAW or x.tag == "noscript"
        for kid in x.kids:
            if isinstance(kid, str):
                total += _units(kid)
                if not raw and _ESCAPED.search(kid):
                    total += 4 * kid.count("&") + 5 * kid.count("\xa0") + 3 * (kid.count("<") + kid.count(">"))
    return total


_COPYRIGHT = re.compile("copyright", re.I)
_ESCAPED = re.compile("[&\xa0\"<>]")
_INTS = "forms passwords action_external action_empty scripts scripts_external iframes hidden anchors anchors_external anchors_null icon_external meta_refresh onsubmit nodes html_len".split()
_TEXTS = ["title", "lang", "footer_text", "body_text", "error"]
SUMMARY = ", ".join([f"{c} int" for c in _INTS] + [f"{c} string" for c in _TEXTS])


def summarize(html: str, url: str, etld1: str | None, rules: SuffixRules) -> dict:
    """The summary of one page as a dict, its body's text in lower case; etld1 is the registrable domain of the page's own URL."""
    out: dict = dict.fromkeys(_INTS, 0) | dict.fromkeys(_TEXTS, "")
    tree = Tree(html)
    base, own = whatwg.parse(url), True
    known: dict[str, bool] = {}

    def external(href: str | None) -> bool:
        if not href:
            return False
        if href not in known:
            u = whatwg.parse(href, base)
            host = u.host.rstrip(".") if u else ""
            there = rules.registrable(host) if host else None
            known[href] = there is not None and there != etld1
        return known[href]

    everything = list(tree.html.walk())  # in document order, once for all that follows
    elements = [x for x in everything if not isinstance(x, str) and x.tag != "!"]
    for e in elements:
        if e.tag == "base" and "href" in e.attrs and own:
            base, own = whatwg.parse(e.attrs["href"], base) or base, False
    footers, icon, passwords, untitled = [], None, [], True
    for e in elements:
        a = e.attrs
        if e.tag == "form":
            out["forms"] += 1
        elif e.tag == "script" and "src" in a:
            out["scripts"] += 1
            out["scripts_external"] += external(a["src"])
        elif e.tag == "iframe":
            out["iframes"] += 1
        elif e.tag == "input":
            kind = a.get("type", "text").lower()
            out["hidden"] += kind == "hidden"
            if kind == "password" or "password" in a.get("autocomplete", "").lower():
                passwords.append(e)
        elif e.tag == "a" and "href" in a:
            out["anchors"] += 1
            out["anchors_external"] += external(a["href"])
            plain = a["href"].strip().lower()
            out["anchors_null"] += plain in ("", "#") or plain.startswith("javascript:")
        elif e.tag == "link" and icon is None and "icon" in a.get("rel", "").lower().split():
            icon = a.get("href", "")
        elif e.tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            out["meta_refresh"] = 1
        elif e.tag == "title" and untitled:
            untitled = False
            out["title"] = " ".join("".join(k for k in e.kids if isinstance(k, str)).split())
        out["onsubmit"] += "onsubmit" in a
        if e.tag == "footer" or "footer" in a.get("class", "").lower() or "footer" in a.get("id", "").lower():
            footers.append(e.text())
    out["passwords"], out["icon_external"] = len(passwords), int(external(icon))
    if passwords:
        form = passwords[0]
        while form is not None and form.tag != "form":
            form = form.parent
        action = (form.attrs.get("action", "") if form is not None else "").strip()
        out["action_empty"] = int(action in ("", "#") or action.lower().startswith("javascript:"))
        out["action_external"] = int(not out["action_empty"] and external(action))
    if tree.body is not None:
        texts = [x for x in everything[everything.index(tree.body) :] if isinstance(x, str)]  # the body is the last element
        footers += [t for t in texts if "©" in t or _COPYRIGHT.search(t)]
        body = "".join(texts)
        if _units(body) > MAX_TEXT:
            body = body.encode("utf-16-le", "surrogatepass")[: 2 * MAX_TEXT].decode("utf-16-le", "ignore")
        out["body_text"] = body.lower()
    out["footer_text"], out["lang"] = " ".join(footers), tree.html.attrs.get("lang", "")
    out["nodes"], out["html_len"] = min(len(everything), MAX_NODES), _serialised(everything)
    return out


def page_summary(html: Column, url: Column, etld1: Column, rules: SuffixRules) -> Column:
    """The summary as a struct column. Null or empty HTML, and HTML that can't be read, give zeros and empty texts."""

    @F.pandas_udf(SUMMARY)
    def run(pages: pd.Series, urls: pd.Series, domains: pd.Series) -> pd.DataFrame:
        blank: dict = dict.fromkeys(_INTS, 0) | dict.fromkeys(_TEXTS, "")
        rows = []
        for page, where, domain in zip(pages, urls, domains, strict=True):
            try:
                rows.append(summarize(page, where, domain, rules) if page else blank)
            except Exception as e:  # one page's trouble isn't the table's
                rows.append(blank | {"error": f"{type(e).__name__}: {e}"[:200]})
        return pd.DataFrame(rows, columns=[*_INTS, *_TEXTS])

    return run(html, url, etld1)
