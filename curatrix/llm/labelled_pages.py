"""Labelled pages: layouts as sites build them, every block marked as main text or not, filled with random words.

Nothing in the tables says which blocks of a page are its main text, so the layouts are the labelled data. The words mean nothing;
what a model can learn is how elements, their names and the shape of texts go together.
"""

from __future__ import annotations

import random

# Names that sites give to their parts.
MAIN_NAMES = ["content", "main", "article", "story", "post", "entry", "body", "text", "article-body", "post-content", "entry-content", "story-body", "main-content", "page-content"]
PART_NAMES = {
    "nav": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "skip", "toolbar", "tabs", "toc"],
    "header": ["header", "masthead", "banner", "site-header", "logo", "branding", "top", "tagline"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "bottom", "legal", "contentinfo", "imprint"],
    "side": ["sidebar", "widget", "rail", "related", "recent", "popular", "trending", "tags", "recommended", "complementary", "teaser", "more", "aside", "links", "author-bio"],
    "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer", "newsletter", "subscribe", "paywall", "privacy", "warning", "cookie-banner"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "promotion", "adsense", "commercial", "advertising"],
    "form": ["form", "search", "login", "signup", "contact", "subscribe-form", "register", "feedback", "poll"],
    "comments": ["comments", "comment", "comment-list", "commentlist", "discussion", "replies", "reply", "respond", "responses", "disqus", "reader-comments", "reviews"],
    "share": ["share", "social", "sharing", "follow", "print", "meta", "byline", "tools"],
}
SYLLABLES = ["ra", "ti", "no", "el", "mu", "sha", "in", "or", "ve", "qui", "den", "lo", "st", "pa", "ein", "ou", "cia", "ber", "ly", "th"]


class Writer:
    """Random pages as pieces of (html, is main text)."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.draw.choices(SYLLABLES, k=self.draw.randint(1, 4))) for _ in range(self.draw.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 20) -> str:
        return self.words(low, high).capitalize() + self.draw.choice([".", ".", ".", "?", "!", ""])

    def prose(self) -> str:
        if self.draw.random() < 0.15:  # lists of words, signs and numbers without any sentence
            return self.draw.choice(["", "| ", "*** ", "12 "]) + self.words(5, 130)
        return " ".join(self.sentence() for _ in range(self.draw.choice([1, 1, 2, 4, 8])))

    def named(self, names: list[str]) -> str:
        name = self.draw.choice(names)
        return self.draw.choice([f' class="{name}"', f' id="{name}"', f' class="{self.words(1, 1)} {name}"', f' class="{name}-{self.words(1, 1)}"'])

    def wrap(self, out: list, tag: str, attributes: str, inner: list) -> None:
        out += [(f"<{tag}{attributes}>", None), *inner, (f"</{tag}>", None)]

    def leaf(self, out: list, tag: str, text: str, keep: bool, attributes: str = "") -> None:
        out += [(f"<{tag}{attributes}>", None), (text, keep), (self.draw.choice([f"</{tag}>"] * 9 + [""]) if tag in ("p", "li") else f"</{tag}>", None)]

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high)}</a>'

    def part(self, kind: str) -> list:
        """One part of a page that is not main text."""
        out: list = []
        inner: list = []
        d = self.draw
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        if kind in ("nav", "share"):
            for _ in range(d.randint(2, 7)):
                self.leaf(inner, "li", self.link(), False)
            inner = [("<ul>", None), *inner, ("</ul>", None)]
        elif kind == "header":
            self.leaf(inner, d.choice(["h1", "h2", "div", "p"]), d.choice([self.link(), self.words(1, 4), self.sentence()]), False)
            if d.random() < 0.5:
                self.leaf(inner, "p", self.sentence(), False)
        elif kind == "footer":
            self.leaf(inner, d.choice(["p", "div", "span"]), "&copy; " + self.words(1, 3) + " &middot; " + self.sentence(), False)
            if d.random() < 0.5:
                self.leaf(inner, "p", " ".join(self.link() for _ in range(3)), False)
        elif kind == "side":
            self.leaf(inner, d.choice(["h2", "h3", "h4", "div"]), self.words(1, 3), False)
            for _ in range(d.randint(1, 4)):
                self.leaf(inner, d.choice(["li", "p", "div"]), d.choice([self.link(2, 8), self.sentence(), self.prose()]), False)
        elif kind == "notice":
            self.leaf(inner, d.choice(["p", "div", "span"]), self.prose(), False)
            self.leaf(inner, "button", self.words(1, 2), False)
        elif kind == "ad":
            inner = [(d.choice([self.sentence(), self.prose(), self.link(2, 6)]), False)]
            if d.random() < 0.4:
                inner = [("<p>", None), *inner, ("</p>", None)]
        elif kind == "form":
            for _ in range(d.randint(1, 4)):
                self.leaf(inner, d.choice(["label", "p", "div", "option", "button", "legend"]), d.choice([self.words(1, 4), self.sentence()]), False)
                inner.append(("<input type=text>", None))
        elif kind == "comments":
            self.leaf(inner, d.choice(["h2", "h3", "p"]), self.words(1, 3), False)
            for _ in range(d.randint(1, 5)):
                one: list = []
                self.leaf(one, d.choice(["b", "p", "cite", "div"]), self.words(1, 3), False)
                self.leaf(one, "p", self.prose(), False)
                self.wrap(inner, d.choice(["div", "li", "article"]), d.choice(["", self.named(PART_NAMES[kind])]), one)
        if tag and d.random() < 0.6:
            self.wrap(out, tag, d.choice(["", "", self.named(PART_NAMES[kind])]), inner)
        else:
            self.wrap(out, d.choice(["div", "div", "section", "ul" if kind == "nav" else "div"]), self.named(PART_NAMES[kind]), inner)
        return out

    def body(self) -> list:
        """Main text, now and then with a strange part inside."""
        out: list = []
        d = self.draw
        if d.random() < 0.85:
            self.leaf(out, "h1", d.choice([self.words(2, 10), self.sentence()]), True)
        for _ in range(d.randint(1, 12)):
            kind = d.random()
            if d.random() < 0.1:
                inner = []
                for tag in d.choices(["p", "p", "p", "h2", "div"], k=d.randint(1, 4)):
                    self.leaf(inner, tag, d.choice([self.prose(), self.sentence(), self.words(1, 5)]), True)
                self.wrap(out, d.choice(["section", "div", "div"]), d.choice(["", f' class="{self.words(1, 1)}"']), inner)
            if kind < 0.7:
                text = d.choice([self.prose(), self.prose(), self.sentence(1, 6)])
                if d.random() < 0.2:
                    text += " " + self.link(1, 5) + " " + self.sentence()
                self.leaf(out, "p", d.choice([text, text, f"<b>{text}<br>"]), True)
            elif kind < 0.78:
                self.leaf(out, d.choice(["h2", "h3"]), self.words(1, 6), True)
            elif kind < 0.84:
                inner: list = []
                for _ in range(d.randint(2, 5)):
                    self.leaf(inner, "li", d.choice([self.sentence(), self.words(1, 6)]), True)
                self.wrap(out, d.choice(["ul", "ol"]), "", inner)
            elif kind < 0.88:
                self.leaf(out, d.choice(["blockquote", "pre", "figcaption", "div", "dd"]), self.prose(), True)
            elif kind < 0.90:
                inner = []
                for _ in range(d.randint(2, 6)):
                    self.leaf(inner, d.choice(["td", "th"]), self.words(1, 5), True)
                self.wrap(out, "table", "", [("<tr>", None), *inner, ("</tr>", None)])
            else:
                out += self.part(d.choice(["ad", "ad", "share", "side", "form", "notice", "nav"]))
        return out

    def page(self) -> list[tuple[str, bool | None]]:
        d = self.draw
        out: list = [("<!DOCTYPE html><html><head><title>x</title></head><body>", None)]
        for kind in ("notice", "header", "nav", "ad", "form"):
            if d.random() < 0.5:
                out += self.part(kind)
        main = self.body()
        if d.random() < 0.25:
            main += self.part("comments")
        tag = d.choice(["article", "article", "main", "div", "div", "div", "section", "td"])
        self.wrap(out, tag, d.choice(["", self.named(MAIN_NAMES)]) if tag in ("article", "main") else self.named(MAIN_NAMES), main)
        for kind in d.sample(["comments", "side", "ad", "share", "form", "nav", "notice"], 3):
            if d.random() < 0.5:
                out += self.part(kind)
        if d.random() < 0.8:
            out += self.part("footer")
        outer = d.random()
        if outer < 0.3:
            out = [*out[:1], (f"<div{self.named(['page', 'wrapper', 'container', 'site', 'layout'])}>", None), *out[1:], ("</div>", None)]
        return [*out, ("</body></html>", None)]


def labelled_pages(n: int, seed: int = 7) -> list[list[tuple[str, bool | None]]]:
    """Pages as pieces of html; pieces with text say whether it is main text."""
    return [Writer(seed * 100_003 + i).page() for i in range(n)]
