"""Labelled pages that the extraction model is trained on, made by rule.

Regions carry the attribute data-label: c for main content, b for boilerplate; what lies inside
inherits it, what has none only contains. Words, sizes, tags, nesting and class names vary by a fixed
seed. On a third of the pages all names are made up, so that the model has to tell the regions by what
they hold; articles may be a few words long, and every kind of boilerplate may stand inside them.
"""

from __future__ import annotations

import random

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split()
CONTENT_NAMES = ["content", "main", "article", "post", "entry", "entry-content", "post-content", "article-body", "story", "body-text", "text", "main-content", "blog-post", "page-content", "rich-text", "prose", "single", "hentry"]
MENU_NAMES = ["nav", "menu", "navbar", "navigation", "main-menu", "topbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "links", "tabs", "skip-links", "site-nav", "toolbar"]
HEADER_NAMES = ["header", "masthead", "site-header", "page-header", "banner", "top", "branding", "logo", "head"]
FOOTER_NAMES = ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "foot", "credits", "page-footer"]
SIDE_NAMES = ["sidebar", "side", "aside", "widget", "widgets", "related", "related-posts", "recommended", "popular", "trending", "tags", "tag-cloud", "archive", "author-box", "bio", "rail", "more", "see-also", "secondary"]
NOTICE_NAMES = ["cookie", "cookies", "cookie-notice", "notice", "alert", "consent", "gdpr", "message", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "disclaimer", "announcement", "warning", "toast"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner-ad", "ad-slot", "ad-container", "dfp", "taboola", "outbrain", "commercial", "affiliate"]
FORM_NAMES = ["search", "login", "contact-form", "form", "search-form", "register", "comment-form", "feedback", "poll", "survey"]
COMMENT_NAMES = ["comments", "comment", "comment-list", "disqus", "responses", "replies", "discussion", "reader-comments", "comment-body", "user-comments", "reviews", "feedback-list"]
SHARE_NAMES = ["share", "social", "sharing", "share-buttons", "social-links", "follow", "meta", "byline-links"]


class Maker:
    def __init__(self, seed: int, invented: float = 0.0):
        self.r, self.invented, self.plain_names = random.Random(seed), invented, True

    def invent(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(3, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(WORDS) for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 6, high: int = 90) -> str:
        text = self.words(low, high).capitalize() + self.r.choice(["."] * 12 + ["!", "!!", "?", ":", ""])
        if self.r.random() < 0.4:  # commas within
            text = text.replace(" ", ", ", 1)
        if self.r.random() < 0.3:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.words(3, 20)}.'
        if self.r.random() < 0.2:
            text = f"<b>{self.words(1, 4)}</b> " + text
        return text

    def name(self, names: list[str]) -> str:
        if self.r.random() < 0.3:
            return ""
        if not self.plain_names:
            return f' class="{self.invent()}"'
        kind = "id" if self.r.random() < 0.3 else "class"
        more = f" {self.r.choice(['box', 'container', 'wrapper', 'block', 'row', 'inner', 'clearfix', 'section'])}" if self.r.random() < 0.3 and kind == "class" else ""
        return f' {kind}="{self.r.choice(names)}{more}"'

    def links(self) -> str:
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(self.r.randint(2, 9))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items)

    def boiler(self, tag: str, names: list[str], inner: str, always_named: bool = False) -> str:
        name = self.name(names)
        while always_named and not name:
            name = self.name(names)
        if self.r.random() < 0.15:
            inner = f"<div{self.name(['inner', 'wrap', 'box', 'container', 'row'])}>{inner}</div>"
        return f'<{tag} data-label="b"{name}>{inner}</{tag}>'

    def menu(self) -> str:
        plain = self.r.random() < 0.6
        return self.boiler("nav" if plain else "div", MENU_NAMES, self.links(), not plain)

    def header(self) -> str:
        plain = self.r.random() < 0.6
        inner = self.r.choice([f'<a href="/">{self.words(1, 3)}</a>', f"<h2>{self.words(1, 4)}</h2>{self.links()}", f"<p>{self.words(2, 8)}</p>", self.links()])
        return self.boiler("header" if plain else "div", HEADER_NAMES, inner, not plain)

    def footer(self) -> str:
        plain = self.r.random() < 0.7
        inner = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(4, 20)}", f"<p>&copy; 2020 {self.words(2, 6)}</p>{self.links()}", f"<p>Copyright {self.words(1, 6)}</p>", self.links(), f"<p>{self.prose(5, 40)}</p>"])
        return self.boiler("footer" if plain else "div", FOOTER_NAMES, inner, not plain)

    def side(self) -> str:
        plain = self.r.random() < 0.6
        inner = f"<h3>{self.words(1, 3)}</h3>" * (self.r.random() < 0.6) + self.r.choice([self.links(), f"<p>{self.prose(5, 40)}</p>", f"<div>{self.words(3, 12)}</div>"])
        return self.boiler("aside" if plain else "div", SIDE_NAMES, inner, not plain)

    def notice(self) -> str:
        inner = self.r.choice([f"<p>{self.prose(5, 30)}</p>", self.prose(5, 25), f"{self.words(4, 12)} <button>{self.words(1, 2)}</button>"])
        return self.boiler(self.r.choice(["div", "div", "section", "dialog", "p"]) if "<p>" not in inner else "div", NOTICE_NAMES, inner, True)

    def advert(self) -> str:
        inner = self.r.choice([self.prose(3, 20), f'<a href="/ad">{self.words(2, 8)}</a>', f"<p>{self.prose(4, 25)}</p>"])
        return self.boiler(self.r.choice(["div", "div", "aside", "section", "ins"]), AD_NAMES, inner, True)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q>" + self.r.choice(["", f"<p>{self.prose(3, 15)}</p>"]) + f"<button>{self.words(1, 2)}</button>"
        return self.boiler("form", FORM_NAMES, inner)

    def comments(self) -> str:
        most = self.r.choice([5, 20, 40, 60])
        said = lambda: self.r.choice([f"<b>{self.words(1, 2)}</b><p>{self.said(most)}</p>", f"<p>{self.said(most)}</p>", f"<p><b>{self.words(1, 2)}</b>: {self.said(most)}</p>", f"{self.words(1, 2)}: {self.said(most)}"])
        kind, one = self.r.choice(["", "div", "li", "article", "section"]), self.name(COMMENT_NAMES)
        head = f"<h3>{self.words(1, 2)}</h3>" * (self.r.random() < 0.4)
        many = "".join(f"<{kind}{one}>{said()}</{kind}>" if kind else f"<p>{self.said(most)}</p>" for _ in range(self.r.randint(1, 5)))
        return self.boiler(self.r.choice(["section", "div", "div", "ol", "aside", "article"]), COMMENT_NAMES, head + many, True)

    def said(self, most: int) -> str:
        """What a reader writes: shorter than prose, and without links."""
        return self.words(1, self.r.randint(1, most)).capitalize() + self.r.choice([".", ".", ".", "!", ""])

    def share(self) -> str:
        return self.boiler(self.r.choice(["div", "ul", "p"]), SHARE_NAMES, " ".join(f'<a href="#">{self.words(1, 1)}</a>' for _ in range(3)), True)

    def block(self) -> str:
        """One block of an article."""
        x = self.r.random()
        if x < 0.72:
            return f"<p>{self.prose()}</p>"
        if x < 0.78:
            return f"<h2>{self.words(2, 7)}</h2>"
        if x < 0.84:
            return "<ul>" + "".join(f"<li>{self.prose(3, 20)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if x < 0.87:
            return f"<blockquote><p>{self.prose(5, 40)}</p></blockquote>"
        if x < 0.89:
            return f"<pre>{self.words(4, 20)}</pre>"
        if x < 0.92:
            return "<table><tr><td>" + "</td><td>".join(self.words(1, 4) for _ in range(3)) + "</td></tr></table>"
        if x < 0.94:
            return f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>"
        if x < 0.97:
            return f"<div>{self.prose(10, 60)}</div>"
        return f"<p><b>{self.words(4, 12)}.<br><p>{self.prose()}</p>"

    def inside(self) -> str:
        """Boilerplate that stands in an article."""
        kinds = (self.comments, self.comments, self.comments, self.comments, self.comments, self.advert, self.share, self.side, self.notice, self.form, self.menu, self.header, self.footer)
        return self.r.choice(kinds)()

    def body(self) -> str:
        parts = [f"<h1>{self.words(3, 10)}</h1>"] if self.r.random() < 0.8 else []
        if parts and self.r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        if self.r.random() < 0.15:  # a short article
            return "".join(parts) + self.r.choice([f"<p>{self.words(1, 8)}</p>", f"<p>{self.prose(1, 8)}</p>", self.prose(1, 12), f"<div>{self.prose(2, 12)}</div>"])
        blocks = [self.block() for _ in range(self.r.randint(1, 10))]
        if self.r.random() < 0.15:  # parts of their own, most of them with a heading
            cut = self.r.randint(0, len(blocks))
            head = f"<h2>{self.words(1, 6)}</h2>" * (self.r.random() < 0.7)
            blocks = [*blocks[:cut], f"<{(t := self.r.choice(['section', 'div']))}{self.name(CONTENT_NAMES)}>{head}{''.join(blocks[cut:])}</{t}>"]
        for _ in range(self.r.choice([0, 1, 1, 2, 3])):
            at = len(blocks) if self.r.random() < 0.5 else self.r.randint(1, len(blocks))
            blocks.insert(at, self.inside())
        return "".join([*parts, *blocks])

    def loose(self) -> str:
        """An article that lies in the body itself, some of it as bare text."""
        x = self.r.random()
        if x < 0.3:
            return self.prose(3, 60)
        if x < 0.6:
            return "<br><br>".join(self.prose(3, 50) for _ in range(self.r.randint(2, 5)))
        return f"<h1>{self.words(2, 8)}</h1>" * (self.r.random() < 0.6) + "".join(self.block() for _ in range(self.r.randint(1, 8)))

    def table_page(self) -> str:
        """A page laid out as a table without names."""
        cell = lambda inner, label, wide=False: f'<td data-label="{label}"{" colspan=2" * wide}>{inner}</td>'
        links = lambda: self.r.choice([self.links(), " ".join(self.words(1, 1).capitalize() for _ in range(self.r.randint(2, 5)))])
        article = self.r.choice(["".join(self.block() for _ in range(self.r.randint(1, 6))), self.prose(10, 60), "<br><br>".join(self.prose(5, 40) for _ in range(3))])
        top = f"<tr>{cell(links(), 'b', True)}</tr>" * (self.r.random() < 0.6)
        side = cell(links(), "b") * (self.r.random() < 0.6)
        foot = f"<tr>{cell(self.r.choice([f'Copyright 2020 {self.words(0, 3)}', f'&copy; {self.words(1, 4)}', links()]), 'b', True)}</tr>" * (self.r.random() < 0.8)
        return f"<html><body><table>{top}<tr>{side}{cell(article, 'c')}</tr>{foot}</table></body></html>"

    def page(self) -> str:
        self.plain_names = self.r.random() >= self.invented
        shape = self.r.random()
        if shape < 0.06:
            return self.table_page()
        if shape < 0.16:
            around = lambda *kinds: "".join(f() for f in kinds if self.r.random() < 0.35)
            foot = self.r.choice([around(self.footer), f'<p data-label="b">&copy; {self.words(1, 5)}</p>', f'<p data-label="b">Copyright {self.words(1, 5)}</p>'])
            before, after = around(self.header, self.menu, self.notice), around(self.comments, self.side, self.form)
            return f'<html><body data-label="c">{before}{self.loose()}{after}{foot}</body></html>'
        kind = self.r.choice(["article", "article", "article", "main", "div", "div", "section"])
        name = self.name(CONTENT_NAMES) if kind in ("div", "section") or self.r.random() < 0.3 else ""
        while kind in ("div", "section") and not name:
            name = self.name(CONTENT_NAMES)
        content = f'<{kind} data-label="c"{name}>{self.body()}</{kind}>'
        after = [self.r.choice([self.comments, self.side, self.share, self.advert, self.form])() for _ in range(self.r.randint(0, 2))]
        if self.r.random() < 0.4:
            wrapper = self.r.choice(["div", "main", "section"])
            content = f'<{wrapper}{self.name(["wrapper", "container", "page", "layout", "row", "columns", "site", "main"])}>{content}{"".join(after)}</{wrapper}>'
            after = []
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.side, self.form) if self.r.random() < 0.4]
        after += [f() for f in (self.side, self.comments, self.notice, self.advert, self.menu) if self.r.random() < 0.25]
        self.r.shuffle(before)
        foot = [self.footer()] if self.r.random() < 0.9 else []
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{''.join([*before, content, *after, *foot])}</body></html>"


def labelled_pages(count: int = 3000, seed: int = 11, invented: float = 0.33) -> list[str]:
    maker = Maker(seed, invented)
    return [maker.page() for _ in range(count)]
