"""Labelled pages for training the block labeller: seeded, of many layouts; main text carries a mark.

Fixed values: the layouts' tags, class names and phrases. The texts are invented words, so that the model learns from
structure and shape and not from a vocabulary.
"""

from __future__ import annotations

import random

MARK = ""  # in front of every piece of main text; taken out before features are made

SYLLABLES = "ba ca de fi go hu la me ni or pa qu re si to un ver wen xi zo é ü ción ment eau lich sch ing er th an st on es".split()
CONTENT = ["article", "main", "div.content", "div.post", "div.entry-content", "div#main", "div.article-body", "section.story", "div", "td"]
MENUS = ["nav", "div.menu", "ul.navigation", "div#nav", "div.breadcrumb", "nav.top-nav", "div.toc", "div.pagination", "div.tags"]
HEADS = ["header", "div.header", "div#masthead", "header.site-header", "div.top-bar", "div.banner"]
FEET = ["footer", "div.footer", "div#footer", "footer.site-footer", "div.bottom", "div.copyright"]
SIDES = ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "section.recommended", "div.widget-area", "div.share", "div.social"]
ADS = ["div.ad", "div.ads", "div.advert", "ins.adsbygoogle", "div.sponsored", "aside.promo", "div#ad-top", "section.advertisement"]
NOTICES = ["div.cookie-notice", "div#cookie-banner", "div.notice", "div.alert", "div.popup", "div.modal", "div.gdpr-consent", "section.disclaimer", "dialog"]
FORMS = ["form", "div.newsletter", "form.search", "div.login", "form.subscribe", "div.signup"]
COMMENTS = ["section.comments", "div#comments", "ol.comment-list", "div.comment-section", "div.replies", "section#disqus", "ul.reviews"]


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> list[str]:
        r = self.r
        return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]

    def sentence(self, low: int = 3, high: int = 18) -> str:
        w = self.words(low, high)
        return " ".join(w).capitalize() + self.r.choice("....?!")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def open(self, spec: str) -> tuple[str, str]:
        tag, _, name = spec.replace("#", ".").partition(".")
        kind = "id" if "#" in spec else "class"
        return f"<{tag} {kind}=\"{name}\">" if name else f"<{tag}>", f"</{tag}>"

    def wrap(self, spec: str, inner: str) -> str:
        a, b = self.open(spec)
        return a + inner + b

    def links(self, low: int = 2, high: int = 8) -> str:
        r = self.r
        some = [f'<a href="/{i}">{" ".join(self.words(1, 3))}</a>' for i in range(r.randint(low, high))]
        form = r.randint(0, 3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>"
        if form == 1:
            return " | ".join(some)
        if form == 2:
            return "".join(f"<div>{x}</div>" for x in some)
        return "<p>" + " ".join(some) + "</p>"

    def menu(self) -> str:
        said = self.said()
        return self.wrap(self.r.choice(MENUS), self.r.choice([self.links(), self.links(), self.links() + said, said + self.links(), said]))

    def said(self) -> str:
        """Prose that is not main text."""
        return self.r.choice([f"<p>{self.prose(1, 6)}</p>", f"<p>{self.prose(1, 5)}</p>" * 2, f"<div>{self.prose(1, 4)}</div>", self.prose(1, 4)])

    def unscripted(self) -> str:
        return f"<noscript>{self.r.choice([self.prose(1, 2), f'<p>{self.prose(1, 2)}</p>'])}</noscript>"

    def head(self) -> str:
        name = f"<{(t := self.r.choice(['div', 'p', 'h1', 'h2', 'span']))}>{' '.join(self.words(1, 4))}</{t}>"
        tail = self.r.choice(["", f"<p>{self.sentence(2, 6)}</p>", self.links(), self.menu()])
        return self.wrap(self.r.choice(HEADS), name + tail)

    def foot(self) -> str:
        r = self.r
        lines = [f"&copy; {r.randint(1999, 2026)} {' '.join(self.words(1, 3))}", f"&copy; {self.words(1, 1)[0]}.example.com &middot; {self.prose(1, 3)}", self.links(), f"<p>{self.sentence()}</p>", f"<address>{self.sentence(3, 7)}</address>"]
        return self.wrap(r.choice(FEET), "".join(r.sample(lines, r.randint(1, 3))))

    def side(self) -> str:
        r = self.r
        body = [self.links(), f"<h3>{' '.join(self.words(1, 3))}</h3>" + self.links(), "".join(f'<p><a href="/">{self.sentence()}</a> {self.sentence()}</p>' for _ in range(r.randint(1, 4))), f"<p>{self.prose(1, 3)}</p>"]
        return self.wrap(r.choice(SIDES), "".join(r.sample(body, r.randint(1, 2))))

    def ad(self) -> str:
        r = self.r
        return self.wrap(r.choice(ADS), r.choice([self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>", f'<a href="/x">{self.sentence()}</a>', f"<h4>{self.sentence(2, 5)}</h4><p>{self.prose(1, 2)}</p>"]))

    def notice(self) -> str:
        r = self.r
        return self.wrap(r.choice(NOTICES), r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>"]) + r.choice(["", f"<button>{self.words(1, 1)[0]}</button>", '<a href="/p">ok</a>']))

    def form(self) -> str:
        r = self.r
        field = lambda: f"<label>{' '.join(self.words(1, 3))}</label><input name=q>"
        if r.random() < 0.25:
            return self.wrap(r.choice(FORMS), self.said())
        body = r.choice(["", self.said(), f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.sentence(1, 4)}</h3>", f"<h3>{self.sentence(1, 4)}</h3>{self.said()}"]) + "".join(field() for _ in range(r.randint(1, 3)))
        pick = "<select>" + "".join(f"<option>{self.words(1, 1)[0]}</option>" for _ in range(3)) + "</select>"
        return self.wrap(r.choice(FORMS), body + r.choice(["", pick]) + f"<button>{self.words(1, 1)[0]}</button>")

    def comments(self) -> str:
        r = self.r
        item = r.choice(["div.comment", "li.comment", "article.comment", "li", "div.reply", "div"])
        one = lambda: self.wrap(item, r.choice(["", f"<b>{self.words(1, 2)[0]}</b> ", f'<div class="author">{self.words(1, 1)[0]}</div>', f"<h4>{self.words(1, 1)[0]}</h4>"]) + r.choice([f"<p>{self.prose(1, 4)}</p>", self.prose(1, 4)]))
        title = r.choice(["", f"<h3>{r.randint(2, 90)} {self.words(1, 1)[0]}</h3>", f"<h2>{' '.join(self.words(1, 2))}</h2>"])
        return self.wrap(r.choice(COMMENTS), title + "".join(one() for _ in range(r.randint(1, 6))) + r.choice(["", self.form()]))

    def main(self) -> str:
        r = self.r
        out = []
        title = f"<h1>{MARK}{' '.join(self.words(2, 9))}</h1>"
        out.append(r.choice([title, title, title, f"<header>{title}</header>", ""]))
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            text = MARK + self.prose()
            if kind < 0.62:
                if r.random() < 0.3:
                    a, b = r.sample([("<b>", "</b>"), ("<a href='/l'>", "</a>"), ("<em>", "</em>"), ("<span>", "</span>")], 1)[0]
                    text = f"{text} {a}{self.sentence(1, 4)}{b} {self.sentence()}"
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"]))
            elif kind < 0.7:
                out.append(f"<p>{MARK}{self.sentence(1, 3)}</p>")
            elif kind < 0.78:
                t = r.choice(["h2", "h3", "h4"])
                out.append(f"<{t}>{MARK}{' '.join(self.words(1, 6))}</{t}>")
            elif kind < 0.86:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{MARK}{self.sentence(2, 12)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>")
            elif kind < 0.9:
                out.append(f"<blockquote>{MARK}{self.prose(1, 3)}</blockquote>")
            elif kind < 0.91:
                out.append(f"<noscript><p>{MARK}{self.prose(1, 3)}</p></noscript>")
            elif kind < 0.93:
                out.append(f"<pre>{MARK}{self.prose(1, 2)}</pre>")
            elif kind < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{' '.join(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(r.choice([self.ad, self.side, self.notice, self.form])())
        inner = "".join(out)
        if r.random() < 0.2:
            inner = f"<div>{inner}</div>"
        if r.random() < 0.15:
            inner += self.comments()
        return self.wrap(r.choice(CONTENT), inner)

    def build(self) -> str:
        r = self.r
        some = lambda makers, p: "".join(m() for m in makers if r.random() < p)
        head = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"
        before = [self.menu, self.head, self.ad, self.notice, self.form, self.side, self.unscripted]
        after = [self.side, self.ad, self.comments, self.form, self.menu, self.foot, self.notice]
        r.shuffle(before)
        main = self.main()
        page = some(before, 0.45) + main + some(after, 0.45)
        if r.random() < 0.2:
            page = f"<div class='container'>{page}</div>"
        return head + page + r.choice(["</body></html>", "</body></html>", ""])


def labelled_pages(n: int, seed: int) -> list[str]:
    """n pages; blocks whose text holds MARK are main text."""
    return [_Page(seed * 1_000_003 + i).build() for i in range(n)]
