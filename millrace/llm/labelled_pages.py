"""Labelled pages to train the extraction model on: made up, with the main text known.

Pages are composed at random from the parts that sites have: menus, headers, footers,
sidebars, notices, adverts, forms, reader comments around an article that may stand in any of
several containers.  Words are random, so only structure can tell the parts apart.
"""

from __future__ import annotations

import html
import random

#: Words that sites use in class and id attributes for each part.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu toc pagination tabs links skip".split(),
    "header": "header masthead banner site-header topbar branding logo site-title tagline".split(),
    "footer": "footer site-footer bottom copyright colophon legal imprint".split(),
    "side": "sidebar aside side widget related recommended trending popular more-stories teaser archive tags".split(),
    "notice": "cookie cookie-notice consent notice alert gdpr popup modal overlay paywall message privacy warning banner-notice".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsbox ad-slot banner-ad partner".split(),
    "form": "form search newsletter subscribe signup login contact poll search-form".split(),
    "share": "share social sharing follow buttons toolbar share-links".split(),
    "comments": "comments comment comment-list responses replies discussion reader-comments disqus feedback comment-body".split(),
    "content": "content article post entry story body main text page-content post-content entry-content article-body storytext prose".split(),
    "wrap": "wrapper container page row col layout inner outer wrap site grid".split(),
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.kept: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choice("bdfglmnprst") + self.r.choice("aeiouéüñ") for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.r.randint(lo, hi)):
            w = self.word()
            k = self.r.random()
            out.append(w + "," if k < 0.08 else w + "." if k < 0.14 else w + self.r.choice(["&&", "%", "###", "$", "!!"]) if k < 0.16 else w)
        return " ".join(out).capitalize() + self.r.choice([".", ".", ".", "", "!", "?"])

    def attributes(self, part: str, often: float = 0.8) -> str:
        if self.r.random() > often:
            return ""
        names = " ".join(self.r.sample(NAMES[part], self.r.choice([1, 1, 1, 2])))
        return f' {self.r.choice(["class", "class", "class", "id"])}="{names}"'

    def said(self, text: str) -> str:
        """Text as markup, at times with inline elements, references and odd spacing."""
        out = html.escape(text)
        if self.r.random() < 0.3:
            w = out.split(" ")
            i = self.r.randrange(len(w))
            tag = self.r.choice(["b", "i", "em", "strong", "span", 'a href="/x"'])
            w[i] = f"<{tag}>{w[i]}</{tag.split(' ')[0]}>"
            out = " ".join(w)
        return out.replace(" ", "\n ", 1) if self.r.random() < 0.2 else out

    def keep(self, text: str) -> str:
        self.kept.append(" ".join(text.split()))
        return self.said(text)

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{self.word()}">{self.said(self.words(1, 4)).split("<")[0]}</a>' for _ in range(self.r.randint(lo, hi))]
        k = self.r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if k < 0.7 else " | ".join(items) if k < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def phrase(self) -> str:
        text = self.said(self.words(2, 25))
        k = self.r.random()
        return text if k < 0.4 else f"<p>{text}</p>" if k < 0.8 else f"<div>{text}</div>"

    def part(self, part: str, tag: str, inner: str) -> str:
        bare = tag in ("nav", "header", "footer", "aside", "form")
        return f"<{tag}{self.attributes(part, 0.4 if bare else 1.0)}>{inner}</{tag}>"

    def boiler(self, part: str) -> str:
        r = self.r
        if part == "nav":
            return self.part("nav", r.choice(["nav", "nav", "div", "ul"]), self.links(2, 8))
        if part == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 4)}</h2>", f"<p>{self.words(1, 8)}</p>", self.words(1, 6)])
            return self.part("header", r.choice(["header", "header", "div"]), inner + (self.links(2, 5) if r.random() < 0.4 else ""))
        if part == "footer":
            inner = r.choice(["&copy; ", "&copy; 2020 ", "Copyright ", ""]) + self.words(1, 20)
            return self.part("footer", r.choice(["footer", "footer", "footer", "div"]), inner if r.random() < 0.5 else f"<p>{inner}</p>" + (self.links(2, 5) if r.random() < 0.5 else ""))
        if part == "side":
            inner = (f"<h3>{self.words(1, 4)}</h3>" if r.random() < 0.6 else "") + (self.links(2, 6) if r.random() < 0.6 else "".join(self.phrase() for _ in range(r.randint(1, 4))))
            return self.part("side", r.choice(["aside", "aside", "div", "section"]), inner)
        if part == "form":
            inner = f'<label>{self.words(1, 4)}</label><input type="text"><button>{self.words(1, 2)}</button>'
            return self.part("form", r.choice(["form", "form", "div"]), (self.phrase() if r.random() < 0.6 else "") + inner)
        if part == "share":
            return self.part("share", "div", self.links(2, 4))
        if part == "comments":
            one = lambda: f'<{(t := r.choice(["div", "li", "article", "section"]))}{self.attributes("comments")}>{"<h4>" + self.words(1, 2) + "</h4>" if r.random() < 0.5 else ""}' + "".join(f"<p>{self.said(self.words(3, 60))}</p>" for _ in range(r.randint(1, 3))) + f"</{t}>"
            inner = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5)))
            return self.part("comments", r.choice(["section", "div", "ol"]), inner)
        return self.part(part, r.choice(["div", "div", "section", "aside"] if part == "ad" else ["div", "div", "section"]), "".join(self.phrase() for _ in range(r.randint(1, 2))))

    def block(self, short: bool = False) -> str:
        r = self.r
        k = r.random()
        long = self.words(1, 4) if short or r.random() < 0.12 else self.words(4, 120)
        if k < 0.72:
            return f"<p>{self.keep(long)}" + r.choice(["</p>", "</p>", "</p>", ""])
        if k < 0.78:
            return f"<p><b>{self.keep(long)}<br>"
        if k < 0.84:
            return f"<h{(n := r.randint(2, 4))}>{self.keep(self.words(1, 8))}</h{n}>"
        if k < 0.89:
            return "<ul>" + "".join(f"<li>{self.keep(self.words(1, 25))}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if k < 0.92:
            return f"<blockquote><p>{self.keep(long)}</p></blockquote>"
        if k < 0.94:
            return f"<pre>{self.keep(self.words(3, 20))}</pre>"
        if k < 0.96:
            return f'<figure><img src="x.png"><figcaption>{self.keep(self.words(2, 12))}</figcaption></figure>'
        if k < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return f"<div>{self.keep(long)}</div>"

    def article(self) -> str:
        r = self.r
        head = f"<h1>{self.keep(self.words(1, 12))}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        inner = head
        short = r.random() < 0.2  # verse, lists of names, one line said over and over
        for _ in range(r.choice([2, 6, 20, 60]) if short else r.choice([1, 1, 2, 3, 5, 8, 14])):
            if r.random() < 0.07:
                inner += self.boiler(r.choice(["ad", "ad", "share", "form", "side", "notice"]))
            inner += self.block(short and r.random() < 0.9)
        if r.random() < 0.1:
            inner += self.boiler(r.choice(["comments", "share", "ad", "form"]))
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        whole = f"<{tag}{self.attributes('content', 0.5 if tag in ('article', 'main') else 1.0)}>{inner}</{tag}>"
        return f"<main>{whole}</main>" if tag == "article" and r.random() < 0.2 else whole

    def page(self) -> tuple[str, str]:
        r = self.r
        before = [self.boiler(x) for x in r.sample(["nav", "header", "ad", "notice", "form", "side", "nav"], r.randint(1, 4))]
        article = self.article()
        after = [self.boiler(x) for x in r.sample(["footer", "side", "comments", "comments", "ad", "form", "share", "nav", "notice"], r.randint(1, 4))]
        if r.random() < 0.7:
            after.append(self.boiler("footer"))
        inner = "".join(before) + article + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = f"<div{self.attributes('wrap')}>{inner}</div>"
        out = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{inner}'
        return out + r.choice(["</body></html>", ""]), "\n\n".join(self.kept)


def labelled_pages(n: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    """``n`` pages with their main texts."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
