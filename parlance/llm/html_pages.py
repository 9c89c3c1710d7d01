"""Generated pages with known main text, from which the block labeller learns.

Every page draws its own layout: containers and their class or id names, order of the parts, how much
of each, closed or unclosed paragraphs. Words are random syllables, so the labeller learns places, names and shapes rather than a vocabulary.
"""

from __future__ import annotations

import random

#: Fixed names of containers, as pages commonly have them.
MAIN = ["article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "section class=story", "div id=main-text", "div role=main", "article class=post-full", "div class=post-body", "main id=main"]
MENU = ["nav", "div class=menu", "ul class=nav", "div id=navbar", "div class=breadcrumbs", "header", "div class=header", "div id=top-bar", "nav class=main-menu", "header class=site-header"]
ASIDE = ["aside", "div class=sidebar", "div id=sidebar", "div class=related", "section class=widget", "div class=popular-posts", "aside class=recommended", "div class=share"]
ADVERT = ["div class=ad", "div class=advert", "div class=ads-banner", "div class=sponsored", "section class=promo", "div id=advertisement", "ins class=adsbygoogle", "aside class=ad"]
NOTICE = ["div class=cookie-notice", "div id=cookie-banner", "div class=notice", "div class=alert", "div class=consent", "div role=alert", "div class=newsletter", "div class=subscribe", "div class=popup"]
FORM = ["form", "form class=login", "form id=search", "form class=comment-form"]
COMMENTS = ["div class=comments", "section id=comments", "ol class=comment-list", "div class=comment", "div id=disqus", "div class=replies", "section class=discussion", "ul class=user-comments", "div class=reader-comments"]
FOOTER = ["footer", "div class=footer", "div id=footer", "footer class=site-footer", "div class=copyright"]
#: Marks of labelled containers; taken off the paths before the labeller sees them.
IN, OUT = "xmainx", "xotherx"
_SYLLABLES = "the an er in on re st ing ed le de la que en ment der und sch ach ver lich ción ado os ar ie ou th ent".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?", ","])

    def text(self, most: int = 6) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.04:  # one word over and over
            return " ".join(x for x in (self.word() for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40)))
        out = " ".join(self.sentence() for _ in range(r.randint(1, most) * (r.randint(1, 8) if kind > 0.9 else 1)))
        if kind < 0.07:
            return out.replace(" ", r.choice([" | ", "!! ", "$$$ ", "%%% "]))
        return out.upper() if kind < 0.09 else out

    def inside(self, container: str, body: str, mark: str = OUT) -> str:
        """body in the container, which also carries the mark that says what it is."""
        tag, _, attr = container.partition(" ")
        key, _, value = attr.partition("=")
        return f'<{tag} {key or "class"}="{value} {mark}">{body}</{tag}>'

    def links(self) -> str:
        some = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(1, 8))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>" if self.r.random() < 0.7 else " ".join(some)

    def paragraph(self) -> str:
        t = self.text()
        if self.r.random() < 0.2:
            t = f"<b>{t}<br>" if self.r.random() < 0.5 else f"<b>{t}</b>"
        elif self.r.random() < 0.15:
            t = f'{t} <a href="#">{self.words(1, 3)}</a> {self.text(2)}'
        return f"<p>{t}" if self.r.random() < 0.2 else f"<p>{t}</p>"

    def other(self) -> tuple[list[str], list[str]]:
        """Parts before and after the main text."""
        r = self.r
        before, after = [], []
        if r.random() < 0.9:
            name = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<h2>{self.words(1, 3)}</h2>", f'<a href="/">{self.words(1, 2)}</a>', f"<p>{self.words(1, 5)}</p>"])
            kind = r.random()  # a site's name alone, with its menu, or the menu alone
            before.append(self.inside(r.choice(MENU), name if kind < 0.15 else name + self.links() if kind < 0.4 else self.links()))
        for names, share in ((ADVERT, 0.6), (NOTICE, 0.4), (ASIDE, 0.5), (FORM, 0.3), (MENU, 0.2), (ASIDE, 0.2)):
            if r.random() < share:
                kind = r.random()
                body = self.links() if kind < 0.3 else self.text(3) if kind < 0.6 else f"<p>{self.text(4)}</p>" if kind < 0.85 else f"<h3>{self.words(1, 4)}</h3><p>{self.text(2)}</p>"
                if names is FORM:
                    body = f"<label>{self.words(1, 3)}</label><input><p>{self.text(1)}</p>" + body
                (before if r.random() < 0.55 else after).append(self.inside(r.choice(names), body))
        if r.random() < 0.45:
            one = lambda: f"<li>{self.text(3)}</li>" if r.random() < 0.3 else f"<div><b>{self.word()}</b><p>{self.text(4)}</p></div>" if r.random() < 0.4 else f"<p>{self.text(4)}</p>"
            after.append(self.inside(r.choice(COMMENTS), (f"<h2>{self.words(1, 2)}</h2>" if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 6)))))
        if r.random() < 0.9:
            mark = r.choice(["&copy; ", "", "Copyright "])
            after.append(self.inside(r.choice(FOOTER), f"{mark}{self.word()}.{self.word()} &middot; {self.text(2)}" if r.random() < 0.6 else f"<p>{mark}{self.text(2)}</p>" + self.links()))
        return before, after

    def intruder(self) -> tuple[str, str]:
        names = self.r.choice([ADVERT, NOTICE, ASIDE, FORM, COMMENTS, FOOTER])
        text = self.sentence(1, 4) if self.r.random() < 0.4 else self.text(2)
        body = text if self.r.random() < 0.5 else f"<p>{text}</p>"
        return self.r.choice(names), body if names is not COMMENTS else f"<p>{self.text(2)}</p>" * self.r.randint(1, 3)

    def page(self) -> str:
        """A page whose containers are marked."""
        r = self.r
        title = self.words(1, 9)
        parts = []
        if r.random() < 0.85:
            level = r.choice("112")
            parts.append(f"<h{level}>{title}</h{level}>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12, 16])):
            k = r.random()
            if k < 0.82:
                parts.append(self.paragraph())
            elif k < 0.87:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif k < 0.92:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif k < 0.96:
                parts.append(f"<blockquote>{self.text(2)}</blockquote>")
            else:
                parts.append(f"<div>{self.text(3)}</div>")
        main_name = r.choice(MAIN)
        main = self.inside(main_name, "".join(parts), IN)
        before, after = self.other()
        if r.random() < 0.5:  # adverts, forms, comments inside the article
            for _ in range(r.randint(1, 3)):
                parts.insert(r.randint(1, len(parts)), self.inside(*self.intruder()))
            main = self.inside(main_name, "".join(parts), IN)
        if r.random() < 0.2:
            main = self.inside(r.choice(["div class=wrapper", "div id=page", "div class=container", "section"]), main, "")
        if r.random() < 0.03:
            main = ""
        head = f"<head><title>{title}</title><style>p{{}}</style></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int = 11):
    """(blocks, labels) of n generated pages."""
    import numpy as np

    from parlance.llm.html_blocks import blocks

    make = Maker(seed)
    out = []
    while len(out) < n:
        found = blocks(make.page())
        labels = []
        for b in found:
            marks = [x for _, names in b.path for x in names if x in (IN, OUT)]
            labels.append(marks[-1:] == [IN])
            b.path = tuple((tag, tuple(x for x in names if x not in (IN, OUT))) for tag, names in b.path)
        if found:
            out.append((found, np.array(labels)))
    return out
