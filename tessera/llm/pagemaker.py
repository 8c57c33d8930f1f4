"""Made-up pages whose content is known, for the block classifier: no page of the corpus carries labels."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Pages, and the seed of all their choices.
PAGES, SEED = 400, 12
# Names of classes and ids as sites give them.
BAD = "nav-bar main-menu breadcrumb sidebar widget footer-links cookie-notice gdpr newsletter social-share related-posts comments ad-slot promo-box banner login-box search-form pager copyright".split()
GOOD = "article-body post-content entry-content story main-text blog-post page-content".split()
PLAIN = "row col-8 inner box grid wrap section-1 x12 block unit".split()
STATES = "has-sidebar no-sidebar with-comments nav-open social-enabled overflow-hidden is-menu-closed".split()
NOTICES = (
    "We use cookies to improve this site. Accept all or read our privacy policy.", "Subscribe to our newsletter and never miss a story.",
    "Sign up or log in to go on reading.", "This site uses cookies; by going on you give your consent.", "Advertisement",
    "Wir verwenden Cookies. Akzeptieren Sie die Datenschutzerklärung?"
)
UNSHOWN = ("hidden", 'style="display: none"', 'aria-hidden="true"')
REPLIES = ("Comments", "3 Comments", "Replies", "12 responses", "Kommentare (4)", "Commentaires")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(("ba", "ne", "ti", "or", "sha", "el", "und", "lo", "mi", "kar", "e")) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def prose(self, most: int = 6) -> str:
        return " ".join(self.words(3, 18) + self.r.choice(".....!?") for _ in range(self.r.randint(1, most)))

    def links(self) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(2, 8))) + "</ul>"

    def named(self, names: list[str]) -> str:
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}"'

    def boxed(self, inner: str) -> str:
        """Something that is no content, in an element that says so, or in one that doesn't."""
        if self.r.random() < 0.6:
            return f"<div{self.named(BAD)}>{inner}</div>"
        tag = self.r.choice(("aside", "nav", "footer", "form", "section", "div"))
        return f"<{tag}{self.named(BAD) if tag in ('section', 'div') else ''}>{inner}</{tag}>"

    def clutter(self) -> str:
        r = self.r
        kind = r.randrange(8)
        if kind == 6:
            return f'<div {r.choice(UNSHOWN)}><p>{self.prose(3)}</p></div>'
        if kind == 7:
            return f"<header><h2>{self.words(1, 3)}</h2><p>{self.prose(2)}</p></header>"
        if kind == 0:
            return f"<div>{r.choice(NOTICES)}</div>"  # says so by its text alone
        if kind == 1:
            return self.boxed(f"<p>{r.choice(NOTICES)}</p>")
        if kind == 2:
            return self.boxed(f"<h3>{self.words(1, 3)}</h3>{self.links()}")
        if kind == 3:
            return self.boxed(f"<p>{self.prose(3)}</p>")
        return f"<div>{self.links()}</div>" if kind == 4 else f"<footer><p>© {r.randint(1990, 2030)} {self.words(1, 3)} | {self.words(1, 2)}</p></footer>"

    def replies(self) -> str:
        said = "".join(f"<div><p>{self.prose(2)}</p></div>" for _ in range(self.r.randint(1, 4)))
        inner = f"<h2>{self.r.choice(REPLIES)}</h2>{said}"
        return f"<div>{inner}</div>" if self.r.random() < 0.5 else f'<section id="comments">{inner}</section>'

    def article(self) -> tuple[str, set[str]]:
        r, parts, content = self.r, [], set()

        def add(tag: str, text: str) -> None:
            content.add(text)
            parts.append(f"<{tag}>{text}</{tag}>")

        add("h1", self.words(2, 10))
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            if kind < 0.65:
                add("p", self.prose())
            elif kind < 0.75:
                add("h2", self.words(1, 6))
            elif kind < 0.85:
                items = [self.words(1, 9) for _ in range(r.randint(2, 4))]
                content.update(items)
                parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            elif kind < 0.92:
                add("p", self.words(1, 4))
            else:
                parts.append(self.boxed(f"<p>{r.choice((self.prose(2), r.choice(NOTICES)))}</p>"))
        inner = "".join(parts)
        kind = r.randrange(6)
        if kind < 2:
            inner = f"<article>{inner}</article>"
        elif kind == 2:
            inner = f"<main>{inner}</main>"
        elif kind < 5:
            inner = f"<div{self.named(GOOD)}>{inner}</div>"
        if kind == 5 or r.random() < 0.4:
            inner = f"<div{self.named(STATES + PLAIN)}>{inner}</div>"
        if kind < 3 and r.random() < 0.2:
            inner = f"<div{self.named(BAD)}>{inner}</div>"
        return inner, content

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        article, content = self.article()
        top = f"<header><a href=/>{self.words(1, 2)}</a><nav>{self.links()}</nav></header>" if r.random() < 0.5 else f"<nav>{self.links()}</nav>"
        before, after = ("".join(self.clutter() for _ in range(r.randint(0, 3))) for _ in range(2))
        said = self.replies() if r.random() < 0.4 else ""
        body = r.choice(("", f' class="{r.choice(STATES)}"'))
        return f"<html><head><title>{self.words(2, 5)}</title></head><body{body}>{top}{before}{article}{said}{after}</body></html>", content


def pages(n: int = PAGES, seed: int = SEED) -> Iterator[tuple[str, set[str]]]:
    """Pages and the texts of their content blocks."""
    maker = Maker(seed)
    for _ in range(n):
        yield maker.page()
