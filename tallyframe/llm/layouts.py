"""Labelled web pages made by rule: invented words in layouts drawn at random, each with its known main text.

They train the content model where no labelled pages are at hand. A seed gives the same pages everywhere. Articles come in
many containers, and menus, headers, footers, sidebars, notices, adverts, forms and reader comments under many names, or
under none.
"""

from __future__ import annotations

import html
import random

_CONTENT = "article content post entry story main body text article-body post-content entry-content storyBody page-content".split()
_JUNK = {
    "nav": "nav menu navbar navigation main-menu site-nav breadcrumb breadcrumbs topnav links pager pagination toc".split(),
    "header": "header masthead top site-header banner page-header branding logo topbar hero".split(),
    "footer": "footer site-footer bottom foot copyright colophon legal page-footer imprint credits".split(),
    "aside": "sidebar aside widget related secondary rail recommended popular trending right-column more-stories teaser".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot commercial partner".split(),
    "notice": "notice cookie cookies consent cookie-banner gdpr alert popup modal overlay message paywall announcement".split(),
    "form": "form login search signup newsletter subscribe subscription contact search-box register".split(),
    "comments": "comments comment comment-list responses replies discussion disqus respond reader-comments feedback".split(),
    "share": "share social sharing share-buttons follow tools social-links print".split(),
}
_TAGS = {
    "nav": ["nav", "div", "ul", "div"],
    "header": ["header", "div", "header"],
    "footer": ["footer", "div", "footer", "section"],
    "aside": ["aside", "div", "section"],
    "ad": ["div", "aside", "section", "p"],
    "notice": ["div", "section", "aside", "p"],
    "form": ["form", "form", "div"],
    "comments": ["section", "div", "ol", "ul"],
    "share": ["div", "ul", "p"],
}
_SYLLABLES = "an be ca do el fi ga ho in ju ka lo mi no or pa qu ra se ti un vo wa xe yo ze é ü ñ ça der ing tion st".split()


class _Page:
    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)
        self.words = ["".join(self.draw.choices(_SYLLABLES, k=self.draw.randint(1, 4))) for _ in range(300)]
        self.site = self.phrase(1, 3)
        self.named = self.draw.random() < 0.85
        self.semantic = self.draw.random() < 0.6
        # Some pages are noisy: signs behind words, or words between bars.
        self.noise = self.draw.choice([[]] * 6 + [["***", "&&&", "%%%"], ["|"]])
        self.blocks: list[str] = []

    def maybe(self, share: float) -> bool:
        return self.draw.random() < share

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.draw.choices(self.words, k=self.draw.randint(least, most))).capitalize()

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.draw.randint(least, most)))

    def sentence(self) -> str:
        text = self.phrase(1, 22)
        if self.noise == ["|"]:
            return text.replace(" ", " | ")
        if self.noise:
            return " ".join(word + self.draw.choice(self.noise) for word in text.split(" "))
        if self.maybe(0.4):
            text = text.replace(" ", ", ", 1)
        if self.maybe(0.15):
            text += self.draw.choice([" & co", " <3", " #1", " $5", " %%%", " 50%", " ***"])
        return text + self.draw.choice("....!?")

    def escaped(self, text: str) -> str:
        return html.escape(text, quote=self.maybe(0.5))

    def name(self, kind: str, names: list[str]) -> str:
        """A class or id attribute, or none."""
        if not self.named or self.maybe(0.1):
            return self.draw.choice(["", "", f' class="{self.phrase(1, 2).lower()}"'])
        chosen = self.draw.choice(names)
        if self.maybe(0.2):
            chosen += self.draw.choice(["-wrapper", "-inner", " clearfix", "_box", "-1", " col-md-8"])
        form = self.draw.choice([' class="{}"', ' id="{}"', " class={}", " class='{}'"])
        return form.format(chosen if "={}" not in form else chosen.replace(" ", "-"))

    def box(self, kind: str, inside: str) -> str:
        tags = _TAGS[kind] if self.semantic else ["div", "div", "section", "p" if "<p" not in inside else "div"]
        tag = self.draw.choice(tags)
        if tag == "p" and ("<ul" in inside or "<p" in inside or "<h" in inside or "<form" in inside or "<div" in inside):
            tag = "div"
        if tag in ("ul", "ol") and "<li" not in inside:
            tag = "div"
        return f"<{tag}{self.name(kind, _JUNK[kind])}>{inside}</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.draw.randrange(1000)}">{self.escaped(text)}</a>'

    def links(self, least: int, most: int, words: int = 3) -> str:
        listed = [self.link(self.phrase(1, words)) for _ in range(self.draw.randint(least, most))]
        if self.maybe(0.3):
            return self.draw.choice([" | ", " ", " · "]).join(listed)
        end = "</li>" if self.maybe(0.8) else ""
        return "<ul>" + "".join(f"<li>{item}{end}" for item in listed) + "</ul>"

    def nav(self) -> str:
        return self.box("nav", self.links(2, 9))

    def header(self) -> str:
        tag = self.draw.choice(["h1", "div", "p", "h2", "span"])
        inside = f"<{tag}>{self.link(self.site) if self.maybe(0.6) else self.site}</{tag}>"
        inside += f"<p>{self.escaped(self.phrase(3, 9))}</p>" if self.maybe(0.4) else ""
        inside += self.nav() if self.maybe(0.5) else ""
        return self.box("header", inside + (self.form() if self.maybe(0.2) else ""))

    def footer(self) -> str:
        lines = [self.draw.choice(["&copy; ", "© ", "Copyright ", ""]) + f"{self.draw.randint(1999, 2025)} {self.site}"]
        lines += [self.escaped(self.sentences(1, 3))] if self.maybe(0.6) else []
        lines += [self.links(2, 6)] if self.maybe(0.5) else []
        if self.maybe(0.1):
            return f"<hr><small>{' '.join(lines[:2])}</small>"
        if self.maybe(0.4):
            return self.box("footer", " &middot; ".join(lines[:2]))
        return self.box("footer", "".join(f"<p>{line}</p>" if "<ul" not in line else line for line in lines))

    def advert(self) -> str:
        text = self.escaped(self.sentences(1, 3))
        inside = self.draw.choice([text, f"<p>{text}</p>", self.link(self.phrase(2, 8)), f"<h3>{self.phrase(1, 4)}</h3><p>{text}</p>"])
        return self.box("ad", inside)

    def notice(self) -> str:
        text = self.escaped(self.sentences(1, 4))
        inside = self.draw.choice([text, f"<p>{text}</p>"]) + self.draw.choice(["", f"<button>{self.phrase(1, 2)}</button>", self.link(self.phrase(1, 2))])
        return self.box("notice", inside)

    def form(self) -> str:
        lines = [f"<p>{self.escaped(self.sentences(1, 2))}</p>"] if self.maybe(0.6) else []
        lines += [f"<label>{self.phrase(1, 3)} <input name=q></label>" for _ in range(self.draw.randint(1, 3))]
        lines.append(self.draw.choice(["<button>Go</button>", "<input type=submit>", "<select><option>a<option>b</select>"]))
        inside = "".join(lines)
        return self.box("form", inside if self.maybe(0.5) else f"<form>{inside}</form>")

    def aside(self) -> str:
        parts, level = [], self.draw.choice("234")
        for _ in range(self.draw.randint(1, 3)):
            parts.append(f"<h{level}>{self.phrase(1, 4)}</h{level}>")
            parts.append(self.draw.choice([self.links(3, 8, 8), f"<p>{self.escaped(self.sentences(1, 4))}</p>", self.advert()]))
        return self.box("aside", "".join(parts))

    def comments(self) -> str:
        inside = f"<h3>{self.draw.randint(1, 90)} {self.phrase(1, 1)}</h3>" if self.maybe(0.7) else ""
        listed = self.maybe(0.4)
        for _ in range(self.draw.randint(1, 7)):
            said = f"<p>{self.escaped(self.sentences(1, 5))}</p>"
            author = self.draw.choice(["<b>{}</b>", "<div class=author>{}</div>", "<cite>{}</cite>", "<h4>{}</h4>", "<p>{}</p>", ""]).format(self.phrase(1, 2))
            tag = "li" if listed else self.draw.choice(["div", "article", "div"])
            own = self.draw.choice([' class="comment"', "", ' class="reply"', ' class="comment-body"']) if self.named else ""
            inside += f"<{tag}{own}>{author}{said}{self.link(self.phrase(1, 1)) if self.maybe(0.4) else ''}</{tag}>"
        inside += self.form() if self.maybe(0.4) else ""
        return self.box("comments", inside)

    def share(self) -> str:
        return self.box("share", self.links(2, 5, 2))

    def inline(self, text: str) -> str:
        """Escaped text with some markup inside; its words stay."""
        words = [self.escaped(word) for word in text.split(" ")]
        for _ in range(self.draw.choice([0, 0, 0, 1, 2])):
            at = self.draw.randrange(len(words))
            words[at] = self.draw.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<code>{}</code>", "{}<br>", "<!-- x -->{}"]).format(words[at])
        return self.draw.choice(["", "", "<b>"]) * self.maybe(0.2) + self.draw.choice([" ", " ", "\n"]).join(words)

    def block(self, tag: str, text: str, closed: bool = True) -> str:
        self.blocks.append(" ".join(text.split()))
        return f"<{tag}>{self.inline(text)}" + (f"</{tag}>" if closed else "")

    def article(self) -> tuple[str, str]:
        """The markup of an article and its title."""
        title = self.phrase(2, 12) + self.draw.choice(["", "", "."])
        parts = []
        if self.maybe(0.85):
            heading = self.block(self.draw.choice(["h1", "h1", "h2"]), title)
            parts.append(f"<header>{heading}</header>" if self.maybe(0.15) else heading)
        if self.maybe(0.15):
            parts.append(self.share())
        junk = [self.advert, self.share, self.aside, self.form, self.notice]
        closed, plain = self.maybe(0.8), self.draw.choice(["p", "p", "p", "p", "div"])
        for _ in range(self.draw.choice([1, 2, 3, 5, 8, 13, 20])):
            kind = self.draw.random()
            if kind < 0.75:
                parts.append(self.block(plain, self.sentences(1, self.draw.choice([1, 2, 4, 9])), closed or plain == "div"))
            elif kind < 0.83:
                parts.append(self.block(self.draw.choice(["h2", "h3"]), self.phrase(1, 7)))
            elif kind < 0.88:
                tag = self.draw.choice(["ul", "ol"])
                items = [self.block("li", self.sentences(1, 2) if self.maybe(0.5) else self.phrase(2, 9), closed) for _ in range(self.draw.randint(2, 5))]
                parts.append(f"<{tag}>{''.join(items)}</{tag}>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{self.block('p', self.sentences(1, 3))}</blockquote>")
            elif kind < 0.94:
                rows = "".join("<tr>" + "".join(self.block("td", self.phrase(1, 3)) for _ in range(2)) + "</tr>" for _ in range(2))
                parts.append(f"<table>{rows}</table>")
            elif kind < 0.95:
                parts.append(self.block("pre", self.phrase(3, 12)))
            else:
                parts.append(self.draw.choice(junk)())
        return self.draw.choice(["", "\n", "\n  "]).join(parts), title

    def page(self) -> tuple[str, str]:
        inside, title = self.article()
        depth = self.draw.choice([1, 1, 1, 2, 3])
        for level in range(depth):
            tag = self.draw.choice(["article", "article", "main", "div", "section"]) if self.semantic else self.draw.choice(["div", "div", "td"])
            name = self.draw.choice(["", self.name("content", _CONTENT)])
            after = "".join(f() for f in (self.share, self.aside, self.comments, self.advert) if self.maybe(0.12))
            if tag == "td":
                sides = [self.draw.choice(["", "", self.links(2, 8), self.aside(), self.advert()]) for _ in range(2)]
                cells = "".join(f"<td>{cell}</td>" for cell in (sides[0], inside, sides[1]) if cell)
                inside = f"<table width=100%><tr>{cells}</tr></table>"
            else:
                inside = f"<{tag}{name}>{inside}</{tag}>"
            if level == depth - 1 and self.maybe(0.5) or self.maybe(0.2):
                inside = inside + after
        before = [f() for f, share in ((self.notice, 0.25), (self.header, 0.6), (self.nav, 0.7), (self.advert, 0.35), (self.form, 0.15), (self.aside, 0.2)) if self.maybe(share)]
        behind = [f() for f, share in ((self.comments, 0.35), (self.aside, 0.3), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.15), (self.footer, 0.8)) if self.maybe(share)]
        shown = self.draw.choice([title, f"{title} - {self.site}", f"{self.site} | {title}", title[:60]])
        body = "\n".join([*before, inside, *behind]) if self.maybe(0.5) else "".join([*before, inside, *behind])
        end = "</body></html>" if self.maybe(0.8) else ""
        script = "<script>if (a < b) track('</p>');</script>" if self.maybe(0.6) else ""
        markup = f"<!DOCTYPE html><html><head><title>{self.escaped(shown)}</title><style>p{{margin:0}}</style>{script}</head><body>{body}{end}"
        return markup, "\n\n".join(self.blocks)


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, str]]:
    """``count`` pages with their main text, its blocks joined by empty lines."""
    return [_Page(seed * 1_000_003 + number).page() for number in range(count)]
