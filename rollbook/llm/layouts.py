"""Labelled pages for the extractor: invented pages of many layouts, each with its main text.

Everything is drawn from a seed: words, languages, punctuation, junk, markup left open, names of
classes, which parts a page has, where they stand and whether they are marked by tags, by
classes or not at all.
"""

from __future__ import annotations

import html
import random

# What sites commonly call these parts.
NAMES = {
    "article": "article post entry story content body text main article-body post-content entry-content story-body main-content page-content blog-post article__content prose",
    "nav": "nav menu navbar navigation main-menu topnav site-nav breadcrumb breadcrumbs pagination pager links tabs",
    "header": "header site-header masthead topbar branding page-header logo top",
    "footer": "footer site-footer page-footer bottom copyright colophon legal foot",
    "aside": "sidebar aside widget widget-area related more-stories recommended popular trending side rail secondary toc",
    "notice": "notice cookie cookie-banner consent gdpr alert message warning disclaimer info-box overlay modal popup paywall",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adsbox ad-slot commercial promotion",
    "form": "form search newsletter subscribe signup login contact search-form subscription",
    "comments": "comments comment-list comment reply replies discussion responses disqus user-comments feedback comment-body",
    "share": "share social sharing social-links buttons toolbar tools actions",
}
NEUTRAL = "container wrapper row col page site inner outer block section layout grid clearfix box wrap".split()
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "search", "article": "main"}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
SYLLABLES = ["th an er in re ed on es st en at ti ha ou it".split(), "en er ch ei ie nd ge sch un ä ß ö be ver".split(),
             "le es ent on re ai eau é è ou que tion".split(), "os as ar en ción ll ñ ía do de ra".split(),
             "и на по ст ро ен ка то ве".split(), list("的一是不了人在有我他这中大来上国")]


class Maker:
    """One page in the making: markup, and the blocks that are main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = self.r.choice(SYLLABLES)
        self.semantic = self.r.random() < 0.55  # parts have tags of their own
        self.named = self.r.random() < 0.85  # parts have telling classes
        self.junk = self.r.choice(["", "", "", "", "###", "%%%", "$$$", "&&&"])
        self.out: list[str] = []
        self.told: list[str] = []

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        made = "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))
        if self.chance(0.02):
            made = str(self.r.randrange(10_000))
        return made + (self.junk if self.chance(0.7) else "")

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most))).capitalize()

    def prose(self, words: int) -> str:
        made: list[str] = []
        while words > 0:
            n = min(words, self.r.randint(1, 18))
            own = [self.word() for _ in range(n)]
            own[0] = own[0].capitalize()
            if n > 6 and self.chance(0.6):
                own[self.r.randrange(2, n - 2)] += ","
            made += own
            made[-1] += self.r.choice("......?!")
            words -= n
        return " ".join(made)

    def attributes(self, part: str) -> str:
        found = []
        if self.named or part in ("ad", "notice", "comments", "share") and self.chance(0.7):
            name = self.r.choice(NAMES[part].split())
            name += self.r.choice(["", "", "", f"-{self.r.randrange(9)}", f" {self.r.choice(NEUTRAL)}"])
            found.append(f'{self.r.choice(("class", "class", "class", "id"))}="{name}"')
        elif self.chance(0.4):
            found.append(f"class=c{self.r.randrange(99)}")
        if part in ROLES and self.chance(0.15):
            found.append(f"role={ROLES[part]}")
        self.r.shuffle(found)
        return "".join(f" {x}" for x in found)

    def open(self, part: str, tag: str | None = None) -> str:
        tag = tag or (TAGS.get(part, "div") if self.semantic or part == "form" else self.r.choice(("div", "div", "section")))
        self.out.append(f"<{tag}{self.attributes(part)}>")
        return tag

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>" + self.r.choice(["", "\n"]))

    def block(self, tag: str, text: str, main: bool = False, linked: float = 0.0, rest: str = "") -> None:
        """One block of text: parts of it in inline markup or links, spaces anywhere, its end tag left out at times."""
        words = text.split()
        shown = [html.escape(w, quote=self.chance(0.5)) for w in words]
        if linked and self.chance(linked):
            shown[0] = f'<a href="/{self.r.randrange(999)}?a=1&b">{shown[0]}'
            shown[-1] += "</a>"
        elif len(words) > 3 and self.chance(0.4):
            inline = self.r.choice(("b", "i", "em", "strong", "span", "a href='#'", "code"))
            i = self.r.randrange(len(words) - 1)
            j = self.r.randrange(i, min(len(words), i + 6))
            shown[i] = f"<{inline}>{shown[i]}"
            if not self.chance(0.1) or inline[0] == "a":
                shown[j] += f"</{inline.split()[0]}>"
        if len(words) > 4 and self.chance(0.1):
            shown[self.r.randrange(1, len(words))] += self.r.choice(["<br>", "<br/>", "<!-- x -->"])
        ending = "" if tag in ("p", "li") and self.chance(0.1) else f"</{tag}>"
        self.out.append(f"<{tag}{rest}>{self.r.choice([' ', '  ', chr(10)]).join(shown)}{ending}" + self.r.choice(["", "", "\n  "]))
        if main:
            self.told.append(" ".join(words))

    # ── parts that are not main text ─────────────────────────────────────────

    def links(self, part: str) -> None:
        tag = self.open(part)
        if self.chance(0.3):
            self.block(self.r.choice(("h2", "h3", "h4", "p", "div")), self.phrase(1, 4))
        if self.chance(0.75):
            listed = self.r.choice(("ul", "ul", "ol"))
            self.out.append(f"<{listed}>")
            for _ in range(self.r.randint(2, 9)):
                self.block("li", self.phrase(1, self.r.choice((2, 10))), linked=0.95)
            self.out.append(f"</{listed}>")
        else:
            self.block("div", " ".join(f"{self.phrase(1, 2)} |" for _ in range(self.r.randint(2, 6))), linked=1.0)
        self.close(tag)

    def header(self) -> None:
        tag = self.open("header")
        self.block(self.r.choice(("div", "h1", "p", "h2")), self.phrase(1, 3), linked=0.6)
        if self.chance(0.4):
            self.block("p", self.phrase(3, 9))
        if self.chance(0.6):
            self.links("nav")
        if self.chance(0.3):
            self.form()
        self.close(tag)

    def form(self) -> None:
        tag = self.open("form", "form" if self.chance(0.8) else None)
        if self.chance(0.6):
            self.block(self.r.choice(("p", "h3", "div", "legend", "h2")), self.prose(self.r.randint(2, 20)))
        self.out.append(f'<label>{self.phrase(1, 3)}</label><input type="text" name="q">')
        if self.chance(0.3):
            self.out.append(f"<select><option>{self.word()}<option>{self.word()}</select>")
        self.block("button", self.phrase(1, 2))
        self.close(tag)

    def ad(self) -> None:
        tag = self.open("ad", self.r.choice(("div", "div", "aside", "section")))
        if self.chance(0.5):
            self.block(self.r.choice(("p", "span", "div", "h4")), self.phrase(1, 3))
        text = self.prose(self.r.randint(2, 40))
        if self.chance(0.5):
            self.out.append(html.escape(text))
        else:
            self.block(self.r.choice(("p", "div")), text, linked=0.5)
        self.close(tag)

    def notice(self) -> None:
        tag = self.open("notice", self.r.choice(("div", "div", "aside", "section", "dialog", "noscript")))
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(("p", "div")), self.prose(self.r.randint(3, 45)))
        if self.chance(0.6):
            self.block("button", self.phrase(1, 2))
        self.close(tag)

    def share(self) -> None:
        tag = self.open("share", self.r.choice(("div", "ul")))
        for _ in range(self.r.randint(2, 5)):
            self.block("li" if tag == "ul" else self.r.choice(("button", "div")), self.phrase(1, 2), linked=0.8)
        self.close(tag)

    def aside(self) -> None:
        if self.chance(0.5):
            return self.links("aside")
        tag = self.open("aside")
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(("h2", "h3", "h4")), self.phrase(1, 6), linked=0.3)
            for _ in range(self.r.randint(1, 3)):
                self.block("p", self.prose(self.r.randint(3, 40)), linked=0.3)
        self.close(tag)

    def comments(self) -> None:
        tag = self.open("comments", self.r.choice(("section", "div", "div", "ol")))
        if tag != "ol":
            self.block(self.r.choice(("h2", "h3", "h4")), self.phrase(1, 3))
        for _ in range(self.r.randint(1, 6)):
            inner = "li" if tag == "ol" else self.r.choice(("div", "article", "div", "section"))
            self.out.append(f"<{inner}{self.attributes('comments')}>")
            self.block(self.r.choice(("div", "h4", "p", "header")), self.phrase(1, 4), linked=0.3)
            for _ in range(self.r.choice((1, 1, 2))):
                self.block(self.r.choice(("p", "p", "div")), self.prose(self.r.randint(2, 80)))
            if self.chance(0.3):
                self.block("div", self.phrase(1, 1), linked=0.9)
            self.out.append(f"</{inner}>")
        if self.chance(0.4):
            self.form()
        self.close(tag)

    def footer(self) -> None:
        tag = self.open("footer")
        if self.chance(0.5):
            self.links("nav")
        text = f"{self.r.choice(('&copy;', '©', '&#169;', ''))} {self.r.randint(1999, 2030)} {html.escape(self.prose(self.r.randint(2, 25)))}"
        self.out.append(text if self.chance(0.5) else f"<p>{text}</p>")
        self.close(tag)

    # ── the main text ────────────────────────────────────────────────────────

    def paragraph(self) -> None:
        words = self.r.choice((self.r.randint(1, 6), self.r.randint(4, 30), self.r.randint(20, 150)))
        self.block("p" if self.chance(0.93) else "div", self.prose(words), main=True, linked=0.02)

    def figure(self) -> None:
        self.out.append('<figure><img src="a.png" alt="x">')
        self.block("figcaption", self.prose(self.r.randint(2, 15)), main=True)
        self.out.append("</figure>")

    def listing(self) -> None:
        tag = self.r.choice(("ul", "ol"))
        self.out.append(f"<{tag}>")
        for _ in range(self.r.randint(2, 7)):
            self.block("li", self.prose(self.r.randint(1, 25)), main=True, linked=0.1)
        self.out.append(f"</{tag}>")

    def quote(self) -> None:
        self.out.append("<blockquote>")
        self.block("p", self.prose(self.r.randint(3, 50)), main=True)
        self.out.append("</blockquote>")

    def table(self) -> None:
        self.out.append("<table>")
        for i in range(self.r.randint(2, 4)):
            self.out.append("<tr>")
            for _ in range(self.r.randint(2, 3)):
                self.block("td" if i else "th", self.phrase(1, 4), main=True)
            self.out.append("</tr>")
        self.out.append("</table>")

    def article(self) -> None:
        tag = self.open("article", "article" if self.semantic and self.chance(0.7) else "main" if self.semantic and self.chance(0.5) else None)
        headed = self.chance(0.2)
        if headed:
            self.out.append("<header>" if self.semantic else "<div>")
        if self.chance(0.85):
            title = self.prose(self.r.randint(2, 14)) if self.chance(0.3) else self.phrase(2, 12)
            self.block(self.r.choice(("h1", "h1", "h1", "h2")), title, main=True)
        if self.chance(0.25):
            self.block(self.r.choice(("p", "div")), self.phrase(2, 6), main=True, rest=self.r.choice(["", " class=byline", " class=date", " class=author"]))
        if headed:
            self.out.append("</header>" if self.semantic else "</div>")
        inner = self.chance(0.25) and self.open("article", "div")
        for _ in range(self.r.choice((1, 2, 4, 8, 14, 22))):
            self.paragraph()
            if self.chance(0.15):
                self.block(self.r.choice(("h2", "h3", "h4")), self.phrase(1, 8), main=True)
            if self.chance(0.12):
                self.r.choice((self.figure, self.listing, self.quote, self.table))()
            if self.chance(0.15):
                self.r.choice((self.ad, self.ad, self.share, self.aside, self.form, self.notice))()
        if inner:
            self.close(inner)
        for part, p in ((self.share, 0.15), (self.comments, 0.12), (self.footer, 0.05 if self.semantic else 0)):
            if self.chance(p):
                part()
        self.close(tag)

    def page(self) -> tuple[str, str]:
        self.out.append(self.r.choice(["<!DOCTYPE html>", ""]) + f"<html lang=en><head><title>{self.phrase(2, 6)}</title>"
                        '<style>p{margin:0}</style><script>if (a<b) document.write("<p>no</p>");</script></head><body>')
        for part, p in ((self.notice, 0.25), (self.ad, 0.3), (self.header, 0.6), (lambda: self.links("nav"), 0.6), (self.ad, 0.3)):
            if self.chance(p):
                part()
        around = self.r.choice((0, 0, 1, 2))
        self.out += [f'<div class="{self.r.choice(NEUTRAL)}">' for _ in range(around)]
        if self.chance(0.15):
            self.aside()
        if self.chance(0.97):
            self.article()
        for part, p in ((self.share, 0.1), (self.comments, 0.35), (self.aside, 0.35), (lambda: self.links("aside"), 0.2), (self.form, 0.15)):
            if self.chance(p):
                part()
        self.out += ["</div>"] * around
        for part, p in ((self.ad, 0.15), (self.footer, 0.8), (self.notice, 0.1)):
            if self.chance(p):
                part()
        if self.chance(0.3):
            self.out.append("<script>track('</div>')</script>")
        self.out.append("</body></html>" if self.chance(0.9) else "")
        return "".join(self.out), "\n".join(self.told)


def page(seed: int) -> tuple[str, str]:
    """A page and its main text, the same for the same seed."""
    return Maker(seed).page()
