"""Labelled pages for training: the texts of sampled pages in generated layouts, and the pages themselves."""

from __future__ import annotations

import numpy as np

from .html_blocks import Block, blocks

#: Marks text of the article in a generated page; a private-use character that is taken out again.
_MARK = ""
#: Containers as tag and words of its class ("-" stands for the tag alone).
_MAIN = "article:- article:post main:- main:content div:content div:main-content div:post-body div:entry-content div:article-body section:story div:text div:page-content section:body div:blog-post div:article div:post div:- section:- div:entry section:main div:story-text".split()
_OTHER = {
    "menu": "nav:- div:nav ul:menu div:menu div:navigation div:navbar ul:breadcrumb div:pagination div:topnav div:toc nav:links ul:nav div:share div:social ul:share-links div:tags".split(),
    "header": "header:- div:header div:masthead div:site-header div:banner div:logo div:top-bar header:top div:branding".split(),
    "footer": "footer:- div:footer div:site-footer div:copyright div:bottom div:legal footer:page-footer section:footer".split(),
    "side": "aside:- div:sidebar div:widget div:related div:recommended div:popular div:right-column section:more-stories div:side aside:rail div:trending section:related-posts".split(),
    "ad": "div:ad div:ads div:advert div:advertisement div:sponsored div:promo ins:adsbygoogle div:ad-slot div:banner-ad aside:ad section:promotion div:sponsor p:ad".split(),
    "notice": "div:cookie div:cookie-notice div:notice div:alert div:consent div:gdpr div:newsletter div:subscribe div:popup div:modal p:disclaimer div:warning div:message section:notice div:cookie-banner".split(),
    "form": "form:- form:search div:login form:contact div:search-form form:signup".split(),
    "comments": "div:comments section:comments ol:comment-list div:discussion div:replies div:reply section:disqus div:respond ul:reviews div:comment-thread section:responses ul:comments article:comment div:feedback".split(),
}
_WRAP = "div:wrapper div:container div:page div:row div:column div:inner div:outer section:- div:- div:layout div:site".split()
_HEADS = {"comments": "Comments", "side": "Related", "notice": "Notice", "form": "Search", "ad": "Advertisement", "menu": "Menu", "footer": "About", "header": "Home"}
_TEXT = "the river runs past the old town and the market opens early in the morning for people from the hills who bring bread and fruit".split()


def _open(kind: str, rng: np.random.Generator) -> tuple[str, str]:
    tag, name = kind.split(":")
    attribute = "" if name == "-" else f' {rng.choice(["class", "class", "class", "id"])}="{name}"'
    return f"<{tag}{attribute}>", f"</{tag}>"


def _labels(found: list[Block]) -> list[bool]:
    """What the tags of a page say: inside an article or main, and not in a part of it that isn't text."""
    out = []
    for b in found:
        tags = [t for t, _ in b.path]
        inside = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=None)
        out.append(inside is not None and not {"nav", "aside", "footer", "form", "header"} & set(tags[inside:]))
    return out


class Layouts:
    """Pages from the paragraphs, headings and short texts of given ones."""

    def __init__(self, pages: list[str], seed: int):
        self.rng = np.random.default_rng(seed)
        self.pages = [found for found in (blocks(p) for p in pages) if found]
        self.texts, self.short = [], []
        for found in self.pages:
            for b, inside in zip(found, _labels(found)):
                (self.texts if inside else self.short).append(b.text.replace(_MARK, ""))
        self.texts = self.texts or [" ".join(_TEXT[i:]) + "." for i in range(0, len(_TEXT), 5)]
        self.short = self.short or _TEXT

    def own(self) -> list[tuple[list[Block], list[bool]]]:
        """The pages whose tags tell the article."""
        pairs = [(found, _labels(found)) for found in self.pages]
        return [(f, y) for f, y in pairs if any(y)]

    def _pick(self, xs: list) -> str:
        return xs[int(self.rng.integers(len(xs)))]

    def _sentence(self) -> str:
        words = self._pick(self.texts).split()
        a = int(self.rng.integers(max(1, len(words) - 3)))
        return " ".join(words[a : a + int(self.rng.integers(1, 25))])

    def _escaped(self, s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;")

    def _boilerplate(self, role: str, kind: str) -> str:
        rng, out = self.rng, []
        a, b = _open(kind, rng)
        say = lambda s: self._escaped(s.replace(_MARK, ""))
        if rng.random() < 0.3:
            out.append(f"<h{rng.integers(2, 5)}>{_HEADS[role] if rng.random() < 0.5 else say(self._sentence())}</h3>")
        if role in ("menu", "side", "footer") and rng.random() < 0.7:
            items = "".join(f'<li><a href="/">{say(self._pick(self.short) if rng.random() < 0.5 else self._sentence())[:60]}</a></li>' for _ in range(rng.integers(2, 9)))
            out.append(items if kind.startswith("ul") else f"<ul>{items}</ul>")
        elif role == "form":
            out.append(f"<label>{say(self._sentence())[:40]}</label><input type='text'><p>{say(self._sentence())}</p><button>{say(self._pick(self.short))[:20]}</button>")
        elif role == "comments":
            one = [f"<{t}>{say(self._sentence() if rng.random() < 0.4 else self._pick(self.texts))}</{t}>" for t in (self._pick(["p", "div", "li"]),) for _ in range(rng.integers(1, 6))]
            inner, end = _open(self._pick(["div:comment", "li:comment", "div:-", "p:-", "div:reply"]), rng)
            out += [f"{inner}{x}{end}" if rng.random() < 0.6 else x for x in one]
        else:
            for _ in range(rng.integers(1, 4)):
                s = say(self._sentence() if rng.random() < 0.7 else self._pick(self.short if rng.random() < 0.5 else self.texts))
                out.append(s if rng.random() < 0.4 else f"<p>{s}</p>")
        return a + "".join(out) + b

    def _article(self, kind: str, most: int) -> str:
        rng, out = self.rng, []
        a, b = _open(kind, rng)
        inner, end = _open(self._pick(_WRAP), rng) if rng.random() < 0.2 else ("", "")
        if rng.random() < 0.85:
            out.append(f"<h{1 if rng.random() < 0.8 else 2}>{_MARK}{self._escaped(self._sentence())}</h1>")
        open_end = rng.random() < 0.25
        for _ in range(rng.integers(1, most)):
            s, r = self._escaped(self._pick(self.texts) if rng.random() < 0.8 else self._sentence()), rng.random()
            if rng.random() < 0.15:
                s = f'{s} <a href="/x">{self._escaped(self._sentence())}</a>'
            if r < 0.80:
                out.append(f"<p>{'<b>' if open_end and rng.random() < 0.4 else ''}{_MARK}{s}{'<br>' if open_end else '</p>'}")
            elif r < 0.87:
                out.append(f"<h{rng.integers(2, 4)}>{_MARK}{self._escaped(self._sentence())[:50]}</h2>")
            elif r < 0.93:
                out.append("<ul>" + "".join(f"<li>{_MARK}{self._escaped(self._sentence())}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
            elif r < 0.96:
                out.append(f"<blockquote><p>{_MARK}{s}</p></blockquote>")
            elif r < 0.98:
                out.append("<table>" + "".join(f"<tr><td>{_MARK}{self._escaped(self._sentence())[:30]}</td></tr>" for _ in range(2)) + "</table>")
            else:
                out.append(f"<pre>{_MARK}{s}</pre>")
            if rng.random() < 0.5 / most:
                role = self._pick(["ad", "side", "notice", "menu"])
                out.append(self._boilerplate(role, self._pick(_OTHER[role])))
        if rng.random() < 0.15:
            role = self._pick(["comments", "menu", "form", "side"])
            out.append(self._boilerplate(role, self._pick(_OTHER[role])))
        return a + inner + "".join(out) + end + b

    def page(self, most: int = 14) -> tuple[list[Block], list[bool]]:
        """One generated page with fewer than most paragraphs: its blocks, and which belong to the article."""
        rng = self.rng
        plain = rng.random() < 0.08  # nothing but position and text tells the parts
        main = "div:-" if plain else self._pick(_MAIN)
        parts: list[str] = []
        for role, p in (("header", 0.5), ("menu", 0.8), ("notice", 0.35), ("ad", 0.4), ("form", 0.2), ("side", 0.25)):
            if rng.random() < p:
                parts.append(self._boilerplate(role, "div:-" if plain else self._pick(_OTHER[role])))
        order = rng.permutation(len(parts)) if rng.random() < 0.4 else np.arange(len(parts))
        parts = [parts[i] for i in order]
        parts.append(self._article(main, most))
        for role, p in (("ad", 0.3), ("comments", 0.55), ("side", 0.4), ("menu", 0.15), ("notice", 0.25), ("form", 0.25), ("footer", 0.75)):
            if rng.random() < p:
                parts.append(self._boilerplate(role, "div:-" if plain else self._pick(_OTHER[role])))
        body = "".join(parts)
        for _ in range(rng.integers(0, 3)):
            a, b = _open(self._pick(_WRAP), rng)
            body = a + body + b
        title = f"<title>{self._escaped(self._sentence())}</title>" if rng.random() < 0.9 else ""
        found = blocks(f"<html><head>{title}</head><body>{body}</body></html>")
        inside = [_MARK in b.text for b in found]
        for b in found:
            b.text = b.text.replace(_MARK, "")
        kept = [(b, y) for b, y in zip(found, inside) if b.text]
        return [b for b, _ in kept], [y for _, y in kept]
