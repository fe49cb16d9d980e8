"""Leaf blocks of a web page in page order, with the tags above each, and the features of a block."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

#: Rows of the tables that path and word features are hashed to.
PATHS, WORDS = 4096, 2048
#: Figures of a block besides its hashed features.
FIGURES = 10

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = {"script", "style", "template", "svg", "noscript", "iframe", "object", "canvas", "textarea", "select", "math", "noframes", "xmp"}
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "iframe", "noframes", "xmp", "textarea", "noscript", "title")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym audio b bdi bdo big cite code data del dfn em embed font i img input ins kbd label map mark meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var video wbr button link meta param area".split())
#: Elements that the start of another one ends, down to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _pieces(attributes: str) -> list[str]:
    """Words of class, id, role and itemprop, in lower case and without a plural s."""
    out = []
    for m in _NAMED.finditer(attributes):
        for w in _PIECE.findall(m[1]):
            w = w.lower()
            out.append(w[:-1] if len(w) > 3 and w.endswith("s") else w)
    return out


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: list[tuple[str, list[str]]], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """The blocks of a page: runs of text between block-level tags, references decoded and white space single. Text of
    scripts, styles and the like is left out, as are comments. Unclosed and stray tags are allowed."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    state = {"linked": 0, "anchors": 0, "path": None}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, state["path"] or list(stack), state["linked"]))
        parts.clear()
        state["linked"], state["path"] = 0, None

    def pop(at: int) -> None:
        for t, _ in stack[at:]:
            state["anchors"] -= t == "a"
        del stack[at:]

    def end(names: set[str], stop: set[str]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                return pop(at)
            if stack[at][0] in stop:
                return None

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if state["path"] is None and not text.isspace():
                state["path"] = [x for x in stack if x[0] not in _INLINE or x[1]]
            if state["anchors"]:
                state["linked"] += len(text.strip())
            parts.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name not in _INLINE and name not in _HIDDEN:
            flush()
        if closing:
            end({name}, set())
            continue
        if name in _RAW and name != "title":
            gone = _RAW[name].search(page, at)
            at = gone.start() if gone else n
            continue
        if name in _HIDDEN:
            gone = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = gone.end() if gone else n
            continue
        if name in _ENDS:
            end(*_ENDS[name])
        elif name not in _INLINE:
            end({"p"}, {"td", "th", "button", "table", "caption"})
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, _pieces(attributes) if attributes else []))
            state["anchors"] += name == "a"
    flush()
    return out


class Hashed(dict):
    """Numbers of strings below size; forgets all when it has held many."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, key: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[key] = n = zlib.crc32(key.encode("utf-8", "surrogatepass")) % self.size
        return n


class Known:
    """What has been hashed before: words, parts of paths, whole paths."""

    def __init__(self):
        self.words, self.parts, self.paths = Hashed(WORDS), Hashed(PATHS), {}

    def path(self, path: list[tuple[str, list[str]]]) -> list[int]:
        """Hashed tags and names above a block, those of its own element once more."""
        key = str(path)
        if key not in self.paths:
            if len(self.paths) > 100_000:
                self.paths.clear()
            own = path[-1] if path else ("", [])
            names = [f"<{t}" for t, _ in path if t not in ("html", "body")] + [f".{w}" for _, ws in path for w in ws]
            names += [f"own<{own[0]}"] + [f"own.{w}" for w in own[1]]
            self.paths[key] = [self.parts[x] for x in dict.fromkeys(names)]
        return self.paths[key]


def features(found: list[Block], known: Known) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Hashed path features and words of each block, and its figures. A block has each word once, so that no run of one
    word says much."""
    number, paths, words, figures = known.words.__getitem__, [], [], []
    for b in found:
        paths.append(known.path(b.path))
        ws = b.text.lower().split()
        words.append(list(map(number, set(ws))))
        t, size = b.text, len(b.text)
        figures.append((size, len(ws), b.linked, t.count(".") + t.count("!") + t.count("?"), t[-1] in ".!?:;\"'”»", len(b.path)))
    size, n, linked, marks, ends, deep = np.array(figures, float).reshape(-1, 6).T
    place = np.arange(len(found)) / max(1, len(found))
    return paths, words, np.stack([np.log1p(size) / 5, np.log1p(n) / 4, linked / np.maximum(1, size), marks / (1 + n), ends, n < 4, size > 200, place, np.minimum(deep, 12) / 12, np.ones(len(found))], axis=1)
