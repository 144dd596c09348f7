"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags).  Each
block has features of its ancestors (tags, words of class and id) and of its
text (length, link share, punctuation).  The field labels the chain of
blocks as content or not; weights are fitted by gradient ascent on the
conditional likelihood (forward-backward) over labelled pages, and Viterbi
decodes.  The labelled pages are composed by ``labelled_pages`` from public
page conventions, so their labels are known by construction.

Defined cases
-------------
* null or empty html, or no content block: empty text, 0 code points;
* truncated or unbalanced markup: open elements end with the page; an unclosed comment or script hides what follows;
* formulas, drawings and fallback content (``math``, ``svg``, ``object``, ``noscript``): their text, in line; a formula's annotations are markup;
* character references without semicolon or unknown: as browsers read them, else left as they are;
* repeated rows and ties: alike (equal scores decode as content last); null ids and urls are kept;
* empty table: empty result; very long or deeply nested pages: whole, in linear time; extra columns: ``extract`` returns its own only.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element of the key's tag ends an open one of these tags, up to the nearest container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Elements whose content is never shown, or belongs to a form.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>script|style|template|textarea|title|select|annotation-xml|annotation)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>"
    r"|</?[a-z!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text, the nearest block-level tag, characters in links, and what its ancestors give: features, or their summed weights."""

    text: str
    own: str
    linked: int
    above: list[str] | tuple[float, float]


@dataclass
class _Open:
    """An open element: its features, and the summed weights of those of all open elements, each counted once."""

    tag: str
    features: tuple[str, ...]
    weights: tuple[float, float]


def blocks(page: str | None, state: dict[str, list[float]] | None = None) -> list[Block]:
    """The leaf blocks of a page, in page order; with ``state`` (weights by feature), ancestors are summed up.

    Every step is amortised constant: sums are kept on the stack of open
    elements, features are counted as elements open and close.
    """
    found: list[Block] = []
    stack: list[_Open] = []
    levels: list[int] = []  # places in the stack of block-level elements
    active: Counter[str] = Counter()
    open_tags: Counter[str] = Counter()
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal run, linked
        text = " ".join("".join(run).split())
        if text:
            above = [f for f, n in active.items() if n] if state is None else stack[-1].weights if stack else (0.0, 0.0)
            found.append(Block(text, stack[levels[-1]].tag if levels else "none", linked, above))
        run, linked = [], 0

    def close(place: int) -> None:
        while len(stack) > place:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            for f in gone.features:
                active[f] -= 1
        while levels and levels[-1] >= place:
            levels.pop()

    for token in _TOKEN.finditer(page or ""):
        text = token["text"]
        if text is not None:
            text = html.unescape(text)
            run.append(text)
            linked += len(text) if open_tags["a"] else 0
            continue
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        elif tag == "br":
            run.append(" ")
        if tag in VOID_TAGS:
            continue
        if token["end"]:
            if open_tags[tag]:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
            continue
        while block and levels and (stack[levels[-1]].tag == "p" or stack[levels[-1]].tag in ENDS.get(tag, ())):
            close(levels[-1])  # a block ends an open paragraph, a list item its predecessor
        attrs = token["attrs"]
        names = {f"name:{w}" for a in _NAMES.finditer(attrs) for w in _WORD.findall(a[2].lower())} if "=" in attrs else set()
        features = (f"in:{tag}", *sorted(names)) if block else tuple(sorted(names))
        a, b = stack[-1].weights if stack else (0.0, 0.0)
        for f in features:
            if not active[f] and state is not None and f in state:
                a, b = a + state[f][0], b + state[f][1]
            active[f] += 1
        open_tags[tag] += 1
        if block:
            levels.append(len(stack))
        stack.append(_Open(tag, features, (a, b)))
    flush()
    return found


def text_features(b: Block) -> list[str]:
    """The features of a block's text and place."""
    n = b.text.count(" ") + 1
    share = b.linked / max(1, len(b.text))
    got = ["any", f"own:{b.own}", f"words:{min(7, n.bit_length())}", f"links:{min(3, int(share * 4))}"]
    got.append("ends" if b.text[-1] in ".!?:;,\"'…»”" else "open")
    if "©" in b.text or "copyright" in b.text.lower():
        got.append("copyright")
    if "|" in b.text or "·" in b.text or "»" in b.text[:-1]:
        got.append("bars")
    return got


def features(chain: list[Block]) -> list[list[str]]:
    """All features of each block of a page."""
    return [text_features(b) + b.above for b in chain]


class Field:
    """Labels 0 (other) and 1 (content); ``state[feature]`` and ``step[label][label]`` are weights."""

    def __init__(self) -> None:
        self.state: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    def __getstate__(self):
        return {"state": dict(self.state), "step": self.step}

    def potentials(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        out = []
        for row in rows:
            a = b = 0.0
            for f in row:
                w = self.state.get(f)
                if w is not None:
                    a += w[0]
                    b += w[1]
            out.append((a, b))
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        return self.viterbi(self.potentials(rows))

    def viterbi(self, at: list[tuple[float, float]]) -> list[int]:
        """The likeliest labels, from the potentials of each block."""
        if not at:
            return []
        best, back = list(at[0]), []
        for own in at[1:]:
            new, came = [], []
            for y in (0, 1):
                zero, one = best[0] + self.step[0][y], best[1] + self.step[1][y]
                came.append(int(one > zero))
                new.append(own[y] + max(zero, one))
            back.append(came)
            best = new
        y = int(best[1] > best[0])
        labels = [y]
        for came in reversed(back):
            y = came[y]
            labels.append(y)
        return labels[::-1]

    def gradient(self, rows: list[list[str]], labels: list[int]) -> tuple[list[tuple[float, float]], list[list[float]]]:
        """Observed less expected counts, for each place and each pair of labels (forward-backward)."""
        at, n, t = self.potentials(rows), len(rows), self.step
        ahead, behind = [at[0]], [(0.0, 0.0)]
        for own in at[1:]:
            p = ahead[-1]
            ahead.append(tuple(own[y] + _add(p[0] + t[0][y], p[1] + t[1][y]) for y in (0, 1)))
        for own in reversed(at[1:]):
            p = behind[-1]
            behind.append(tuple(_add(t[y][0] + own[0] + p[0], t[y][1] + own[1] + p[1]) for y in (0, 1)))
        behind.reverse()
        z = _add(*ahead[-1])
        places = [tuple((labels[i] == y) - exp(ahead[i][y] + behind[i][y] - z) for y in (0, 1)) for i in range(n)]
        steps = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            steps[labels[i - 1]][labels[i]] += 1
            for x in (0, 1):
                for y in (0, 1):
                    steps[x][y] -= exp(ahead[i - 1][x] + t[x][y] + at[i][y] + behind[i][y] - z)
        return places, steps


def _add(a: float, b: float) -> float:
    m = max(a, b)
    return m + log(exp(a - m) + exp(b - m))


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Gradient ascent with per-weight rates; the same pages give the same field."""
    field, seen = Field(), defaultdict(lambda: [1e-6, 1e-6])
    step_seen = [[1e-6, 1e-6], [1e-6, 1e-6]]
    for _ in range(epochs):
        for rows, labels in pages:
            if not rows:
                continue
            places, steps = field.gradient(rows, labels)
            total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for row, (a, b) in zip(rows, places, strict=True):
                for f in row:
                    total[f][0] += a
                    total[f][1] += b
            for f, g in total.items():
                w, s = field.state[f], seen[f]
                for y in (0, 1):
                    d = g[y] - decay * w[y]
                    s[y] += d * d
                    w[y] += rate * d / s[y] ** 0.5
            for x in (0, 1):
                for y in (0, 1):
                    step_seen[x][y] += steps[x][y] ** 2
                    field.step[x][y] += rate * steps[x][y] / step_seen[x][y] ** 0.5
    return field


# --------------------------------------------------------------- labelled pages

#: Names that pages give their parts, by what the part is.
_OTHER_NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager tabs toc",
    "header": "header masthead topbar logo site branding hero",
    "footer": "footer bottom copyright legal imprint colophon credits",
    "aside": "sidebar side aside widget related recommended trending popular more tags archive",
    "ad": "ad ads advert adverts advertisement advertising banner promo promoted sponsored sponsor adbox",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay privacy message",
    "form": "form search login signup subscribe newsletter register contact",
    "comments": "comment comments reply replies respond discussion disqus reader responses feedback",
    "share": "share social sharing buttons follow toolbar meta byline author",
}
_CONTENT_NAMES = "content main article post entry body story text page single"
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch ung der que la os ión mente".split()


def _phrase(rng: random.Random, low: int, high: int, close: bool = True) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    if close and len(words) > 8:
        for i in range(7, len(words) - 1, rng.randint(6, 14)):
            words[i] += rng.choice(".,,")
    return " ".join(words).capitalize() + (rng.choice("....!?") if close else "")


def _prose(rng: random.Random) -> str:
    """A paragraph of content; some are tables of words, loud, repetitive or carry a notice."""
    text, odd = _phrase(rng, 1, rng.choice([6, 40, 120]), rng.random() < 0.9), rng.random()
    if odd < 0.12:
        return text.replace(" ", f" {rng.choice(['|', '|', '·', '»', '***'])} ") + rng.choice(["", " |"])
    if odd < 0.16:
        return text.upper() + "!!"
    if odd < 0.2:
        return " ".join([text.split()[0]] * rng.randint(5, 40))
    if odd < 0.26:
        return rng.choice(["Copyright 2020 ", "&copy; ", "Released under the ", "Call ", "Mail "]) + text
    return text


def _name(rng: random.Random, names: str, sure: bool = False) -> str:
    if not sure and rng.random() < 0.35:
        return ""
    return f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.sample(names.split(), rng.randint(1, 2)))}"'


def _other(rng: random.Random, kind: str) -> tuple[str, list[str]]:
    """A part that is not content: markup and its block texts."""
    names = _OTHER_NAMES[kind]
    own_tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
    tag = own_tag if own_tag and rng.random() < 0.6 else rng.choice(["div", "div", "section"])
    name = _name(rng, names, sure=tag in ("div", "section"))
    if kind == "nav" or kind == "header" and rng.random() < 0.5:
        texts = [_phrase(rng, 1, 3, False) for _ in range(rng.randint(2, 7))]
        items = "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(texts))
        return f"<{tag}{name}><ul>{items}</ul></{tag}>", texts
    if kind == "footer":
        text = rng.choice(["&copy; ", "Copyright ", ""]) + f"{rng.choice(['www.', 'm.', ''])}{_phrase(rng, 1, 1, False)}.example &middot; {_phrase(rng, 3, 14)}"
        inner = rng.choice(["{}", "<p>{}</p>"]).format(text)
        return f"<{tag}{name}>{inner}</{tag}>", [html.unescape(text)]
    if kind == "comments":
        texts = [_phrase(rng, 3, 40) for _ in range(rng.randint(1, 5))]
        inner = rng.choice(["<li><p>{}</p></li>", "<div class='comment'><p>{}</p></div>", "<article><p>{}</p></article>", "<p>{}</p>"])
        head = rng.choice([[], [_phrase(rng, 1, 2, False)]])
        return f"<{tag}{name}>{''.join(f'<h3>{h}</h3>' for h in head)}{''.join(inner.format(t) for t in texts)}</{tag}>", head + texts
    if kind == "form":
        label, button = _phrase(rng, 1, 6, rng.random() < 0.5), _phrase(rng, 1, 2, False)
        return f"<{tag}{name}><label>{label}</label><input><button>{button}</button></{tag}>", [label, button]
    texts = [_phrase(rng, 2, 25, rng.random() < 0.7) for _ in range(rng.randint(1, 3))]
    if kind in ("aside", "share"):
        items = "".join(f"<li><a href='/x'>{t}</a></li>" if rng.random() < 0.6 else f"<p>{t}</p>" for t in texts)
        return f"<{tag}{name}>{items}</{tag}>", texts
    if rng.random() < 0.5:
        return f"<{tag}{name}>{texts[0]}</{tag}>", texts[:1]
    return f"<{tag}{name}>{''.join(f'<p>{t}</p>' for t in texts)}</{tag}>", texts


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Composed pages with the label of each leaf block."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        before = rng.sample(["nav", "header", "ad", "notice", "form", "aside"], rng.choice([0, 0, 1, 2, 3, 4]))
        after = [k for k in rng.sample(["comments", "aside", "ad", "form", "share", "nav"], rng.choice([0, 0, 1, 2, 3, 4]))] + ["footer"] * (rng.random() < 0.8)
        parts, labels = [], []

        def put(kind: str, parts=parts, labels=labels) -> None:
            markup, texts = _other(rng, kind)
            parts.append(markup)
            labels.extend([0] * len(texts))

        for kind in before:
            put(kind)
        container = rng.choice(["article", "article", "main", "div", "section"])
        parts.append(f"<{container}{_name(rng, _CONTENT_NAMES, sure=container in ('div', 'section'))}>")
        if rng.random() < 0.8:
            parts.append(f"<h1>{_phrase(rng, 1, 12, rng.random() < 0.3)}</h1>")
            labels.append(1)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            kind, text = rng.random(), _prose(rng)
            if kind < 0.75:
                parts.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>"]).format(text))
            elif kind < 0.82:
                parts.append(f"<h2>{_phrase(rng, 1, 6, False)}</h2><p>{text}</p>")
                labels.append(1)
            elif kind < 0.9:
                items = [_phrase(rng, 1, 12, rng.random() < 0.5) for _ in range(rng.randint(1, 4))]
                parts.append("<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>")
                labels.extend([1] * (len(items) - 1))
            elif kind < 0.95:
                parts.append(f"<blockquote>{text}</blockquote>")
            else:
                parts.append(f'<p><a href="/y">{_phrase(rng, 1, 3, False)}</a> {text}</p>')
            labels.append(1)
            if rng.random() < 0.08:
                put(rng.choice(["ad", "share", "form", "notice"]))
        if rng.random() < 0.15:
            put("comments")
        parts.append(f"</{container}>")
        for kind in after:
            put(kind)
        body = "".join(parts)
        if rng.random() < 0.4:
            body = f"<div{_name(rng, 'wrapper container page layout row col inner')}>{body}</div>"
        pages.append((f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{body}</body></html>", labels))
    return pages


@lru_cache(maxsize=2)
def trained(n: int = 500, seed: int = 11) -> Field:
    """The field of the composed pages."""
    data = []
    for page, labels in labelled_pages(n, seed):
        chain = blocks(page)
        if len(chain) == len(labels):
            data.append((features(chain), labels))
    return fit(data)


def main_text(page: str | None, field: Field) -> str:
    chain = blocks(page, field.state)
    at = [(a + b.above[0], c + b.above[1]) for b, (a, c) in zip(chain, field.potentials([text_features(b) for b in chain]), strict=True)]
    return "\n\n".join(b.text for b, y in zip(chain, field.viterbi(at), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(field or trained())
    page_id = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model.value) for h in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {page_id}, url string, text string, n_chars long")
