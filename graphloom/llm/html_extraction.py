"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read as a stream of tags into leaf blocks: stretches of text between block-level tags, each with its
ancestors. Features are of ancestors (tags, kinds of class and id names, the nearest section) and of the text (length,
links, punctuation, marks); the field has two labels, is trained by gradient ascent of the log-likelihood on seeded
labelled pages of many layouts, and decoded by Viterbi over the page's blocks. Scripts, styles, templates, comments and
everything else that is not text never become blocks.

Reading is linear in the page, however deep it nests or badly it closes: an open element carries what features need of
all its ancestors (made from its parent's when it opens), and the open elements of each tag are kept by place.

Defined results: null or empty html gives the empty text; character references are decoded once; br is white space
inside its block; a tag cut off by the end of the page is dropped; repeated rows repeat their result; an empty table
gives an empty result; other columns, also of clashing names, pass through `extract`.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import text as texts_of
from graphloom.llm.html_pages import MARK, labelled_pages

PAGES, SEED, STEPS, RIDGE, RATE = 600, 11, 250, 0.0005, 0.2

# Element kinds.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre "
    "search section select summary table tbody td tfoot th thead tr ul ins label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title object canvas audio video".split())
MARKED = ("button", "label", "a", "address", "select", "option", "dialog", "noscript")
SECTIONS = ("nav", "header", "footer", "aside", "article", "main", "section", "form", "dialog", "table", "ul", "ol", "blockquote", "figure")
CLOSES = {  # an opening tag -> open tags it closes
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
BOUND = frozenset("table ul ol dl select body".split())
# Kinds of words in class and id names.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs tags",
    "head": "header masthead banner topbar top logo branding",
    "foot": "footer bottom copyright legal colophon",
    "side": "sidebar side widget related recommended recommendations more recent popular share social follow trending",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer warning",
    "form": "form login signup signin newsletter subscribe search register",
    "talk": "comment comments commentlist reply replies disqus discussion review reviews respond",
    "text": "content article post entry story body text main page",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Path(NamedTuple):
    """What features see of an element and all its ancestors."""

    depth: int = 0  # 6 is any number from 6 on
    tag: str = ""
    leaf: str = "none"  # the innermost block-level tag
    near: str = "none"  # the innermost section
    sections: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    last_name: str = "none"
    marked: frozenset[str] = frozenset()  # of MARKED
    inside: int = 0  # 1: a header, 2: an article or main, 3: both, 4 more: a heading of the first level

    def child(self, tag: str, hints: frozenset[str]) -> "Path":
        section = tag in SECTIONS
        return Path(
            min(6, self.depth + 1), tag, tag if tag in BLOCKS else self.leaf, tag if section else self.near,
            self.sections | {tag} if section else self.sections, self.names | hints if hints else self.names,
            max(hints) if hints else self.last_name, self.marked | {tag} if tag in MARKED else self.marked,
            self.inside | {"header": 1, "article": 2, "main": 2, "h1": 4}.get(tag, 0),
        )

    def features(self) -> list[str]:
        out = [f"leaf={self.leaf}", f"near={self.near}", f"leaf={self.leaf},near={self.near}", f"depth={self.depth}"]
        out += [f"in={t}" for t in sorted(self.sections)] + [f"name={k}" for k in sorted(self.names)]
        out += [f"last_name={self.last_name}", f"parent={self.tag}"] + [f"has={t}" for t in sorted(self.marked)]
        return out + (["header_inside"] if self.inside & 3 == 3 else [])


class _Open:
    """The open elements: their paths by place, the places of each tag, and the innermost paragraph that a block ends."""

    def __init__(self) -> None:
        self.paths, self.tags, self.paragraph = [Path()], [""], [-1]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.bounds: list[int] = []

    def push(self, tag: str, hints: frozenset[str]) -> None:
        at = len(self.tags)
        self.paths.append(self.paths[-1].child(tag, hints))
        self.paragraph.append(at if tag == "p" else -1 if tag in BLOCKS else self.paragraph[-1])
        self.tags.append(tag)
        self.places[tag].append(at)
        if tag in BOUND:
            self.bounds.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BOUND:
                self.bounds.pop()
        del self.paths[at:], self.paragraph[at:]

    def close(self, tag: str) -> None:
        if self.places[tag]:
            self.cut(self.places[tag][-1])

    def make_room(self, tag: str) -> None:
        """Closes what an opening tag ends: a paragraph before a block, items and cells before their likes."""
        if tag in BLOCKS and self.paragraph[-1] > 0:
            self.cut(self.paragraph[-1])
        if tag in CLOSES:
            bound = self.bounds[-1] if self.bounds else 0
            some = [p[k] for t in CLOSES[tag] if (p := self.places[t]) and (k := bisect_right(p, bound)) < len(p)]
            if some:
                self.cut(min(some))


class Block:
    __slots__ = ("path", "parts", "links")

    def __init__(self, path: Path):
        self.path, self.parts, self.links = path, [], 0


def _hints(attributes: str) -> frozenset[str]:
    names = ["".join(m) for m in NAMED.findall(attributes)] if attributes else []
    return frozenset(HINT_OF[w.lower()] for n in names for w in PIECES.findall(n) if w.lower() in HINT_OF)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order, each with at least one character that is not white space."""
    opened, found, endless = _Open(), [], set()
    block: Block | None = None
    at, size = 0, len(page)
    while at <= size:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            if block is None and not piece.isspace():
                block = Block(opened.paths[-1])
                found.append(block)
            if block is not None:
                plain = html.unescape(piece) if "&" in piece else piece
                block.parts.append(plain)
                if opened.places["a"]:
                    block.links += len(plain)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] or m[4]
        if not closing and tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is None:
                endless.add(tag)  # nor is there one further on
                if tag not in ("title", "script", "style"):
                    continue
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            block = None
        elif tag == "br" and block is not None:
            block.parts.append(" ")
        if closing:
            opened.close(tag)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            opened.make_room(tag)
            opened.push(tag, _hints(m[3] or m[6] or ""))
    return [b for b in found if any(not p.isspace() for p in b.parts)]


def block_text(block: Block) -> str:
    return " ".join("".join(block.parts).split())


def _band(x: float, edges: tuple) -> int:
    return sum(x > e for e in edges)


def features(blocks: list[Block], texts: list[str]) -> list[list[str]]:
    out, paths = [], {}
    seen_title = False
    for b, t in zip(blocks, texts):
        n, words = len(t), t.count(" ") + 1
        links = _band(b.links / max(1, n), (0.0, 0.3, 0.7))
        size = _band(words, (2, 5, 10, 20, 50, 120))
        if b.path not in paths:
            paths[b.path] = b.path.features()
        some = paths[b.path] + ["bias", f"words={size}", f"links={links}", f"words={size},links={links}",
                 f"end={t[-1:] in '.!?'}", f"sentences={_band(sum(map(t.count, '.!?')), (0, 1, 3))}",
                 f"mark={'©' in t or '|' in t or '·' in t}", f"titled={seen_title}"]
        seen_title = seen_title or b.path.inside & 4 > 0
        out.append(some)
    return out


class Field:
    """Weights of the chain: one per feature and label difference, and one per pair of neighbouring labels."""

    def __init__(self, weight: dict[str, float], pair: np.ndarray):
        self.weight, self.pair = weight, pair.tolist()

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels of a page's blocks, 1 for main text."""
        get, pair = self.weight.get, self.pair
        best, back = [0.0, 0.0], []
        for k, row in enumerate(rows):
            s = sum([get(f, 0.0) for f in row])
            if not k:
                best = [0.0, s]
                continue
            from0 = 0 if best[0] + pair[0][0] >= best[1] + pair[1][0] else 1
            from1 = 0 if best[0] + pair[0][1] > best[1] + pair[1][1] else 1
            back.append((from0, from1))
            best = [best[from0] + pair[from0][0], best[from1] + pair[from1][1] + s]
        if not rows:
            return []
        label = [int(best[1] > best[0])]
        for b in reversed(back):
            label.append(b[label[-1]])
        return label[::-1]


def train(pages: list[str], steps: int = STEPS) -> Field:
    """Fits the field to pages whose main text carries MARK."""
    rows, gold = [], []
    for page in pages:
        blocks = leaf_blocks(page)
        texts = [block_text(b) for b in blocks]
        gold.append([int(MARK in t) for t in texts])
        for b in blocks:
            b.parts = [p.replace(MARK, "") for p in b.parts]
        rows.append(features(blocks, [t.replace(MARK, "").strip() for t in texts]))
    keep = sorted((i for i, r in enumerate(rows) if r), key=lambda i: -len(rows[i]))  # the longest first
    rows, gold = [rows[i] for i in keep], [gold[i] for i in keep]
    names = {f: i for i, f in enumerate(sorted({f for r in rows for b in r for f in b}))}
    n, longest = len(rows), max(map(len, rows))
    real = np.zeros((n, longest), bool)
    y = np.zeros((n, longest), int)
    for i, g in enumerate(gold):
        real[i, : len(g)], y[i, : len(g)] = True, g
    # blocks of the same features are one kind; weights are summed once for each kind
    kinds: dict[tuple, int] = {}
    kind = np.zeros((n, longest), int)
    for i, r in enumerate(rows):
        kind[i, : len(r)] = [kinds.setdefault(tuple(b), len(kinds)) for b in r]
    of = np.array([k for b, k in kinds.items() for _ in b])
    feat = np.array([names[f] for b in kinds for f in b])
    w, pair = np.zeros(len(names)), np.zeros((2, 2))
    memory = [np.zeros(len(names)), np.zeros((2, 2))]
    joint = real[:, 1:]
    going, last = real.sum(axis=0), (np.arange(n), real.sum(axis=1) - 1)
    wanted_pair = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & joint).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(steps):
        score = np.stack([np.zeros((n, longest)), np.bincount(of, w[feat], len(kinds))[kind] * real], axis=2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for k in range(1, longest):
            some = slice(0, going[k])
            forward[some, k] = np.logaddexp.reduce(forward[some, k - 1, :, None] + pair, axis=1) + score[some, k]
        for k in range(longest - 2, -1, -1):
            some = slice(0, going[k + 1])
            backward[some, k] = np.logaddexp.reduce(pair + (score[some, k + 1] + backward[some, k + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[last], axis=1)
        one = np.exp(np.where(real, forward[:, :, 1] + backward[:, :, 1] - total[:, None], -np.inf))
        missed = np.bincount(kind[real], (y - one)[real], len(kinds))
        grad = np.bincount(feat, missed[of], len(names)) / n - RIDGE * w
        both = forward[:, :-1, :, None] + pair + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        grad_pair = (wanted_pair - np.exp(both[joint]).sum(axis=0)) / n - RIDGE * pair
        for value, g, m in ((w, grad, memory[0]), (pair, grad_pair, memory[1])):
            m += g * g
            value += RATE * g / (np.sqrt(m) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()}, pair)


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    texts = [block_text(b) for b in blocks]
    return "\n".join(t for t, y in zip(texts, field.decode(features(blocks, texts))) if y and t)


def extract(pages: DataFrame, field: Field, source: str = "html", to: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of pages (all but source, if None) and `to`: the main text."""
    keep = [n for n in pages.columns if n not in (source, to)] if keep is None else keep
    src = pages.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{source}`").cast("string").alias("__in"))
    texts_of.bound_batches(pages.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"`{to}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in texts_of.slices(batch, "__in"):
                made = [main_text(v.decode("utf-8", "replace"), field) for v in values]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(made, type=pa.string())], names=[*keep, to])

    return src.mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = train(labelled_pages(PAGES, SEED))
    made = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), field, keep=["page_id", "url"])
    return made.withColumn("n_chars", F.length("text").cast("long"))
