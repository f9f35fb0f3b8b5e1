"""Main text of web pages with site template removal.

1. A page is read once, leniently (unclosed and misnested elements close as their parents do), into blocks of text in page
   order and the element subtrees over them, menus, headers, footers and adverts included; only what is no text at all goes
   here (scripts, styles, comments in the markup, forms, embedded objects). A subtree's hash is made of its tag and what is in it,
   children's hashes before its own, so a page takes time in proportion to its length, however deep.
2. Spark counts, for each host and subtree hash, the different pages that hold it; pages with one and the same
   body count once, so copies of an article are no template. Counts are combined before their shuffle, which moves
   hashes, never markup.
3. Subtrees found on at least MANY different pages of a host, whatever its size, are template and go.
   Subtrees all of whose blocks go by rule (4) need no count, as it would change nothing.
   Inside an `article` or `main` element only structural elements (div, section, lists, tables, nav and so on) can be template: text
   that several articles quote stays.
4. What a host repeats too seldom to be counted out goes by rule: nav, header, footer and aside elements and hidden ones, and
   those whose class or id says that they are a menu, advert, notice, sidebar or comments. In an `article` or `main` a name
   must be one of these words as a whole, and headers stay: a class that only holds such a word (`social-history`) is text there.

Defined results: null or empty html gives an empty text; a page whose url has no host belongs to the host ""; repeated
rows are pages like others, counted once; pages may be of any length and depth; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafmill.llm.common import materialize
from grafmill.llm.exact_dedup import flagged

MANY = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object".split())
#: No text, whatever a host repeats.
NEVER = frozenset("head script style form noscript iframe template svg math object button select textarea menu dialog canvas audio video title".split())
#: Page parts that go by rule where counts leave them.
PARTS = frozenset("nav header footer aside".split())
BLOCK = frozenset(
    "html body address article blockquote dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table tbody td tfoot th thead tr ul br details summary center nav header footer aside form".split()
)
STRUCTURE = frozenset("div section ul ol dl table fieldset details figure nav header footer aside".split())
#: Opening one of these closes an open `p`; `li`, `tr` and so on close their like.
CLOSES_P = BLOCK - {"br", "html", "body"}
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of a class or id: anywhere in a name outside articles, as a whole name inside.
_NAMES = (
    "ad|ads|advert\\w*|adsense|banner|sponsor\\w*|promo\\w*|sidebar|side-bar|widget\\w*|nav|navbar|navigation|menu|breadcrumbs?|footer|comments?|commentlist|comment-list|comments-area|disqus|respond|replies|cookie\\w*|consent|"
    "popup|modal|newsletter|subscribe|share|sharing|pagination|pager|login|signup|skip-link|toolbar|related-posts|related-articles"
)
BAD = re.compile(rf"(?:^|[\s_-])(?:{_NAMES}|header|masthead|notice|notices|social|related|recommended|hidden|copyright|disclaimer)(?:$|[\s_-])", re.I)
BAD_INSIDE = re.compile(rf"(?:^|\s)(?:{_NAMES}|[a-z]+[_-](?:ad|ads|advert)|(?:ad|ads)[_-](?:box|slot|unit|container|wrapper|banner))(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|([!?][^>]*)(?:>|$)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CLOSE_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|$)", re.I) for t in RAW}


def ruled(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no main text by its name, role, class or id; ``inside`` an article or main."""
    if tag in PARTS and not (inside and tag == "header"):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and (BAD_INSIDE if inside else BAD).search(value):
            return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Open(list):
    """Open elements: [tag, no text, by rule, inside article or main, blocks and those of main text before, parts of the hash]; where each tag is open."""

    def __init__(self) -> None:
        super().__init__([["", False, False, False, (0, 0), []]])
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]  # open blocks other than p
        self.closers: list[int] = [0]  # open elements whose opening closes a p

    def push(self, node: list) -> None:
        tag, k = node[0], len(self)
        self.append(node)
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK and tag != "p":
            self.blocks.append(k)
        if tag in CLOSES_P:
            self.closers.append(k)

    def leave(self) -> list:
        node = self.pop()
        self.at[node[0]].pop()
        for stack in (self.blocks, self.closers):
            if stack[-1] == len(self):
                stack.pop()
        return node

    def nearest(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of these, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


Blocks = list[tuple[str, bool]]  # text, whether it goes by rule
Subtree = tuple[int, int, int]  # hash, first block, block after the last


def parse(page: str) -> tuple[Blocks, list[Subtree]]:
    """Blocks in page order, and the subtrees over them that could be template."""
    out: Blocks = []
    trees: list[Subtree] = []
    pending: list[str] = []
    stack = _Open()
    plain = 0  # blocks that no rule removes

    def flush() -> None:
        nonlocal plain
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            if text:
                out.append((text, stack[-1][2]))
                plain += not stack[-1][2]
                stack[-1][5].append(text)

    def close() -> None:
        tag, _, _, inside, (first, plain_before), parts = stack[-1]
        block = tag in BLOCK
        if block:
            flush()
        stack.leave()
        if not block:
            stack[-1][5] += parts
        elif parts:
            h = xxhash.xxh64_intdigest("\0".join([tag, *parts]).encode("utf-8", "surrogatepass")) >> 1
            stack[-1][5].append(f"\1{h:x}")
            if plain > plain_before and tag not in ("html", "body", "article", "main", "br") and (not inside or tag in STRUCTURE):
                trees.append((h, first, len(out)))

    def close_to(k: int) -> None:
        while len(stack) > k:
            close()

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at and not stack[-1][1]:
            pending.append(page[at : m.start()])
        at = m.end()
        tag = m.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(3):
            k = stack.nearest((tag,))
            if not k and tag == "p":
                flush()
            elif k and (tag in BLOCK or tag in NEVER or stack.blocks[-1] <= k):
                close_to(k)
            continue
        if tag in BLOCK:
            if not stack[-1][1]:
                flush()
            if tag in CLOSES_P and (k := stack.closers[-1]) and stack[k][0] == "p":
                close_to(k)
        if tag in LIKE and (k := stack.nearest(LIKE[tag])) > stack.nearest(STOPS[tag]):
            # the outermost of its like that no stop parts from here
            close_to(min(x for t in LIKE[tag] if stack.at.get(t) and (x := stack.at[t][-1]) > stack.nearest(STOPS[tag])))
        if tag == "body":  # a head left open ends here
            close_to(max(1, stack.nearest(("html",)) + 1))
        if tag in VOID or m.group(5).endswith("/") and tag not in BLOCK:
            continue
        _, no_text, by_rule, inside, _, _ = stack[-1]
        if tag in RAW:
            end = _CLOSE_RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        rule = by_rule or not no_text and ruled(tag, m.group(5), inside)
        if rule and not by_rule and tag not in BLOCK:
            flush()  # an inline element that goes by rule is a block of its own
        stack.push([tag, no_text or tag in NEVER, rule, inside or tag in ("article", "main"), (len(out), plain), []])
    if at < len(page) and not stack[-1][1]:
        pending.append(page[at:])
    close_to(1)
    flush()
    return out, trees


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


PARSED = "page_id long, url string, host string, body long, blocks array<string>, ruled array<boolean>, trees array<struct<h: long, a: int, z: int>>"
_TREES = pa.list_(pa.struct([("h", pa.int64()), ("a", pa.int32()), ("z", pa.int32())]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [parse(page) for page in b.column(2).to_pylist()]
        hosts = [host(u) for u in b.column(1).to_pylist()]
        bodies = [xxhash.xxh64_intdigest("\0".join(t for t, rule in blocks if not rule).encode("utf-8", "surrogatepass")) >> 1 for blocks, _ in found]
        columns = [b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array([[t for t, _ in x] for x, _ in found], pa.list_(pa.string())), pa.array([[r for _, r in x] for x, _ in found], pa.list_(pa.bool_()))]
        trees = pa.array([[{"h": h, "a": a, "z": z} for h, a, z in x] for _, x in found], _TREES)
        yield pa.RecordBatch.from_arrays([*columns, trees], names=["page_id", "url", "host", "body", "blocks", "ruled", "trees"])


def main_text(blocks: list[str], ruled: list[bool], trees: list[dict], gone: list[int] | None) -> tuple[str, int, int]:
    """Text of the blocks that neither a template subtree holds nor a rule removes; how many blocks go by count and by rule."""
    gone, steps = set(gone or ()), [0] * (len(blocks) + 1)
    for t in trees:
        if t["h"] in gone:
            steps[t["a"]] += 1
            steps[t["z"]] -= 1
    out, over, counted = [], 0, 0
    for text, rule, step in zip(blocks, ruled, steps, strict=False):
        over += step
        if not rule and over:
            counted += 1
        elif not rule:
            out.append(text)
    return " ".join(out), counted, len(blocks) - counted - len(out)


def _without_template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [main_text(*x) for x in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        columns = [pa.array([x[0] for x in made], pa.string()), pa.array([len(x[0]) for x in made], pa.int64()), *(pa.array([x[k] for x in made], pa.int64()) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["page_id", "url", "text", "n_chars", "n_template", "n_ruled"])


def extract(pages: DataFrame, many: int = MANY) -> DataFrame:
    """page_id, url, text, n_chars; n_template and n_ruled: blocks that went by count alone, and by rule."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    parsed = materialize(source.mapInArrow(_parsed, PARSED).withColumn("key", F.xxhash64("host", "body", "trees.h")), "parsed-pages")
    marks = F.explode(F.array_distinct("trees.h")).alias("mark")
    seen = parsed.select("host", "body", marks).distinct().groupBy("host", "mark").agg(F.count("*").alias("n"))
    template = materialize(seen.where(F.col("n") >= many).select("host", "mark"), "template")
    # only pages that may hold such a subtree are shuffled; tables of fixed size tell on the scan that others do not
    held = flagged(parsed.select("key", "host", marks), template, "mark").where("maybe").select("key", "mark", "host")
    hit = materialize(held.join(template, ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("gone")), "template-hits")
    rows = flagged(parsed, hit, "key")
    looked = rows.where("maybe").join(hit, "key", "left")
    left = looked.unionByName(rows.where("not maybe").withColumn("gone", F.lit(None).cast("array<bigint>")))
    return left.select("page_id", "url", "blocks", "ruled", "trees", "gone").mapInArrow(_without_template, "page_id long, url string, text string, n_chars long, n_template long, n_ruled long")
