"""Main text of web pages by union-free wrappers inferred from pages of the same host.

1. Every page becomes a token stream: opening and closing tags (with class, id and role) and text slots.
   Adjacent repeats of a group of tokens are folded into one repeated group ``( ... )+``, so pages that differ
   only in how many paragraphs or menu entries they have share one expression. The different expressions of
   a host are few; they are found by an aggregation over (host, expression).
2. All of a host's expressions are aligned, one after the other, by their longest common subsequence: what both
   have stays, what one lacks becomes an optional group ``( ... )?``, a group that one side repeats is repeated,
   and what the wrapper covers already adds nothing. The result is a regular expression without unions, the
   host's wrapper. Hosts are aligned in PARTS hash parts first, whose wrappers are aligned again in fewer, so a
   host with a third of all pages is no single task's work.
3. From the wrapper follows the element that holds the article: the article or main element (or one of such a
   name) with the most text slots, where a slot counts more the deeper it stands in repeated groups, and slots of
   links do not count. Without one the whole page is read, but for elements whose slots are repeated links only.
4. Inside the holder an element is left out if HTML itself says that it is no article text (nav, aside, footer, form,
   ...), or if all words of one of its names speak of menus, adverts, notices, comments and the like ("ad-slot", not
   "share-price"). Names on the holder or around it, or on an element that holds most of the slots, drop nothing.
   What the article's own text says decides nothing, so a paragraph stays however many pages share it.

Blocks are the text between tags of block elements and line breaks. Null html, and pages without any text
slot, give an empty text. A null or odd url counts as a host of its own name. Repeated rows are extracted
once each, ties between holders go to the larger name; very long pages are read whole; empty tables give empty
results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import difflib
import html as html_lib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import BROADCAST_ROWS, write_out

PARTS = (4096, 256, 16, 1)  # hash parts of a host, level by level; each divides the one before
BROADCAST_BYTES = 16 << 20
FOLD = 24  # longest group of tokens that is looked for as a repeat

# A quote opens a value right behind an equals sign only; anywhere else it is a letter of a name or value.
VALUE = r"""=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?"""
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:{VALUE}|[^>=])*+)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
NAMING = {"class": ".", "id": "#", "role": " role="}
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
NOT_TEXT = frozenset("script style noscript template textarea iframe svg nav footer aside form button select dialog".split())
# Words of class names and ids: a name tells of other things than the article if it has one of the first and no
# word outside of both lists.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer cookie cookies notice consent comment comments disqus replies share sharing social related newsletter subscribe popup modal login search complementary contentinfo".split()
)
FRAME_WORDS = frozenset(
    "box block list section wrapper wrap container slot unit area bar widget inner outer site page main post posts item items link links button buttons top bottom left right signup "
    "form panel overlay group row reader readers user thread global primary secondary mobile sticky".split()
)
HOLDERS = (re.compile(r"^article\b"), re.compile(r"^main\b"), re.compile(r"\brole=main\b"), re.compile(r"[.#](?:article|post|entry|main|content)(?:[-_](?:body|content|text|main))?(?:$|[.# ])"))
CLOSES = {"p": "p", "li": "li", "td": "td th", "th": "td th", "tr": "tr td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}


def events(page: str):
    """(kind, signature or text): kind is 'open', 'close', 'void' or 'text'; contents of raw elements are left out."""
    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            yield "text", m[4]
        elif m[2] is not None:
            name = m[2].lower()
            if m[1]:
                yield "close", name
                continue
            sign = name
            if "=" in m[3]:
                for a in ATTRIBUTE.finditer(m[3]):
                    mark = NAMING.get(a[1].lower())
                    if mark and a[0] != a[1]:
                        value = " ".join((a[2] or a[3] or a[4] or "").split())
                        sign += mark + re.sub(r"\d+", "0", value)
            if name in VOID:
                yield "void", sign
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                yield "open", sign


Item = str | tuple  # a token, or ("+", items) or ("?", items)


def fold(items: list[Item]) -> list[Item]:
    """Adjacent repeats of a group become one ("+", group); short groups first, so groups nest."""
    for size in range(1, FOLD + 1):
        out: list[Item] = []
        i = 0
        while i < len(items):
            group = tuple(items[i : i + size])
            n = 1
            while len(group) == size and tuple(items[i + n * size : i + (n + 1) * size]) == group:
                n += 1
            if out and out[-1] == ("+", group):
                i += n * size
            elif n > 1:
                out.append(("+", group))
                i += n * size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _tuples(x):
    return tuple(_tuples(y) for y in x) if isinstance(x, list) else x


def flat(items) -> list[str]:
    """The tokens of an expression, each group once."""
    out: list[str] = []
    for x in items:
        out += flat(x[1]) if isinstance(x, tuple) else [x]
    return out


def expression(page: str) -> str:
    """The page's folded token stream as text."""
    tokens: list[str] = []
    for kind, value in events(page):
        if kind != "text":
            tokens.append({"open": "<", "close": "</", "void": "<!"}[kind] + value + ">")
        elif value.strip() and (not tokens or tokens[-1] != "#"):
            tokens.append("#")
    return json.dumps(fold(tokens), ensure_ascii=False)


def covers(x: list[Item], y: list[Item]) -> bool:
    """Whether the expression x takes the items y as they stand."""

    def ends(items, at: set[int]) -> set[int]:
        for item in items:
            step = {i + 1 for i in at if i < len(y) and y[i] == item}
            if isinstance(item, tuple):
                new = ends(item[1], at)
                step |= new | (at if item[0] == "?" else set())
                while item[0] == "+" and (new := ends(item[1], new) - step):
                    step |= new
            at = step
            if not at:
                break
        return at

    return len(y) in ends(x, {0})


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """One union-free expression that covers both. Common items stay. Where they differ: a group that one
    side repeats and the other has once is repeated, two repeated groups are aligned inside, and anything
    else becomes optional."""
    out: list[Item] = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        x, y = a[i:j], b[k:m]
        if tag == "equal":
            out += x
        elif covers(x, y):
            out += x
        elif covers(y, x):
            out += y
        elif len(x) == 1 and len(y) == 1 and isinstance(x[0], tuple) and isinstance(y[0], tuple) and x[0][0] == y[0][0]:
            out.append((x[0][0], tuple(align(list(x[0][1]), list(y[0][1])))))
        else:
            for part in (x, y):
                if part:
                    out.append(part[0] if len(part) == 1 and isinstance(part[0], tuple) and part[0][0] == "?" else ("?", tuple(part)))
    return out


def infer(expressions: list[str]) -> str:
    """The wrapper of a host from its expressions, the longest first."""
    streams = sorted((_tuples(json.loads(x)) for x in set(expressions)), key=lambda x: (-len(flat(x)), str(x)))
    if not streams:
        return "[]"
    wrapper = list(streams[0])
    for s in streams[1:]:
        wrapper = align(wrapper, list(s))
    return json.dumps(wrapper, ensure_ascii=False)


def _name(sign: str) -> str:
    return re.split(r"[.# ]", sign, maxsplit=1)[0]


@lru_cache(maxsize=65536)
def _is_boilerplate(sign: str) -> bool:
    """Whether the element's own kind or all words of one of its names tell of other things than the article."""
    name = _name(sign)
    if name in ("html", "body"):
        return False
    if name in NOT_TEXT:
        return True
    for token in re.split(r"[\s.#]+|role=", sign[len(name) :].lower()):
        words = [w for w in re.split(r"[_\W\d]+", token) if w]
        if any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in FRAME_WORDS for w in words):
            if not ("header" in words and "post" in words):  # an article's own head
                return True
    return False


def _slots(items, repeats: int = 0):
    """(token, number of repeated groups around it) of an expression."""
    for x in items:
        if isinstance(x, tuple):
            yield from _slots(x[1], repeats + (x[0] == "+"))
        else:
            yield x, repeats


@lru_cache(maxsize=4096)
def plan(wrapper: str) -> tuple[str, frozenset[str]]:
    """From a wrapper: the signature of the element that holds the article ('' for the whole page), and the
    signatures of elements that are not part of it."""
    path: list[str] = []
    signs: dict[str, list[int]] = {}  # weight of text slots, repeated link slots
    slots: dict[int, dict[str, int]] = {}  # by the number of elements around a slot that look like boilerplate
    texts: dict[int, int] = {}
    for token, repeats in _slots(_tuples(json.loads(wrapper))):
        if token == "#":
            link = any(_name(s) == "a" for s in path)
            weight = 0 if link else 1 + 2 * repeats
            # An element's level is the number of such elements down to it, itself included.
            outer, level = set(), 0
            dropped = [_is_boilerplate(s) for s in path]
            texts[sum(dropped)] = texts.get(sum(dropped), 0) + weight
            for n, s in enumerate(path):
                level += dropped[n]
                if s not in outer:
                    signs[s][0] += weight
                    signs[s][1] += link and repeats > 0
                    if not any(dropped[n + 1 :]):
                        slots.setdefault(level, {})[s] = slots.get(level, {}).get(s, 0) + weight
                outer.add(s)
        elif token.startswith("</"):
            name = token[2:-1]
            if any(_name(s) == name for s in path):
                while path and _name(path.pop()) != name:
                    pass
        elif token.startswith("<") and not token.startswith("<!"):
            signs.setdefault(token[1:-1], [0, 0])
            path.append(token[1:-1])
    drop = frozenset(s for s in signs if _is_boilerplate(s))
    for level in sorted(slots):
        # Around or on the article, a name like boilerplate's counts for nothing where the element holds more
        # slots than stand outside of all such elements.
        less = sum(n for k, n in texts.items() if k < level)
        for pattern in HOLDERS:
            found = [s for s, n in slots[level].items() if pattern.search(s) and n > less and _name(s) not in NOT_TEXT]
            if found:
                holder = max(found, key=lambda s: (slots[level][s], s))
                return holder, drop
    menus = {s for s, (weight, links) in signs.items() if links and not weight and s != _name(s)}
    return "", drop | menus | {s for s in signs if re.match(r"header\b", s)}


def main_text(page: str | None, wrapper: str) -> str:
    """The article's blocks of one page, joined by newlines."""
    if not page:
        return ""
    holder, drop = plan(wrapper)
    blocks: list[str] = []
    parts: list[str] = []
    path: list[tuple[str, str, bool, bool]] = []  # name, signature, inside the holder, dropped

    def end_block() -> None:
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    inside, dropped, seen = holder == "", False, holder == ""
    for kind, value in events(page):
        if kind == "text":
            if inside and not dropped:
                parts.append(value)
            continue
        name = _name(value)
        if name not in INLINE:
            end_block()
        if kind == "open":
            closes = CLOSES.get(name, "").split()
            while path and path[-1][0] in closes:
                path.pop()
            above = path[-1] if path else ("", "", holder == "", False)
            # Names decide inside the holder only, not on it or around it.
            inside, dropped = above[2] or value == holder, above[2] and (above[3] or value in drop or _is_boilerplate(value))
            path.append((name, value, inside, dropped))
            seen = seen or inside
        elif kind == "close" and any(p[0] == name for p in path):
            while path.pop()[0] != name:
                pass
            inside, dropped = path[-1][2:] if path else (holder == "", False)
    end_block()
    if not seen:  # a page without its host's article element stands for itself
        return main_text(page, expression(page))
    return "\n".join(blocks)


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\s]*)", 1))
    return pages.select(F.col("page_id"), F.col("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: one row for each host."""

    def read(batches):
        for batch in batches:
            found = sorted({(h, expression(p)) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=pa.string()) for i in (0, 1)], names=["host", "expression"])

    def aligned(key: tuple, table: pa.Table) -> pa.Table:
        part = key[1].as_py() if len(key) > 1 else 0
        return pa.table({"host": pa.array([key[0].as_py()], type=pa.string()), "part": pa.array([part], type=pa.int64()), "expression": [infer(table.column("expression").to_pylist())]})

    found = _hosts(pages).select("host", "html").mapInArrow(read, "host string, expression string").distinct()
    found = write_out(found, "streams").withColumn("part", F.xxhash64("expression"))
    for n in PARTS[:-1]:
        # The part of an expression goes on as that of its wrapper, modulo the next level's number.
        found = found.withColumn("part", F.pmod("part", F.lit(n))).groupBy("host", "part").applyInArrow(aligned, "host string, part bigint, expression string")
    return found.groupBy("host").applyInArrow(aligned, "host string, part bigint, expression string").select("host", F.col("expression").alias("wrapper"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    wrappers = write_out(host_wrappers(pages), "wrappers").withColumnRenamed("host", "_host")
    n, size = wrappers.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()
    few = n <= BROADCAST_ROWS // 50 and size <= BROADCAST_BYTES
    rows = _hosts(pages)
    rows = rows.join(wrappers.hint("broadcast" if few else "shuffle_merge"), rows["host"] == wrappers["_host"], "left").select("page_id", "url", "html", "wrapper")

    def extract(batches):
        for batch in batches:
            texts = [main_text(p, w or "[]") for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
