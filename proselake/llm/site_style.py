"""Main text of web pages (operator 10): a site style tree for each host.

The pages of a host are merged by the style of their branches: the path of tags and classes from the body down. A branch's
importance is a weighted sum of the entropy of its contents and that of its layouts over the host's pages, each with the
logarithm to the base of the number of pages: 1 where every page has another content, 0 where all have the same. Outside of
a main region it is also weighed by the branch's volume against that of the host's main text.

What an element is called only sets the importance that its branch needs, its prior:

- `m`, in an article or another main region: none. An outer or inner word never drops such text.
- `o`, in no such region: `least`. On a page that has a main region the rest (`x`) needs `most`, as much as an article has.
- `a`, in a main region, in an element whose name is ambiguous (notice, discussion, legal ...): `least`.
- `s`, menus, headers, footers, asides, forms, adverts and so on: `most`, at twice the volume.

Reader comments, hidden branches, scripts, and menus, forms or adverts in the midst of an article are never main text. Where a
host has fewer than `least_pages` pages with a branch, entropy says nothing and the prior decides: `m`, `o` and `a` stay.
An article in a form, or in an element named like noise, counts where the page has no other; so does a form around all text.

Pages are parsed once. Branches are counted with map-side combining, by host, path and content, so that a host with a third
of all pages meets in no task; pages join only the branches of their host whose importance overturns the prior.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.common import cut

#: Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video map textarea select".split())
FLOW_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption td th caption".split())
BLOCK = FLOW_TEXT | frozenset("html head body article section main div header footer nav aside form fieldset address ul ol dl table thead tbody tfoot tr figure hr details summary dialog menu hgroup search legend title center".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button fieldset search label legend input".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Words in class, id and role that name a branch's purpose.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share sharing related recommended recommendations pagination pager skip complementary contentinfo".split()
)
AMBIGUOUS_WORDS = frozenset("aside header notice notices alert alerts social respond discussion widget widgets search form copyright legal disclaimer toc tags dialog".split())
MAIN_WORDS = frozenset("article content main post story entry articlebody maincontent".split())
#: Words of a name that say how a branch looks, not what it is; and those that say what it has.
SHAPE_WORDS = frozenset("left right top bottom inner outer wrapper wrap container box list item items area block section widget links link bar buttons button text body content posts post entry slot unit panel group col column row".split())
HAVING_WORDS = frozenset("has with no is without not hide show".split())
TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<decl>[!?][^>]*)>?|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _purpose(name: str) -> str:
    """What one name of an element tells: 'comment', 'noise', 'ambiguous', 'main' or ''.

    The last word that isn't about shape counts; a name of noise and shape alone is noise, one that says what it has is nothing.
    """
    words = WORD.findall(name)
    if not words or words[0] in HAVING_WORDS:
        return ""
    core = [w for w in words if w not in SHAPE_WORDS] or words[-1:]
    kinds = (("comment", COMMENT_WORDS), ("noise", NOISE_WORDS), ("ambiguous", AMBIGUOUS_WORDS), ("main", MAIN_WORDS))
    if len(core) > 1 and core[0] in COMMENT_WORDS | NOISE_WORDS and all(any(w in of for _, of in kinds[:3]) for w in core):
        return "comment" if core[0] in COMMENT_WORDS else "noise"
    return next((kind for kind, of in kinds if core[-1] in of), "main" if words[-1] in MAIN_WORDS and len(core) == len(words) else "")


def _style(tag: str, attrs: str) -> tuple[str, set[str], bool]:
    """Style of an element, its purposes by name, and whether it is hidden."""
    if not attrs or attrs.isspace():
        return tag, set(), False
    told, hidden, style = set(), False, tag
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        else:
            told.update(map(_purpose, value.split()))
            if name == "class":
                style = f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '', value).split()))}"
    return style, told - {""}, hidden


class _Node:
    __slots__ = ("tag", "path", "kind", "begin")

    def __init__(self, tag: str, path: str, kind: str) -> None:
        self.tag, self.path, self.kind, self.begin = tag, path, kind, (0, 0)


def _child(top: _Node, tag: str, attrs: str) -> _Node:
    """The node of an element in `top`. Kinds: o, m, a, s as above; w: main in noise; f: in a form; n: never main text."""
    kind, path = top.kind, top.path
    if kind == "n":
        return _Node(tag, path, "n")
    style, told, hidden = _style(tag, attrs)
    own = f"{path}/{style}"
    within = kind in "maw"
    if hidden or tag in ("head", "title") or "comment" in told:
        return _Node(tag, own, "n")
    named_main = "main" in told and not told & {"noise", "ambiguous"} and tag in ("div", "section", "td", "main", "article")
    if tag in MAIN_TAGS or named_main:
        return _Node(tag, own, kind if within else {"o": "m", "s": "w", "f": "w"}[kind])
    if tag in NOISE_TAGS or tag == "header" and not within:
        if within:
            return _Node(tag, own, "n")
        return _Node(tag, own, "f" if tag in ("form", "fieldset") and kind in "of" else "s")
    if tag not in FLOW_TEXT or tag in ("p", "li"):
        if "noise" in told:
            return _Node(tag, own, "n" if within else "s")
        if "ambiguous" in told and kind in "mof":
            return _Node(tag, own, "a" if kind == "m" else "s")
    if tag in FLOW_TEXT or tag not in BLOCK or kind == "s":
        return _Node(tag, path, kind)
    return _Node(tag, own, kind)


def blocks(page: str | None) -> list[tuple[str, str, str, float]]:
    """Text blocks of a page in order: (path of the innermost branch, kind, text, share of link text)."""
    if not page:
        return []
    out: list[tuple[str, str, str, float]] = []
    stack = [_Node("", "", "o")]
    parts: list[str] = []
    linked: list[int] = []
    pos, links = 0, 0

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                share = sum(linked) / max(1, sum(map(len, parts)))
                out.append((stack[-1].path, stack[-1].kind, text, share))
            parts.clear()
            linked.clear()

    def pop_to(k: int) -> None:
        nonlocal links
        links -= sum(n.tag == "a" for n in stack[k:])
        n = stack[k]
        if n.tag not in BLOCK and n.kind in "ns" and stack[k - 1].kind not in "ns" and n.begin[0] == len(out):
            del parts[n.begin[1] :]  # noise in the midst of a line
        del stack[k:]

    for m in TAG.finditer(page):
        if m.start() < pos:
            continue
        if m.start() > pos:
            parts.append(page[pos : m.start()])
            if links:
                linked.append(m.start() - pos)
        pos = m.end()
        name = m["name"]
        if name is None:
            continue
        tag = name.lower()
        if m["close"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                if tag in BLOCK or any(n.tag in BLOCK for n in stack[k:]):
                    # an inline end tag doesn't close blocks around it
                    if tag not in BLOCK:
                        continue
                    flush()
                pop_to(k)
            elif tag in BLOCK:
                flush()
            continue
        attrs = m["attrs"] or ""
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if any(n.tag == "p" for n in stack):  # a block ends an open paragraph, and what is open in it
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p")
                if not any(n.tag in BLOCK for n in stack[k + 1 :]):
                    pop_to(k)
            if tag in CLOSED_BY:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSED_BY[tag]:
                        pop_to(k)
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "div"):
                        break
        if tag in ("html", "body"):
            continue
        stack.append(_child(stack[-1], tag, attrs))
        stack[-1].begin = len(out), len(parts)
        if tag == "a":
            links += 1
    if pos < len(page):
        parts.append(page[pos:])
    flush()
    return out


def settled(page: str | None, most_links: float = 0.8, form_times: int = 4, form_chars: int = 200) -> list[tuple[str, str, str]]:
    """(path, kind, text) of a page's blocks, kinds settled to m, a, o, x and s by what else the page has."""
    found = [(p, k, t, share) for p, k, t, share in blocks(page) if k != "n"]
    size = Counter()
    for _, k, t, _ in found:
        size[k] += len(t)
    to = {"w": "s", "f": "s"}
    if size["m"] or size["w"] > size["o"]:
        to |= {"o": "x"} if size["m"] else {"o": "x", "w": "m"}
    elif size["f"] >= form_chars and size["f"] > form_times * size["o"]:
        to |= {"f": "o"}
    out = []
    for p, k, t, share in found:
        k = to.get(k, k)
        out.append((p, "s" if k in "oa" and p and share > most_links else k, t))
    return out


def host_of(url):
    """What stands after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty if there is none."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


PARSED = "id long, url string, host string, paths array<string>, kinds array<string>, texts array<string>, branches array<struct<path:string,kind:string,content:long,layout:long,chars:long>>"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_links: float = 0.8) -> DataFrame:
    """A row for each page: its blocks, and for each branch of one kind the hash of its text, its number of blocks and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("content", pa.int64()), ("layout", pa.int64()), ("chars", pa.int64())]))
        for b in batches:
            paths, kinds, texts, branches = [], [], [], []
            for page in b.column(3):
                got = settled(page.as_py(), most_links)
                own: dict[tuple[str, str], list[str]] = {}
                for p, k, t in got:
                    own.setdefault((p, k), []).append(t)
                paths.append([p if k != "m" else None for p, k, _ in got])
                kinds.append([k for _, k, _ in got])
                texts.append([t for _, _, t in got])
                branches.append([{"path": p, "kind": k, "content": xxhash.xxh64_intdigest("\n".join(t).encode("utf-8", "surrogatepass")) >> 1, "layout": len(t), "chars": sum(map(len, t))} for (p, k), t in own.items()])
            strings = pa.list_(pa.string())
            cols = [b.column(0), b.column(1), b.column(2), pa.array(paths, strings), pa.array(kinds, strings), pa.array(texts, strings), pa.array(branches, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "host", "paths", "kinds", "texts", "branches"])

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), host_of(url).alias("host"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, PARSED)


def branch_importance(parsed_pages: DataFrame, content_weight: float = 0.9) -> DataFrame:
    """(host, path, kind, pages, importance, volume): the style tree's branches.

    importance: entropy of contents and layouts; 1 for one page alone. volume: mean size against that of the host's main text
    (kind m, or o where it has none).
    """
    counted = cut(parsed_pages.select("host", F.explode("branches").alias("b")).groupBy("host", "b.path", "b.kind", "b.content", "b.layout").agg(F.count(F.lit(1)).alias("n"), F.sum("b.chars").alias("chars")))

    def entropy(of: str) -> DataFrame:
        c = counted.groupBy("host", "path", "kind", of).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
        part = c.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum("chars").alias("chars"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
        m = F.col("pages")
        return part.select("host", "path", "kind", "pages", "chars", F.when(m > 1, 1 - F.col("nlogn") / (m * F.log(m))).otherwise(1.0).alias(f"{of}_entropy"))

    keys = ["host", "path", "kind"]
    both = entropy("content").join(entropy("layout").drop("pages", "chars"), keys)

    def mean_of(kind: str):
        return F.try_divide(F.sum(F.when(F.col("kind") == kind, F.col("chars"))), F.max(F.when(F.col("kind") == kind, F.col("pages"))))

    main = counted.groupBy("host", "path", "kind").agg(F.sum("chars").alias("chars"), F.sum("n").alias("pages")).groupBy("host").agg(F.coalesce(mean_of("m"), mean_of("o"), F.lit(1.0)).alias("main"))
    importance = content_weight * F.col("content_entropy") + (1 - content_weight) * F.col("layout_entropy")
    return both.join(main, "host").select(*keys, "pages", importance.alias("importance"), (F.col("chars") / F.col("pages") / F.greatest("main", F.lit(1.0))).alias("volume"))


def overturned(branches: DataFrame, least: float = 0.4, most: float = 0.9, least_pages: int = 4) -> DataFrame:
    """(host, branches): the branches, as kind and path, that importance cuts against their prior (o, a) or keeps (x, s)."""
    weighed = F.col("importance") * F.least(F.lit(1.0), F.col("volume") / F.when(F.col("kind") == "s", 2.0).otherwise(1.0))
    low = F.col("kind").isin("o", "a") & (F.col("path") != "") & (F.col("importance") < least)
    high = F.col("kind").isin("x", "s") & (weighed >= most)
    told = branches.where((F.col("pages") >= least_pages) & (low | high))
    return told.groupBy("host").agg(F.sort_array(F.collect_set(F.concat("kind", "path"))).alias("branches"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.4, most: float = 0.9, least_pages: int = 4, most_links: float = 0.8, broadcast_rows: int = 10_000) -> DataFrame:
    """(id, url, text, n_chars) of every row: the blocks that are left, joined by two line ends.

    least, most: the importance that branches need by their prior; a branch of no main region more than `most_links` of whose
    text is links counts as noise. Null html: an empty text. A null url: the host is ''. Rows that repeat an id stay. An empty
    table gives an empty result. The table of overturned branches is broadcast up to `broadcast_rows` hosts, else joined.
    """
    rows = cut(parsed(pages, id_col, url_col, html_col, most_links))
    other = cut(overturned(branch_importance(rows), least, most, least_pages)).withColumnRenamed("branches", "other")
    few = other.count() <= broadcast_rows and not other.where(F.size("other") > 64).limit(1).count()
    joined = rows.drop("branches").join(F.broadcast(other) if few else other, "host", "left")
    told = F.coalesce("other", F.array().cast("array<string>"))
    pairs = F.arrays_zip("paths", "kinds", "texts")
    keep = F.filter(pairs, lambda b: (b["kinds"] == "m") | (b["kinds"].isin("o", "a") != F.array_contains(told, F.concat(b["kinds"], F.coalesce(b["paths"], F.lit(""))))))
    text = F.array_join(F.transform(keep, lambda b: b["texts"]), "\n\n")
    return joined.select("id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
