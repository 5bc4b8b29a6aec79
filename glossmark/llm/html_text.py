"""Main text of HTML pages: element subtrees that recur across the pages of a host are site template and are deleted."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import materialize

#: A subtree is template if it stands on so many pages of its host that have different main texts.
MIN_PAGES = 3
#: A block inside the main roots must also stand in at least this share of its host's different main texts.
MAIN_SHARE = 0.5
#: Candidates that are counted around a text, from the outside: one nested deeper goes with those around it, and not by itself.
MAX_NESTED = 512
#: Up to so many bytes in memory, tables are broadcast in joins; larger ones are shuffled. Making a broadcast, the driver holds it several times over.
BROADCAST_BYTES = 8 << 20
#: What a row of a broadcast takes besides its values, of which it holds two copies.
BROADCAST_ROW = 150

# Element names with a fixed meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER_TEXT = frozenset(
    "head script style noscript template svg canvas math iframe object embed audio video map nav header footer aside menu form button select textarea input option datalist dialog title noembed noframes search".split()
)
CLOSES_P = BLOCKS - frozenset(("body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "figcaption", "summary"))
# A start tag of the key ends an open element of the value.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl select td th body html article main section div".split())
SIBLING_SCOPES = {name: SCOPES.difference(ended) for name, ended in SIBLINGS.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that mark parts beside the article.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|complementary|consent|contentinfo|cookie|cookies|disqus|footer|header|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|notices|notification|pager|pagination|popup|promo|promoted|promotion|related|replies|reply|respond|search|share|sharing|sidebar|skip|social|sponsor|sponsored|subscribe|toolbar|widget|widgets)(?:$|[\s_-])",
    re.IGNORECASE,
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_TAG_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)


@dataclass(slots=True)
class Node:
    """An element: its name, its children (nodes and texts), and whether it stands beside the article. ``marked`` if only its class, id
    or role says so (or its name is form): that holds unless an article is inside it."""

    name: str
    aside: bool = False
    marked: bool = False
    set_aside: bool = False
    children: list = field(default_factory=list)
    key: int = 0
    n_text: int = 0
    n_link: int = 0
    main: bool = False
    roots: list | None = None

    @property
    def beside(self) -> bool:
        return self.aside or self.set_aside


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place behind the ``>`` of a tag, jumping over quoted values; a quote that is never closed (``last``) is an ordinary character."""
    while m := _TAG_STOP.search(page, at):
        quote, at = m[0], m.end()
        if quote == ">":
            return at
        if at <= last[quote]:
            at = page.index(quote, at) + 1
    return len(page)


def tokens(page: str) -> Generator[tuple[int, int, str, str | None], int | None, None]:
    """Begin, end, name and attributes of all tags (an end tag has no attributes: None; comments and the like have no name).
    Sent a place, it goes on from there.

    Every step starts where the last one ended, so the time follows the length of the page, whatever is in it.
    """
    at, n, last = 0, len(page), {q: page.rfind(q) for q in "\"'"}
    behind = lambda what, start: (i + len(what) if (i := page.find(what, start)) >= 0 else n)
    while (at := page.find("<", at)) >= 0:
        begin = at
        if page.startswith("<!--", at):
            at = behind("-->", at + 4)
        elif page.startswith("<![CDATA[", at):
            at = behind("]]>", at + 9)
        elif page.startswith(("<!", "<?"), at):
            at = behind(">", at + 2)
        elif m := _NAME.match(page, at + 1):
            at = tag_end(page, m.end(), last)
            attrs = page[m.end() : at - 1 if page[at - 1] == ">" else at]
            at = (yield begin, at, m[0].lower(), attrs) or at
            continue
        elif page.startswith("/", at + 1) and (m := _NAME.match(page, at + 2)):
            at = behind(">", m.end())
            yield begin, at, m[0].lower(), None
            continue
        else:
            at += 1  # a bare sign, which is text
            continue
        yield begin, at, "", None


def parse(page: str) -> Node:
    """A tree of the page. Missing and stray end tags are mended as browsers do in the common cases; no input fails."""
    root = Node("html")
    stack, done, n = [root], 0, len(page)
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of each name
    inline: list[Counter[str]] = [Counter()]  # open elements since each open block

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].children.append(html.unescape(page[a:b]))

    def close(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop().name
            open_at[gone].pop()
            if gone in BLOCKS:
                inline.pop()
            else:
                inline[-1][gone] -= 1

    def last_of(names: Iterable[str]) -> int:
        return max((open_at[x][-1] for x in names if open_at[x]), default=0)

    found = tokens(page)
    token = next(found, None)
    while token is not None:
        begin, end, name, attrs = token
        text(done, begin)
        done, jump = end, None
        if not name:
            pass
        elif attrs is None:
            # An inline end tag doesn't close the block that it stands in.
            if open_at[name] if name in BLOCKS else inline[-1][name]:
                close(open_at[name][-1])
        else:
            if name in CLOSES_P and open_at["p"] and open_at["p"][-1] > last_of(SCOPES):
                close(open_at["p"][-1])
            if name in SIBLINGS and (at := last_of(SIBLINGS[name])) > last_of(SIBLING_SCOPES[name]):
                close(at)
            node = Node(name, name in NEVER_TEXT and name != "form", name == "form")
            for k, *v in _ATTR.findall(attrs) if attrs else ():
                k, v = k.lower(), "".join(v)
                if k == "hidden" or k == "aria-hidden" and v.lower() == "true":
                    node.aside = True
                elif k in ("class", "id", "role") and name not in ("html", "body") and name not in HEADINGS and ASIDE_WORDS.search(v):
                    node.marked = True
            stack[-1].children.append(node)
            if name in RAW:
                close_tag = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|$)", re.IGNORECASE).search(page, end)
                node.children.append(page[end : close_tag.start() if close_tag else n])
                done = jump = close_tag.end() if close_tag else n
            elif name not in VOID and not attrs.rstrip().endswith("/"):
                open_at[name].append(len(stack))
                stack.append(node)
                if name in BLOCKS:
                    inline.append(Counter())
                else:
                    inline[-1][name] += 1
        try:
            token = found.send(jump)
        except StopIteration:
            break
    text(done, n)
    return root


def levelled(text: str) -> str:
    """Each run of white space (and NUL) as one space. By splitting, as a pattern would replace every single space."""
    if "\x00" in text:
        text = text.replace("\x00", " ")
    core = " ".join(text.split())
    if not core:
        return " " if text else ""
    return f"{' ' if text[0].isspace() else ''}{core}{' ' if text[-1].isspace() else ''}"


def walk(root: Node) -> list[tuple[Node, bool]]:
    """Every node twice: before its children (True) and after them (False). Without recursion, as pages can nest deeply.

    A list, as a page is walked several times; texts and elements don't change once it is parsed.
    """
    out, stack = [], [(root, True)]
    while stack:
        step = stack.pop()
        out.append(step)
        node, first = step
        if first:
            stack.append((node, False))
            stack += [(c, True) for c in reversed(node.children) if c.__class__ is Node]
    return out


def annotate(root: Node) -> None:
    """Hashes of all subtrees (names and texts, white space levelled, attributes ignored), text lengths, and the main root.

    The main roots are all topmost ``article`` and ``main`` elements that are not inside a part beside the article.
    """
    steps = walk(root)
    for node, first in steps:
        if first:
            continue
        h = blake2b(node.name.encode(), digest_size=8)
        for c in node.children:
            if c.__class__ is Node:
                h.update(b"\x00" + c.key.to_bytes(8, "little", signed=True))
                node.n_text += c.n_text
                node.n_link += c.n_text if c.name == "a" else c.n_link
            elif (t := levelled(c)) != " ":
                h.update(b"\x01" + t.encode("utf-8", "surrogatepass"))
                node.n_text += len(t)
        node.key = int.from_bytes(h.digest(), "little", signed=True)
    settle_marks(steps, marked_too=False)
    root.roots = set_roots(steps)
    if not root.roots and settle_marks(steps, marked_too=True):
        root.roots = set_roots(steps)


def settle_marks(steps: list[tuple[Node, bool]], marked_too: bool) -> bool:
    """Marks set an element aside unless it holds an article or main (one that isn't marked itself, or any with ``marked_too``).

    In an article the marks hold in any case: what it nests are comments and teasers. True if there is an article or main at all.
    """
    holds, depth_article, some = [], 0, False
    for node, first in steps:
        if first:
            holds.append(False)
            depth_article += node.name == "article"
            continue
        depth_article -= node.name == "article"
        inside, is_main = holds.pop(), node.name in ("article", "main")
        some |= is_main
        if node.marked and not is_main:
            node.set_aside = not inside or bool(depth_article)
        if holds and (inside or is_main and (marked_too or not node.marked)):
            holds[-1] = True
    return some


def set_roots(steps: list[tuple[Node, bool]]) -> list[Node]:
    """Marks the main roots and gives them in page order."""
    found, depth_aside, depth_main = [], 0, 0
    for node, first in steps:
        is_main = node.name in ("article", "main")
        if first:
            if is_main and not depth_aside and not depth_main and not node.beside:
                node.main = True
                found.append(node)
            depth_aside += node.beside
            depth_main += is_main
        else:
            depth_aside -= node.beside
            depth_main -= is_main
    return found


def tagged(node: Node, inside: bool) -> int:
    """The key that a candidate is counted by: odd inside the main roots, where the rule is stricter, except for lists of links."""
    strict = inside and (node.main or 2 * node.n_link <= node.n_text)
    return node.key | 1 if strict else node.key & ~1


def may_go(node: Node, n_roots: int) -> bool:
    """Whether counting may delete the element: every block with text, but not the only main root."""
    return bool(node.n_text) and node.name in BLOCKS and node.name not in ("html", "body") and not (node.main and n_roots == 1)


def outer(root: Node, n_roots: int) -> Iterator[Node]:
    """The elements that counting may delete, but for those that are nested too deeply in others."""
    nested = 0
    for node, first in walk(root):
        if may_go(node, n_roots):
            nested += 1 if first else -1
            if first and nested <= MAX_NESTED:
                yield node


def candidates(root: Node) -> dict[int, int]:
    """Tagged keys of the subtrees that template counting may delete, each with the main text that it is counted for.

    Outside the main roots, and for lists of links inside, that is the whole main part. For other blocks inside it is the longest
    text of the main part that is not in the block: articles that are copies of each other but for a few words count once, so that
    their own paragraphs stay. A block beside which there is no other text is counted for itself, once.
    """
    roots, whole = root.roots, main_key(root)
    out: dict[int, int] = {}
    strict: list[tuple[int, int, int]] = []  # key, first and last place
    own: list[tuple[int, str, int]] = []  # length, text, place
    blocks: list[tuple[int, list[str]]] = []
    inside = aside = place = nested = 0
    if not roots:
        return {tagged(n, False): whole for n in outer(root, 0)}
    stack: list[tuple[Node | str, bool]] = [(root, True)]
    begins: list[tuple[int, bool]] = []
    while stack:
        item, first = stack.pop()
        if item.__class__ is str:
            if inside and not aside and blocks:
                blocks[-1][1].append(item)
            continue
        block = item.name in BLOCKS
        if first:
            inside += item.main
            aside += item.beside
            go = block and may_go(item, len(roots))
            nested += go
            if block and inside:
                place += 1
                blocks.append((place, []))
            begins.append((place, go))
            stack.append((item, False))
            stack += [(c, True) for c in reversed(item.children)]
            continue
        begin, go = begins.pop()
        if block and inside:
            at, parts = blocks.pop()
            if t := levelled("".join(parts)).strip():
                own.append((len(t), t, at))
        nested -= go
        if go and nested < MAX_NESTED:
            key = tagged(item, bool(inside))
            if key & 1:
                strict.append((key, begin, place))
            else:
                out.setdefault(key, whole)
        aside -= item.beside
        inside -= item.main
    own.sort(key=lambda x: (-x[0], x[1]))
    hashes: dict[str, int] = {}
    for key, a, b in strict:
        other = next((t for _, t, at in own if not a <= at <= b), None)
        if other is not None and other not in hashes:
            hashes[other] = int.from_bytes(blake2b(other.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        out.setdefault(key, key if other is None else hashes[other])
    return out


def main_key(root: Node) -> int:
    """The hash of the main roots, or of the whole page if it has none: pages with the same are copies."""
    roots = root.roots
    if len(roots) < 2:
        return roots[0].key if roots else root.key
    return int.from_bytes(blake2b(b"".join(n.key.to_bytes(8, "little", signed=True) for n in roots), digest_size=8).digest(), "little", signed=True)


def pieces(root: Node) -> list[tuple[str, list[int]]]:
    """Blocks of the main roots (else of the page) without parts beside the article, in page order.

    Each comes with the tagged keys of the candidate subtrees around it: it goes if any of them is template. Neighbours with the same
    keys are joined.
    """
    roots = root.roots
    out: list[tuple[list[str], list[int]]] = []
    parts: list[str] = []
    around: list[int] = []
    nested = 0

    def end_block() -> None:
        line = levelled("".join(parts)).strip()
        parts.clear()
        if not line:
            return
        if out and out[-1][1] == around:
            out[-1][0].append(line)
        else:
            out.append(([line], list(around)))

    starts = roots or [root]
    stack: list[tuple[Node | str, bool]] = [(start, True) for start in reversed(starts)]
    while stack:
        item, first = stack.pop()
        if item.__class__ is str:
            parts.append(item)
            continue
        guarded = item is not root and may_go(item, len(roots))
        if not first:
            end_block()
            if guarded:
                nested -= 1
                if nested < MAX_NESTED:
                    around.pop()
            continue
        if item.beside and item is not root:
            if item.name in BLOCKS:
                end_block()
            continue
        if item.name == "br":
            parts.append(" ")
        if item.name in BLOCKS:
            end_block()
            if guarded:
                nested += 1
                if nested <= MAX_NESTED:
                    around.append(tagged(item, bool(roots)))
            stack.append((item, False))
        stack += [(c, True) for c in reversed(item.children)]
    end_block()
    return [("\n".join(lines), keys) for lines, keys in out]


def main_text(root: Node, template: frozenset[int]) -> str:
    """The text that is left when the template's subtrees are gone."""
    return "\n".join(t for t, keys in pieces(root) if not template.intersection(keys))


def tree_of(page: str | None) -> Node:
    root = parse(page or "")
    annotate(root)
    return root


def for_join(side: DataFrame, n_bytes: Column) -> DataFrame:
    """``side``, broadcast if the values of its rows (``n_bytes`` each) allow it, else for a shuffled join in any case: Spark itself would go
    by the size of its files, which compression and dictionaries make a small part of what its rows take in memory."""
    size = side.agg(F.sum(BROADCAST_ROW + 2 * n_bytes)).head()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("merge")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    1. Every page is parsed once, into its text pieces, the keys of the subtrees around each, and the keys of all candidate
    subtrees; this table goes to the shared folder. 2. Subtrees under ``min_pages`` or more different main texts of a host are its
    template; a block inside the main roots must stand in ``MAIN_SHARE`` of them too, as articles share openings, quotations and
    licence lines. Only subtrees that stand around some piece of the host count as such, as no other can delete anything. 3. Pages lose the
    pieces that are inside a template subtree.
    Elements that HTML or their class set beside an article (menus, headers, footers, notices, adverts, forms, scripts, comments)
    go anyway, as a host with few pages shows no recurrence.
    A null or empty page has the empty text. A null url counts as one host of its own. Repeated rows each get a row. Null ids are
    kept. An empty table gives an empty result. Only three columns are read, so no other column can clash.
    Nothing that grows with the pages goes through the driver: tables above ``BROADCAST_BYTES`` are joined by shuffling. A host with a third
    of all pages is spread by its keys, and one key of many pages by Spark's splitting of skewed joins; counts are summed on each task.
    """
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    piece = pa.struct([("text", pa.string()), ("keys", pa.list_(pa.int64()))])
    seen_in = pa.struct([("key", pa.int64()), ("main", pa.int64()), ("asked", pa.bool_())])
    want = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("row", pa.binary()), ("main", pa.int64()), ("candidates", pa.list_(seen_in)), ("pieces", pa.list_(piece))])

    def parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, main, found, around = [], [], [], []
            columns = [c.to_pylist() for c in b.columns]
            for page, url_, _, html_ in zip(*columns):
                root = tree_of(html_)
                # Rows are told apart by all they hold: equal rows have equal results.
                row.append(blake2b(repr((page, url_, html_)).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                main.append(main_key(root))
                around.append(pieces(root))
                asks, seen_for = {k for _, keys in around[-1] for k in keys}, candidates(root)
                # A key that a piece asks for, but that is too deep in the page to be counted there, has no main text.
                found.append([*((k, m, k in asks) for k, m in seen_for.items()), *((k, None, True) for k in asks.difference(seen_for))])
            keys = pa.StructArray.from_arrays([pa.array([c[i] for x in found for c in x], seen_in.field(i).type) for i in range(3)], fields=list(seen_in))
            texts = pa.StructArray.from_arrays([pa.array([p[i] for x in around for p in x], piece.field(i).type) for i in (0, 1)], fields=list(piece))
            lists = [pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, x))], pa.int32()), v) for x, v in ((found, keys), (around, texts))]
            arrays = [pa.array(x, f.type) for x, f in zip((*columns[:3], row, main), want)]
            yield pa.RecordBatch.from_arrays([*arrays, *(x.cast(f.type) for x, f in zip(lists, list(want)[5:]))], schema=want)

    schema = "page_id long, url string, host string, row binary, main long, candidates array<struct<key: long, main: long, asked: boolean>>, pieces array<struct<text: string, keys: array<long>>>"
    parsed = materialize(rows.mapInArrow(parse_rows, schema), "pages")

    in_host = F.octet_length("host")
    seen = parsed.select("host", F.explode("candidates").alias("c")).select("host", "c.*").groupBy("host", "key", "main").agg(F.max("asked").alias("asked"))
    counted = seen.groupBy("host", "key").agg(F.count("main").alias("n"), F.max("asked").alias("asked")).filter(F.col("asked") & (F.col("n") >= max(1, min_pages)))
    mains = materialize(parsed.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_main")), "mains")
    enough = (F.col("key").bitwiseAND(1) == 0) | (F.col("n") >= F.col("n_main") * MAIN_SHARE)
    template = materialize(counted.join(for_join(mains, in_host + 8), "host").filter(enough).select("host", "key"), "template")
    inside = F.array_distinct(F.flatten("pieces.keys"))
    asked = parsed.filter(F.size(inside) > 0).select("row", "host", F.explode(inside).alias("key"))
    hit = asked.join(for_join(template, in_host + 8), ["host", "key"], "left_semi")
    gone = materialize(hit.groupBy("row").agg(F.collect_set("key").alias("gone")), "gone")
    stays = lambda p: ~F.arrays_overlap(p["keys"], F.coalesce("gone", F.array().cast("array<long>")))
    # A small one is broadcast, so that no page is shuffled.
    cut = parsed.join(for_join(gone, 16 + 8 * F.size("gone")), "row", "left").select("page_id", "url", F.filter("pieces", stays).alias("pieces"))
    text = F.array_join("pieces.text", "\n")
    return cut.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
