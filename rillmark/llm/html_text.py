"""HTML extraction with nearest-URL page differencing.

A page is read into all its text lines, one for each block.  Pages are put in the order of
host and path, each is paired with the neighbour of its host whose path is nearest (the
longer common beginning), the lines of both are aligned by longest common subsequence, and
shared lines outside article and main elements are deleted: menus, footers and notices.  A
line of the article stays, whoever shares it: articles quote each other, and short sentences
recur.  Of what is left, lines go whose markup says that they are not the article (a menu that differs from page to page, comments, an advert), by element, role,
class and id.  A line that markup rules out aligns only with such lines, so a heading stays
where the next page's sidebar names it.  A class or id rules out if all its parts say so
(``sidebar``, ``cookie-notice``, ``ad-slot-1``; not ``has-sidebar``), and never html, body,
main, an article that is not within another, nor an element around the page's main or all
its articles.

Equal pages of a host are one page in that order, so a page is never paired with its own
copy.  A page without article or main that shares all its lines with a neighbour is its copy
likewise, which tells nothing: the other neighbour is asked, or its lines stay.

Scale: the html moves once.  Pages are dealt to blocks of the order, with bounds from a
sample of about SAMPLE keys, so a host with a third of all pages is many blocks; the
pages at a block's ends go to both blocks.  A block is read in order and three pages are
held.  Pages with an equal one before them are found by hash and take its text by a join;
their keys are broadcast only where counted to be at most FEW_COPIES.

Defined cases: null html is the empty page, without text; null url (or none with ``://``)
has the empty host and path; equal urls by page_id, null first; repeated rows
get the same text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .url_rules import host_and_path

#: Pages in a block, blocks, and keys sampled for their bounds, at most.
BLOCK_ROWS, MOST_BLOCKS, SAMPLE = 1_000, 1 << 14, 1 << 16
#: Classes of equal pages that may be broadcast.
FEW_COPIES = 100_000

#: Fixed word lists: elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title noscript iframe svg math select object audio video canvas".split())
OUT = frozenset("nav footer aside form menu dialog button head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: What class and id do not rule out, and words of them and of role that mark what is not
#: the article.
WHOLE = frozenset(("html", "body", "main", "article"))
OUT_WORDS = frozenset(
    (
        "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer "
        "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup comment comments reply replies respond disqus "
        "related recommended recommendations share sharing social login search form widget toolbar pagination pager copyright hidden contentinfo complementary dialog"
    ).split()
)
#: Parts of a compound that only say where or what kind of box it is.
PLAIN_WORDS = frozenset("area bar block bottom box button buttons container holder icons inner item items link links list main outer placeholder post posts section site slot top unit widget wrap wrapper".split())
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_MARKS = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: A start tag that ends an open element of these, up to the one that holds both.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table"))}


def _says_out(token: str) -> bool:
    parts = [p.lower() for p in _PARTS.findall(token)]
    return any(p in OUT_WORDS for p in parts) and all(p in OUT_WORDS or p in PLAIN_WORDS or p.isdigit() for p in parts)


def _is_out(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is ruled out, and whether only by class, id or role."""
    if name in OUT:
        return True, False
    by_words = False
    for mark, value in _MARKS.findall(attributes) if attributes else ():
        mark, value = mark.lower(), value.strip("\"'")
        if mark in ("class", "id", "role"):
            by_words = by_words or any(_says_out(t) for t in value.split())
        elif mark == "hidden" or (mark == "aria-hidden" and value.lower() == "true") or (mark == "style" and "display:none" in value.replace(" ", "").lower()):
            return True, False
    return by_words, by_words


Line = tuple[str, bool, bool]


def all_lines_of(page: str) -> list[Line]:
    """The lines of a page, whether each lies in an article or main element, and whether
    its markup rules it out."""
    lines, around_main, around_article, shown = _read(page, frozenset())
    spared = around_main if shown else around_main | around_article
    return _read(page, spared)[0] if spared else lines


def lines_of(page: str) -> list[tuple[str, bool]]:
    """The lines that markup does not rule out, and whether each lies in an article or main."""
    return [(t, own) for t, own, out in all_lines_of(page) if not out]


def _read(page: str, spared: frozenset[int]) -> tuple[list[Line], frozenset[int], frozenset[int], bool]:
    """The lines, where the elements begin that are ruled out by words and hold a main or an
    article, and whether a main or article is left outside of all that is ruled out.  The
    elements that begin at ``spared`` are not ruled out by words."""
    lines: list[Line] = []
    held: tuple[list[str], list[str]] = ([], [])  # of the block: what is shown, what is ruled out
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, ruled out, in main, in the main's header, where ruled out by words or -1
    around: dict[str, set[int]] = {"main": set(), "article": set()}
    shown = False
    at = 0

    def end_block() -> None:
        for words in held:
            if words:
                text = " ".join(html.unescape("".join(words)).split())
                words.clear()
                if text:
                    lines.append((text, bool(stack) and stack[-1][2], words is held[1]))

    def hidden() -> bool:
        return bool(stack) and stack[-1][1]

    def pop_to(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            break
        if m.start() > at:
            held[hidden()].append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                end_block()
            pop_to(name)
            continue
        if name in RAW:
            close = _CLOSE[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        block = name in BLOCK
        if block:
            end_block()
            if stack and stack[-1][0] == "p":
                stack.pop()
        if name in _ENDS:
            open_one, within = _ENDS[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in (name, open_one):
                    del stack[i:]
                    break
        if name == "br":
            held[hidden()].append(" ")
        if name in VOID or m[3].endswith("/"):
            continue
        out, by_words = _is_out(name, m[3])
        if by_words and (m.start() in spared or (name in WHOLE and not (name == "article" and any(x[0] == name for x in stack)))):
            out = by_words = False
        if block or out:
            _, was_out, in_main, in_header, _ = stack[-1] if stack else ("", False, False, False, -1)
            if name in MAIN:
                around[name].update(x[4] for x in stack if x[4] >= 0)
                shown = shown or not (was_out or out)
            if name == "header":  # a page's header goes; of an article's, the headings stay
                in_header, out = in_main, out or not in_main
            if in_header:
                out = name not in HEADING
                was_out = was_out and name not in HEADING
            stack.append((name, was_out or out, in_main or name in MAIN, in_header, m.start() if by_words else -1))
    if at < len(page):
        held[hidden()].append(page[at:])
    end_block()
    return lines, frozenset(around["main"]), frozenset(around["article"]), shown


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    where: dict[object, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out: set[int] = set()
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _near(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def difference(lines: list[Line], neighbours: list[list[Line]]) -> list[str]:
    """The page's lines without what it shares, outside its article, with the first neighbour
    that is not its copy, and without what markup rules out."""
    texts, keys = [t for t, _, _ in lines], [(t, out) for t, _, out in lines]
    left = [i for i, (_, _, out) in enumerate(lines) if not out]
    article = {i for i in left if lines[i][1]}
    for other in neighbours:
        gone = common(keys, [(t, out) for t, _, out in other]) - article
        if article or not gone.issuperset(left):
            return [texts[i] for i in left if i not in gone]
    return [texts[i] for i in left]


_SEP = "\u0000"


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), host, path, the key of the order, and two hashes
    of the html."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    key = F.concat_ws(_SEP, "host", "path", F.coalesce("url", F.lit("")), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, " "))
    return rows.withColumns({"key": key, "h1": F.xxhash64("html"), "h2": F.hash("html")})


def in_order(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed pages, whose keys are ``keys`` too, with block and guest, sorted by block and
    key within each partition; guests are the pages before and after a block."""
    spark = rows.sparkSession
    rows = rows.select("page_id", "url", "html", "host", "path", "first", "key")
    key = F.col("key")
    n = keys.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    bounds: list[str] = []
    if blocks > 1:
        # the keys whose hashes lie in a range: the same in every run
        share = min(1.0, min(SAMPLE, 32 * blocks) / n)
        part = keys.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct()
        sample = sorted(r.key for r in part.collect())
        bounds = sorted({sample[i * len(sample) // blocks] for i in range(1, blocks)}) if sample else []
    marks = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    if len(bounds) > 64:
        marks = F.split(F.lit("\u0001".join(bounds)), "\u0001")
    block = shared.block_of(F.col("key"), marks, len(bounds))
    ends = sorted((r.block, r.a, r.b) for r in keys.groupBy(block.alias("block")).agg(F.min("key").alias("a"), F.max("key").alias("b")).collect())
    guests = [(ends[i + 1][1], ends[i][0]) for i in range(len(ends) - 1)] + [(ends[i - 1][2], ends[i][0]) for i in range(1, len(ends))]
    own = rows.withColumns({"block": block, "guest": F.lit(False)})
    if guests:
        visits = spark.createDataFrame(guests, "at string, to int")
        own = own.unionByName(rows.join(F.broadcast(visits), F.col("key") == F.col("at")).withColumns({"block": F.col("to"), "guest": F.lit(True)}).drop("at", "to"))
    return own.repartition(max(1, len(ends)), "block").sortWithinPartitions("block", "key").drop("key")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = now = None  # page_id, url, lines, host, path, first, block, guest
    times = 1

    def row(after):
        if now is None or now[7]:
            return []
        near = [x for x in (before, after) if x is not None and x[3] == now[3] and x[6] == now[6]]
        near.sort(key=lambda x: -_near(x[4], now[4]))
        text = "\n".join(difference(now[2], [x[2] for x in near]))
        return [(now[0], now[1], text, len(text), now[5])] * (times if now[5] is None else 1)

    def packed(rows: list) -> pa.RecordBatch:
        page_id, url, text, n, first = zip(*rows, strict=True)
        return pa.record_batch([pa.array(page_id, kind), pa.array(url, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.string())], names=["page_id", "url", "text", "n_chars", "first"])

    for batch in batches:
        kind = batch.schema.field(0).type
        out = []
        for page in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
            page = (*page[:2], all_lines_of(page[2]), *page[3:])
            if page == now:  # a repeated row
                times += 1
                continue
            out += row(page)
            before, now, times = now, page, 1
        if out:
            yield packed(out)
    if done := row(None):
        yield packed(done)


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= FEW_COPIES else table


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    rows = keyed(pages)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, first string"
    ids = shared.table(rows.select("key", "page_id", "url", "host", "h1", "h2"), "html-keys")
    same = ["host", "h1", "h2"]
    classes = ids.groupBy(same).agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first != last").drop("last")
    classes = shared.table(classes, "html-classes")
    if classes.isEmpty():
        return shared.map_arrow(in_order(rows.withColumn("first", F.lit(None).cast("string")), ids.select("key")), _extract, schema).drop("first")
    members = shared.table(ids.join(_few(classes), same).select("first", "key", "h1", "h2", F.col("page_id").alias("of_page"), F.col("url").alias("of_url")), "html-members")
    marks = ["key", "h1", "h2"]
    copies = shared.table(members.filter("key != first").select(marks).distinct(), "html-copies")
    firsts = classes.select("first", F.col("first").alias("key"), "h1", "h2")
    apart = rows.join(_few(copies), marks, "left_anti").join(_few(firsts), marks, "left")
    texts = shared.map_arrow(in_order(apart, ids.join(_few(copies), marks, "left_anti").select("key")), _extract, schema)
    # a class's text goes to all its pages
    copy = F.col("first").isNotNull()
    return texts.join(_few(members.select("first", "of_page", "of_url")), "first", "left").select(
        F.when(copy, F.col("of_page")).otherwise(F.col("page_id")).alias("page_id"), F.when(copy, F.col("of_url")).otherwise(F.col("url")).alias("url"), "text", "n_chars"
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.read(spark, sf_dir, "pages"))
