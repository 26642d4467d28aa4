"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: elements, told apart by their path with classes, and text blocks. Tokens of
one host that occur equally often on every page share an occurrence vector; vectors are compared by
an order-independent fingerprint (xor of a hash of page and count), so no host's pages ever meet in
one task. Tokens with one vector are an equivalence class; valid are those on at least half of the
host's pages that hold an element. The class that occurs once on every page is the template's
skeleton. Text blocks in valid classes are fixed text, all others are slots, wherever they nest. Every slot
is extracted but those in asides: under tags such as nav, or under a form or an element whose class, id or
role says menu, advert, comments and so on, with no word beside it that means something else. Such a name does not
count on html, body, main and article, on paragraphs and the like inside an article, nor on an element that holds more than half of the slots' text: on the host's pages that hold it, if these are
half of the host's pages at least, else on the page itself.

A null page is the empty page and gives the empty text. A null or odd url is a host of its own name.
A host with fewer than MIN_PAGES pages, or only equal ones, has no fixed text. Repeated rows are
extracted one by one. Unclosed, crossing and cut-off markup is read as far as it goes; a tag with an odd quote ends at
its first bracket. Only page_id, url and html are read, so further columns may have any names. No pages give no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, mapped, read, stored

MIN_PAGES = 5
#: Most bytes, as JSON, of a table of hosts that is sent to every executor; a larger one is joined by a shuffle.
SENT_BYTES = 64 << 20
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)|<[a-zA-Z/][^>]*\Z", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template textarea title iframe object svg math select".split())
HIDDEN = set("script style noscript template".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("body main article section div td table center form".split())
ASIDE = RAW | set("nav footer aside button menu dialog head".split())
#: Elements whose class, id or role never makes them asides.
WHOLE = set("html body main article".split())
ASIDE_WORDS = set("ad ads advert adverts advertisement banner sidebar menu nav navbar navigation footer comment comments disqus cookie cookies notice promo share sharing social related newsletter subscribe signup breadcrumb breadcrumbs pagination popup modal sponsor sponsored complementary contentinfo search login".split())
#: Words that may stand beside those in a name: comment-list is an aside, comment-analysis is not.
ASIDE_PARTS = ASIDE_WORDS | set("area bar block body bottom box button buttons column container content form group header inner item items left link links list main module outer page panel right section site slot top unit widget wrap wrapper".split())
#: Elements of running text, which names do not make asides inside an article.
RUNNING = set("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BREAKS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def names_in(attribute: str) -> list[str]:
    """The names in a class, id or role, in lower case with hyphens between their words."""
    return ["-".join(re.findall(r"[a-z]+|[0-9]+|[^\W\d_a-z]+", n)) for n in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", attribute).lower().split()]


def says(name: str, words: set[str]) -> bool:
    """Whether a name holds one of the words, and no word that makes it mean something else."""
    parts = [p for p in name.split("-") if not p.isdigit()]
    return not words.isdisjoint(parts) and ASIDE_PARTS.issuperset(parts)


class Page:
    """elements: how often each path occurs; blocks: (path, text)."""

    def __init__(self, source: str | None) -> None:
        self.elements: Counter[str] = Counter()
        self.blocks: list[tuple[str, str]] = []
        stack: list[tuple[str, str]] = [("", "")]
        parts: list[str] = []
        source, at, raw = source or "", 0, ""

        def flush() -> None:
            text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
            parts.clear()
            if text:
                self.blocks.append((stack[-1][1], text))

        def pop(depth: int) -> None:
            if any(s[0] not in INLINE for s in stack[depth:]):
                flush()
            del stack[depth:]

        while True:
            if raw:  # nothing but its own end tag ends such an element
                end = re.compile(rf"</{raw}\b", re.I).search(source, at)
                at, raw = (end.start() if end else len(source)), ""
            found = MARKUP.search(source, at)
            if not stack[-1][0] in RAW:
                parts.append(source[at : found.start() if found else len(source)])
            if not found:
                break
            at, tag = found.end(), (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    pop(depth)
                continue
            if tag in HIDDEN:  # within a block without ending it
                self.elements[f"{stack[-1][1]}/{tag}"] += 1
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in INLINE:
                if tag in ("br", "img", "wbr"):
                    parts.append(" " if tag == "br" else "")
                elif not found[3].rstrip().endswith("/"):
                    stack.append((tag, stack[-1][1]))
                continue
            flush()
            if tag in BREAKS_P or tag in CLOSES:
                closing = CLOSES.get(tag, {"p"}) | ({"p"} if tag in BREAKS_P else set())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closing:
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            words = {w for m in NAMES.finditer(found[3]) for w in names_in(m[1] or m[2] or m[3] or "")} if found[3] else set()
            path = f"{stack[-1][1]}/{tag}" + "".join(f".{w}" for w in sorted(words))
            self.elements[path] += 1
            if tag not in VOID and not found[3].rstrip().endswith("/"):
                stack.append((tag, path))
                raw = tag if tag in RAW else ""
        flush()


@lru_cache(1 << 16)
def asides(path: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a tag makes the path an aside, and the paths of its elements that are asides by their names."""
    at, inside, named = "", False, []
    for part in path.split("/")[1:]:
        tag, *words = part.split(".")
        at = f"{at}/{part}"
        if tag in ASIDE or (tag == "header" and not inside):
            return True, ()
        by_name = any(says(w, ASIDE_WORDS) or (not inside and says(w, {"header"})) for w in words) and not (inside and tag in RUNNING)
        if tag not in WHOLE and (tag == "form" or by_name):
            named.append(at)
        inside = inside or tag in ("article", "main")
    return False, tuple(named)


def slots(page: Page, fixed: set[int]) -> tuple[list[tuple[str, str]], Counter[str]]:
    """Blocks that are neither fixed nor in an aside by tag, and how much of their text lies under each named aside."""
    blocks = [(p, t) for p, t in page.blocks if not asides(p)[0] and token(p, t) not in fixed]
    held: Counter[str] = Counter()
    for path, text in blocks:
        for name in asides(path)[1]:
            held[name] += len(text)
    return blocks, held


def token(path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}") - (1 << 63)


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return found[1].lower() if found else (url or "")


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, path, n, page, body): each page's distinct tokens. path is null for text; body, a hash of the
    page's text. The page itself is token 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, sources in in_batches(3, 2, batches):
            out: list[list] = [[] for _ in range(6)]
            for page_id, url, source in zip(ids, urls, sources):
                page, host = Page(source), token(host_of(url))
                body = xxhash.xxh64_intdigest("\n".join(t for _, t in page.blocks)) >> 1
                rows = [(0, "", 1)]
                rows += [(token(p), p, n) for p, n in page.elements.items()]
                rows += [(token(p, t), None, n) for (p, t), n in Counter(page.blocks).items()]
                for row in rows:
                    for column, value in zip(out, (host, *row, page_id, body)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "token", "path", "n", "page", "body"])

    return mapped(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "host long, token long, path string, n long, page long, body long")


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, skeleton, fixed, content, kept, left_out): skeleton, paths of the class of every page; fixed, tokens
    of fixed text blocks; content, the deepest path of the skeleton that holds all text outside of asides; kept and
    left_out, named asides of half of the pages at least that hold most of their slots' text, and that do not."""
    counted = page_tokens(pages).groupBy("host", "token").agg(
        F.first("path").alias("path"), F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "body", "n")).alias("vector"), (F.min("body") < F.max("body")).alias("differ"),
    )
    counted = stored(counted)
    totals = stored(counted.filter("token = 0").select("host", F.col("support").alias("pages"), F.col("vector").alias("every"), F.col("differ").alias("unlike")))
    tokens = counted.filter("token <> 0").join(sent(totals), "host")
    classes = tokens.groupBy("host", "vector").agg(F.count("path").alias("elements"))
    fixed = tokens.filter(F.col("path").isNull() & (2 * F.col("support") >= F.col("pages")) & (F.col("pages") >= MIN_PAGES) & F.col("unlike") & F.col("differ"))
    fixed = fixed.join(classes.filter("elements > 0"), ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_list("token").alias("fixed"))
    once = F.col("path").isNotNull() & (F.col("vector") == F.col("every"))
    skeleton = tokens.filter(once).groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("skeleton"))
    shape = stored(totals.select("host", "pages").join(skeleton, "host", "left").join(fixed, "host", "left"))

    keyed = with_host(pages).join(sent(shape.select("host", "fixed")), "host").select("host", "html", "fixed")
    sums = mapped(keyed, _held, "host long, path string, named boolean, n long, held long, total long").groupBy("host", "path", "named").agg(*[F.sum(c).alias(c) for c in ("n", "held", "total")])
    sums = stored(sums)
    whole = sums.filter("path = ''").select("host", F.col("held").alias("main"))
    near = sums.filter("path <> ''").join(sent(shape.select("host", "pages", "skeleton").join(whole, "host", "left")), "host")
    tag = F.regexp_extract("path", r"/([\w:-]+)[^/]*$", 1)
    roomy = ~F.col("named") & tag.isin(*CONTAINERS) & F.array_contains("skeleton", F.col("path")) & (F.col("held") == F.col("main"))
    content = F.max_by(F.when(roomy, F.col("path")), F.when(roomy, F.struct(F.length(F.regexp_replace("path", "[^/]", "")).alias("depth"), "path")))
    usual, most = F.col("named") & (2 * F.col("n") >= F.col("pages")), 2 * F.col("held") > F.col("total")
    judged = near.groupBy("host").agg(content.alias("content"), F.collect_list(F.when(usual & most, F.col("path"))).alias("kept"), F.collect_list(F.when(usual & ~most, F.col("path"))).alias("left_out"))
    return shape.join(judged, "host", "left")


def sent(hosts: DataFrame) -> DataFrame:
    """A stored table of hosts, to be broadcast if it is small enough with its lists."""
    size = hosts.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(hosts) if size <= SENT_BYTES else hosts


def with_host(pages: DataFrame) -> DataFrame:
    return mapped(pages.select(F.col("page_id").cast("long"), "url", "html"), _with_host, "host long, page_id long, url string, html string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of pages (page_id, url, html)."""
    found = stored(templates(pages).select("host", "fixed", "kept", "left_out"))
    keyed = with_host(pages).join(sent(found), "host", "left")
    return mapped(keyed.select("page_id", "url", "html", "fixed", "kept", "left_out"), _extract, "page_id long, url string, text string")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over pages of the text under named asides (of all slots' text) and under containers (of that in no aside)."""
    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    for hosts, sources, fixed in in_batches(3, 1, batches):
        sums: dict[tuple[int, str, bool], list[int]] = {}
        for host, source, known in zip(hosts, sources, fixed):
            page = Page(source)
            blocks, held = slots(page, set(known or ()))
            total = sum(len(t) for _, t in blocks)
            under: Counter[str] = Counter()
            for path, text in blocks:
                if not asides(path)[1]:
                    under[""] += len(text)
                    for i, c in enumerate(path + "/"):
                        if c == "/" and i:
                            under[path[:i]] += len(text)
            rows = [((host, p, False), (1, n, 0)) for p, n in under.items()]
            rows += [((host, p, True), (1, held[p], total)) for p in {m for e in page.elements for m in asides(e)[1]}]
            for key, row in rows:
                sums[key] = [x + y for x, y in zip(sums.get(key, (0, 0, 0)), row)]
        columns = list(zip(*[(*k, *v) for k, v in sums.items()])) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "named", "n", "held", "total"])


def _with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([token(host_of(u)) for u in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([hosts, *batch.columns], ["host", *batch.schema.names])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, urls, sources, fixed, kept, left_out in in_batches(6, 2, batches):
        texts = []
        for source, known, inside, outside in zip(sources, fixed, kept, left_out):
            blocks, held = slots(Page(source), set(known or ()))
            inside, outside, total = set(inside or ()), set(outside or ()), sum(len(t) for _, t in blocks)
            out = {p for p, n in held.items() if p in outside or (p not in inside and 2 * n <= total)}
            blocks = [(p, t) for p, t in blocks if out.isdisjoint(asides(p)[1])]
            texts.append("\n\n".join(t for _, t in blocks))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
