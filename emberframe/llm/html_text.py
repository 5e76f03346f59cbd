"""Main text of web pages by equivalence classes of template tokens.

Every page becomes tokens: a start tag in its context (its path of block tags and classes) or a whole text block
in its context. For each host, tokens are grouped by their occurrence vector, the number of times that they occur
on each of the host's different pages; the vector is held as an exact sum of hashes, so a host with a third of all pages
is summed up like any other (partial sums, no page list). Tokens with one vector form an equivalence class. A class
is valid if it has several tokens and nearly all pages. The start tags that occur once a page are the root class: the template's elements, nested
as their elements are. Other valid classes nest under it, in the template element that directly holds them. What a template element directly holds, apart from template text, is a slot.

A second look at the host's pages sums up each slot: characters, those of them in links, and pages. From the top of the template down, the element that
holds most of what its parent's slots hold is followed until none does: that is the main element. Its slots and those nested in it are extracted, but for slots of links.
HTML's own marks go before that: where pages have <article> or <main>, those are the main element; tags and roles for menus, footers, forms
and so on are left out, and so are elements whose class or id names a menu, an advert, comments or the like. Template
text is dropped from slots, unless that were over half of the page's text (a host of near copies). Hosts without a template have only HTML's marks, the
names and the share of links.

A block's text goes across inline elements; an inline element that is left out leaves no break.

Edge cases: null or blank html gives an empty text; a null or odd url has no host and so no template; hosts with less
than MIN_PAGES different pages have none either; repeated rows are pages of their own; a page that breaks off counts
as far as it goes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import attach, small_batches, stage, table

#: Different pages that a host needs for a template, and the share of them that a template token is on.
MIN_PAGES, SUPPORT = 5, 0.9
#: A template element is followed down while it holds this share of what its parent's slots hold; a slot with this share in links is one of links.
MOST_OF, LINKS = 0.6, 0.5
#: Contexts whose keys a worker remembers.
MOST_KEYS = 200_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Start tags of these close an open <p>.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol menu dl table tbody div article section body main select".split())
NOT_MAIN = frozenset("nav aside footer form button select dialog svg canvas audio video object menu head".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NOT_CLASS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus feedback footer gdpr login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion related reply replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar widget".split())
#: Only outside of an article: there they hold the page's head, inside the article's title.
NOT_OUTSIDE = frozenset("header topbar top site".split())


#: Words that say nothing beside one of NOT_CLASS: cookie-bar is a notice, related-work isn't.
PLAIN = frozenset("area articles bar block box button buttons container content form header inner item items left links list main message outer panel popup posts right row section slot stories text top unit wrap wrapper".split())


class Element:
    __slots__ = ("bad", "inside", "key", "tag", "up")

    def __init__(self, tag: str, key: int, bad: bool, inside: int, up: Element | None) -> None:
        self.tag, self.key, self.bad, self.inside, self.up = tag, key, bad, inside, up


ROOT = Element("", 0, False, 0, None)


def named(names: str, words: frozenset) -> bool:
    """Whether a class or an id is made of these words, with others of PLAIN only."""
    for name in names.split():
        parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if any(p in words for p in parts) and all(p in words or p in PLAIN or p in NOT_CLASS for p in parts):
            return True
    return False


def _element(tag: str, attrs: str, above: Element, keys: dict) -> Element:
    """inside: 2 in an article, 1 in main, 0 elsewhere."""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if attrs.strip(" /") else {}
    names = got.get("class", "") + " " + got.get("id", "")
    role = got.get("role", "").lower()
    inside = max(above.inside, 2 if tag == "article" or "articleBody" in got.get("itemprop", "") else 1 if tag == "main" or role == "main" else 0)
    bad = above.bad or tag in NOT_MAIN or role in NOT_ROLE or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
    if not bad and tag not in ("html", "body", "main"):
        bad = names != " " and named(names, NOT_CLASS) or not inside and (tag == "header" or names != " " and named(names, NOT_OUTSIDE))
    at = (above.key, tag, got.get("class", ""))
    key = keys.get(at)
    if key is None:
        key = keys[at] = xxh64_intdigest(repr(at).encode("utf-8", "replace"), 1)
    return Element(tag, key, bad, inside, above)


def parse(page: str, keys: dict | None = None) -> tuple[list[int], list[tuple[int, str, Element, int]]]:
    """(keys of start tags in page order, blocks: (tags before it, text, its element, characters in links))."""
    keys = {} if keys is None else keys
    tags: list[int] = []
    blocks: list[tuple[int, str, Element, int]] = []
    stack: list[Element] = [ROOT]
    text: list[str] = []
    owner, links, in_link = ROOT, 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            if t:
                blocks.append((len(tags), t, owner, links))
            text.clear()
        links = 0

    def close(tag: str, stop: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        if not m:  # an open quote without its end
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        at = m.end()
        if m[4] is not None:
            block = above = stack[-1]
            while block.tag in INLINE:
                block = block.up
            if above.bad and not block.bad:  # left out of its block
                continue
            if not text:
                owner = block
            text.append(m[4])
            if in_link:
                links += len(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag == "a":
            in_link = 0 if m[1] else 1
        if m[1]:
            close(tag, frozenset())
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
            at = end.start() if end else len(page)
            tags.append(_element(tag, "", stack[-1], keys).key)
            at = page.find(">", at) + 1 or len(page)
            continue
        if tag in CLOSES_P:
            close("p", HOLDS)
        for other in ALIKE.get(tag, ()):
            close(other, HOLDS)
        e = _element(tag, m[3], stack[-1], keys)
        if tag not in INLINE:
            tags.append(e.key)
        if tag not in VOID and not (m[3].endswith("/") and tag not in INLINE and tag == "svg"):
            stack.append(e)
    flush()
    return tags, blocks


def text_key(element: Element, text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "replace"), element.key)


def tokens(page: str, keys: dict) -> list[tuple[int, int, int]]:
    """(token, times, first place) of a page."""
    tags, blocks = parse(page, keys)
    found = Counter(tags)
    first: dict[int, int] = {}
    for k, t in enumerate(tags):
        first.setdefault(t, 2 * k)
    texts = [(text_key(e, t), 2 * k + 1) for k, t, e, _ in blocks]
    n = Counter(t for t, _ in texts)
    for t, k in texts:
        first.setdefault(t, k)
    return [(t, c, first[t]) for t, c in (found + n).items()]


class Template:
    """fixed: tokens in order; held: its elements (start tags that occur once a page); main: the element whose slots are extracted (0: not known);
    links: elements whose slots are links."""

    def __init__(self, fixed: list[int], held: list[int], main: int, links: list[int]) -> None:
        self.place = {t & (1 << 64) - 1: k for k, t in enumerate(fixed)}
        self.held, self.main, self.links = {t & (1 << 64) - 1 for t in held}, main & (1 << 64) - 1, {t & (1 << 64) - 1 for t in links}


def holders(e: Element | None, held: set[int]) -> list[int]:
    """Template elements around an element, from the nearest up."""
    out = []
    while e is not None:
        if e.key in held:
            out.append(e.key)
        e = e.up
    return out


def main_text(page: str | None, template: Template | None = None, keys: dict | None = None) -> str:
    if not page:
        return ""
    _, blocks = parse(page, keys)
    good = [b for b in blocks if not b[2].bad]
    level = max((b[2].inside for b in good), default=0)
    if level:
        good = [b for b in good if b[2].inside == level]
    elif template and template.main:
        around = [holders(b[2], template.held) for b in good]
        good = [b for b, h in zip(good, around, strict=True) if template.main in h and h[0] not in template.links]
    else:
        good = [b for b in good if 2 * b[3] <= len(b[1])]
    if template:
        fixed, last = set(), -1
        for k, b in enumerate(good):
            at = template.place.get(text_key(b[2], b[1]), -1)
            if at > last:  # in template order
                fixed.add(k)
                last = at
        slots = [b for k, b in enumerate(good) if k not in fixed]
        if 2 * sum(len(b[1]) for b in slots) >= sum(len(b[1]) for b in good):
            good = slots
    return "\n".join(b[1] for b in good)


def main_element(slots: list[tuple[int, int, int, int]]) -> tuple[int, list[int]]:
    """(the main element, elements whose slots are links). slots: (element, the template element around it or 0, characters, those in links)."""
    up = {e: u for e, u, _, _ in slots}
    links = [e for e, _, n, in_links in slots if n and in_links >= LINKS * n]
    total = dict.fromkeys(up, 0)
    for e, _, n, in_links in slots:
        at, seen = e, set()
        while at in up and at not in seen:
            seen.add(at)
            total[at] += n - in_links
            at = up[at]
    below: dict[int, list[int]] = {}
    for e, u in up.items():
        below.setdefault(u if u in up else 0, []).append(e)
    at, mass = 0, sum(n - x for _, _, n, x in slots)
    while below.get(at):
        best = max(below[at], key=lambda e: (total[e], -e))
        if total[best] < MOST_OF * max(1, mass):
            break
        at, mass = best, total[best]
    return at, links


def different(page: str = "page") -> Column:
    """A bitmap of 64 places for the different pages of a group: as many bits as pages while they are few, and two
    groups on nearly the same pages have nearly the same bits. Copies of a page share a bit."""
    return F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({page}, 64) as int))"))


def templates(pages: DataFrame) -> DataFrame:
    """pages: host, html. One row a host with a template: h (hash of the host), fixed (its tokens in order), held (start tags of the root class)."""
    rows = pages.where("host IS NOT NULL AND html IS NOT NULL").select(F.xxhash64("host").alias("h"), F.xxhash64("html").alias("page"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for host, page, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for t, times, first in tokens(h, keys):
                    for c, x in zip(cols, (host, page, t - (1 << 64) if t >> 63 else t, times, first, first % 2 == 0), strict=True):
                        c.append(x)
            if len(keys) > MOST_KEYS:
                keys.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "page", "token", "times", "place", "tag"])

    found = rows.mapInArrow(run, "h long, page long, token long, times int, place int, tag boolean")
    per = stage(found.groupBy("h", "token").agg(
        different().alias("bits"), F.count("*").alias("rows"), F.avg("place").alias("place"), F.max("times").alias("most"), F.bool_and("tag").alias("tag"),
        F.sum(F.xxhash64("page", "times").cast("decimal(20, 0)")).alias("vector")).where(f"rows >= {MIN_PAGES} * {SUPPORT}"), "page-tokens")
    # Different pages of a host, counted exactly; a host's copies share the bits of `different`, and tokens must have nearly all of them.
    hosts = rows.groupBy("h", "page").agg(F.count("*").alias("n")).groupBy("h").agg(different().alias("host_bits"), F.count("*").alias("pages"), F.sum("n").alias("host_rows")).where(f"pages >= {MIN_PAGES}")
    total = hosts.agg(F.coalesce(F.sum("host_rows"), F.lit(0))).first()[0]
    common = attach(per, hosts, ["h"], "host_rows", total).where(
        f"bit_count(bits) >= {SUPPORT} * bit_count(host_bits) AND rows >= {SUPPORT} * host_rows")
    # A class is valid with two tokens or more. Such tokens are on nearly every page, so a host has few, whatever its size.
    # Start tags that pages have once are the root class, also those that a few pages lack.
    once = F.when(F.col("tag") & (F.col("most") == 1), F.lit(0)).otherwise(F.col("vector"))
    valid = common.withColumn("vector", once.cast("decimal(38, 0)")).groupBy("h", "vector").agg(
        F.count("*").alias("tokens"), F.collect_list(F.struct("place", "token", (F.col("tag") & (F.col("most") == 1)).alias("held"))).alias("members")).where("tokens >= 2")
    return valid.select("h", F.explode("members").alias("m")).groupBy("h").agg(F.array_sort(F.collect_list("m")).alias("all")).select(
        "h", F.transform("all", lambda m: m["token"]).alias("fixed"), F.transform(F.filter("all", lambda m: m["held"]), lambda m: m["token"]).alias("held"))


def slots(pages: DataFrame) -> DataFrame:
    """pages: html, h, fixed, held. h, slots: array of (element, up, chars, in_links), for hosts with a template; what HTML's marks and names leave out isn't counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}
        signed = lambda t: t - (1 << 64) if t >> 63 else t
        for b in batches:
            sums: dict[tuple[int, int, int], list[int]] = {}
            for page, h, fixed, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = Template(fixed, held, 0, [])
                for _, text, e, in_links in parse(page, keys)[1]:
                    if not e.bad and text_key(e, text) not in t.place:
                        around = holders(e, t.held)
                        for k, at in enumerate(around):  # those above with nothing of their own too, so that the nesting is known
                            s = sums.setdefault((h, signed(at), signed(around[k + 1]) if k + 1 < len(around) else 0), [0, 0])
                            if not k:
                                s[0] += len(text)
                                s[1] += min(in_links, len(text))
            if len(keys) > MOST_KEYS:
                keys.clear()
            cols = [[k[0] for k in sums], [k[1] for k in sums], [k[2] for k in sums], [v[0] for v in sums.values()], [v[1] for v in sums.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h", "element", "up", "chars", "in_links"])

    found = pages.select("html", "h", "fixed", "held").mapInArrow(run, "h long, element long, up long, chars long, in_links long")
    # A host has as many slots as its template has elements.
    return found.groupBy("h", "element", "up").agg(F.sum("chars").alias("chars"), F.sum("in_links").alias("in_links")).groupBy("h").agg(F.collect_list(F.struct("element", "up", "chars", "in_links")).alias("slots"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row for each row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    rows = pages.select("page_id", "url", "html", F.when(host != "", host).alias("host")).withColumn("h", F.when(F.col("host").isNotNull(), F.xxhash64("host")))
    found = stage(templates(rows), "templates")
    counts = rows.groupBy("h").agg(F.count("*").alias("n")).where("h IS NOT NULL")
    known = stage(counts.join(found, "h", "left"), "host-templates")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of_template = attach(rows.where("h IS NOT NULL AND html IS NOT NULL").select("html", "h"), known.where("fixed IS NOT NULL"), ["h"], "n", total)
    planned = stage(known.join(slots(of_template), "h", "left"), "host-slots")
    joined = attach(rows.where("h IS NOT NULL"), planned, ["h"], "n", total).select("page_id", "url", "html", "fixed", "held", "slots", "h").unionByName(
        rows.where("h IS NULL").select("page_id", "url", "html", *[F.lit(None).cast(planned.schema[c].dataType).alias(c) for c in ("fixed", "held", "slots")], "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}
        made: dict[int, Template | None] = {}
        for b in batches:
            texts = []
            for k, page in enumerate(b.column(2).to_pylist()):
                h = b.column(6)[k].as_py()
                if h not in made:
                    if len(made) > 1000:
                        made.clear()
                    fixed, held, found = (b.column(c)[k].as_py() for c in (3, 4, 5))
                    made[h] = Template(fixed, held, *main_element([(s["element"], s["up"], s["chars"], s["in_links"]) for s in found or []])) if fixed else None
                texts.append(main_text(page, made[h], keys))
            if len(keys) > MOST_KEYS:
                keys.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
