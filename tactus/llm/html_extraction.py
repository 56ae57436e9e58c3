"""Main text of web pages by template deduction.

A page is read as a row of tokens: the tags that open and close its block elements, each with the path of tags and classes around
it, and its blocks of text, with their path. Over the contents of a host (pages with equal tokens are one), every token has an
occurrence vector; tokens that come once a page and have equal vectors form an equivalence class. Of a class whose vector covers
enough contents, the tokens that keep their rank in it on all of them are valid. Classes must nest: of two that cross, the one
on fewer contents is dropped. Vectors are compared by a merged hash of their contents, so a host of any size is a partial
aggregate.

The tokens of the nested classes are the template. Its blocks of text go, and its tags and blocks cut each page into slots. A slot
whose text is mostly links, over all contents of the host, is a menu and goes as well. Where slots can't tell (text that differs
from page to page and holds few links), the elements' roles decide: menus, headers, footers, asides, forms, adverts, comments
and the like go. If an article is left, the rest of the page goes. Names take out parts of a page (divisions, sections, lists), no
single paragraph, heading, cell or item; comments, notices, adverts and the like go inside an article, too, while names that
only suggest a role ("related-work") take nothing out of it, unless half of the slot's text is links. An article or main element inside a
part that its name alone condemns is read all the same, unless that part is a thread of comments. A form that frames the page
isn't one: it holds an article or the title, or half of the text and ten words for each control.

Defined results: null or empty html gives an empty text; a null url is a host of its own; a page without blocks, an empty
string; tags are cut as browsers do (a quote counts only after an equals sign; a tag, comment or script that doesn't end takes the
rest), in time proportional to the page; unclosed and stray tags are read as browsers do for the elements here; rows that
share a page_id are pages of their own; an empty table gives an empty result; other columns are ignored. Inside a block all
white space, also what character references stand for, becomes one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, stored, table

#: A class needs this many pages, and this many hundredths of the host's.
LEAST_PAGES, LEAST_SHARE = 4, 60
#: Hundredths of a slot's text in links that make it a menu; and those that let a suggested role take it out of an article.
LINKS, SOME_LINKS = 80, 50
#: Elements by role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"nav", "footer", "aside", "button", "select", "option", "svg", "head", "menu", "dialog", "label"}
MAIN = {"article", "main"}
CONTROLS = {"button", "input", "option", "select", "textarea"}
#: Elements that hold a sentence or a heading, not a part of the page: a name alone takes none of them out.
PROSE = {"blockquote", "caption", "dd", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: A form is the page's frame, not a form, if it holds an article or the title, or this many hundredths of the text with so many words a control.
FRAME_SHARE, FRAME_WORDS = 50, 10
#: Names that say what an element is, names that say it wherever they are a part of one, inside articles, too, and names that suggest it.
SURE = {"ad", "ads", "advert", "advertisement", "comment", "comments", "comment-list", "cookie-banner", "disqus_thread", "menu", "navigation", "newsletter", "related", "replies", "respond", "share", "sidebar", "social", "sponsored", "subscribe"}
THREAD = re.compile(r"(?:^|(?<!has)(?<!no)(?<!with)[-_ ])(?:comments?|commentlist|commentary-list|replies|respond|disqus\w*)(?:$|[-_ ])", re.I)
STRONG = re.compile(r"(?:^|[-_ ])(?:adverts?|advertisements?|advertising|ads?|consent|cookies?|modal|newsletter|notices?|popup|promos?|signup|sponsor\w*|subscribe)(?:$|[-_ ])", re.I)
SUGGESTED = re.compile(r"(?:^|(?<!has)(?<!no)(?<!with)[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|login|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[-_ ])", re.I)
#: Roles of a block's surroundings: none, suggested by a name, suggested inside an article, sure, sure by a name that an article inside overrules.
PLAIN, HINT, HINT_IN_ARTICLE, BAD, NAMED_BAD = range(5)
#: Comments, other declarations, tags. No part gives back what it has taken, so the time is linear.
PIECE = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}


class Element:
    __slots__ = ("form", "linked", "main", "path", "role", "tag")

    def __init__(self, tag: str, path: int, main: bool, role: int, linked: bool, form: int = -1):
        self.tag, self.path, self.main, self.role, self.linked, self.form = tag, path, main, role, linked, form


def role_of(tag: str, names: str, above: Element) -> int:
    if above.role == BAD or tag in NEVER or (tag == "header" and not above.main):
        return BAD
    role = PLAIN if above.role == NAMED_BAD and tag in MAIN else above.role
    said = set(names.lower().split())
    if tag in ("article", "li") and said & {"comment", "comments", "reply"}:
        return BAD
    if names and tag not in PROSE and tag not in ("body", "html", "main", "form"):
        if tag != "article" and THREAD.search(names):
            return BAD
        if said & SURE or (tag != "article" and STRONG.search(names)):
            return BAD if above.main else NAMED_BAD
        if tag != "article" and SUGGESTED.search(names):
            return max(role, HINT_IN_ARTICLE if above.main else HINT)
    return role


def tokens_of(page: str) -> list[tuple[int, str | None, int, int, bool]]:
    """(token, text or null for a tag, characters of it in links, role, whether inside an article), in page order."""
    from xxhash import xxh3_64_intdigest

    hashed = lambda *x: xxh3_64_intdigest("\0".join(map(str, x))) - 2**63
    root = Element("", 0, False, PLAIN, False)
    out: list[tuple[int, str | None, int, int, bool]] = []
    forms: list[int] = []  # of each token, the form around it; and of each form, its controls and whether it frames an article or a title
    controls, frames = [], []
    stack, depth = [root], Counter()
    parts: list[str] = []
    linked: list[str] = []

    def put(text: str) -> None:
        if text:
            parts.append(html.unescape(text))
            if stack[-1].linked:
                linked.append(parts[-1])

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            e = stack[-1]
            out.append((hashed(e.path, text), text, min(len(text), len(" ".join("".join(linked).split()))), e.role, e.main))
            forms.append(e.form)
        parts.clear()
        linked.clear()

    def pop(tags: tuple[str, ...], stops: set[str]) -> None:
        if not any(depth[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if any(e.tag in BREAKS for e in stack[i:]):
                    flush()
                for e in reversed(stack[i:]):
                    depth[e.tag] -= 1
                    if e.tag in BREAKS:
                        out.append((hashed(e.path, "/"), None, 0, e.role, e.main))
                        forms.append(e.form)
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    at, size = 0, len(page)
    while at < size:
        m = PIECE.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                flush()
            pop((tag,), {"article", "main", "body", "table"} - {tag} if tag not in BREAKS or tag == "p" else set())
            continue
        if stack[-1].form >= 0:
            controls[stack[-1].form] += tag in CONTROLS
            frames[stack[-1].form] |= tag in MAIN or tag == "h1"
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            if tag in ("title", "textarea", "iframe"):
                flush()
            continue
        if tag in BREAKS:
            flush()
            pop(("p",), BREAKS - {"p"})
            if tag in CLOSES:
                pop(tuple(CLOSES[tag][0].split()), CLOSES[tag][1])
        if tag in VOID or (m[3].endswith("/") and tag not in BREAKS):
            continue
        above = stack[-1]
        if tag in BREAKS or tag in NEVER:
            names = " ".join(a or b or c for a, b, c in NAMED.findall(m[3]))
            role = role_of(tag, names, above)
            e = Element(tag, hashed(above.path, tag, names), above.main or (tag in MAIN and role < BAD), role, above.linked, above.form)
            if tag == "form" and e.form < 0:  # a form inside another is part of it
                e.form = len(controls)
                controls.append(0)
                frames.append(False)
            out.append((e.path, None, 0, e.role, e.main))
            forms.append(e.form)
        else:
            e = Element(tag, above.path, above.main, above.role, above.linked or tag == "a", above.form)
            if m[3] and tag != "a":  # a span can be an advert, too
                e.role = role_of(tag, " ".join(a or b or c for a, b, c in NAMED.findall(m[3])), above)
        stack.append(e)
        depth[tag] += 1
    flush()
    return [(*t[:3], t[3] if f < 0 or wide else BAD, t[4]) for t, f, wide in _framed(out, forms, controls, frames)] if controls else out


def _framed(tokens: list, forms: list[int], controls: list[int], frames: list[bool]) -> list[tuple]:
    """(token, its form, whether that form is the page's frame)."""
    held = [0] * len(controls)
    words = [0] * len(controls)
    whole = 0
    for (_, text, _, role, _), f in zip(tokens, forms, strict=True):
        if text is not None and role < BAD:
            whole += len(text)
            if f >= 0:
                held[f] += len(text)
                words[f] += len(text.split())
    wide = [frames[f] or (100 * held[f] >= FRAME_SHARE * whole and words[f] >= FRAME_WORDS * controls[f]) for f in range(len(controls))]
    return [(t, f, f >= 0 and wide[f]) for t, f in zip(tokens, forms, strict=True)]


def host_column(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


TOKENS = "array<struct<token:bigint,text:string,chars:int,links:int,role:tinyint,main:boolean,once:boolean>>"


def page_tokens(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, host and digest (hashes of the host and of the tokens) and its tokens, tags that repeat only once.

    The text of a block whose role is sure is left out, as nothing reads it.
    """

    def start():
        kind = pa.list_(pa.struct([("token", pa.int64()), ("text", pa.string()), ("chars", pa.int32()), ("links", pa.int32()), ("role", pa.int8()), ("main", pa.bool_()), ("once", pa.bool_())]))

        def each(batch: pa.RecordBatch) -> dict:
            found = []
            for raw in batch.column("html").to_pylist():
                page = tokens_of(raw.decode("utf-8", "replace"))
                times, row = Counter(t[0] for t in page), []
                for token, text, links, role, main in page:
                    if text is not None or times[token] == 1:
                        row.append({"token": token, "text": None if role >= BAD else text, "chars": len(text) if text is not None else None, "links": links, "role": role, "main": main, "once": times[token] == 1})
                    elif times[token] > 0:
                        row.append({"token": token, "text": None, "chars": None, "links": 0, "role": role, "main": main, "once": False})
                        times[token] = 0
                found.append(row)
            return {c: batch.column(c) for c in ("page_id", "url")} | {"tokens": pa.array(found, kind)}

        return each

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    found = in_batches(rows, f"page_id long, url string, tokens {TOKENS}", start)
    return found.select("page_id", "url", F.xxhash64(host_column()).alias("host"), F.xxhash64("tokens.token").alias("digest"), "tokens")


def grouped(tokens: DataFrame, name: str) -> DataFrame:
    """(host, classes): a row per host with its classes, each with the tokens in order of rank. Bounded by a page's tokens."""
    c = tokens.groupBy("host", "vector").agg(F.max("on").alias("on"), F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("t"))
    c = c.select("host", F.struct("on", "vector", F.col("t.token").alias("tokens")).alias("c"))
    return stored(c.groupBy("host").agg(F.collect_list("c").alias("classes")), name)


def covering(contents: DataFrame) -> DataFrame:
    """(host, token, vector, on): the tokens that come once a content and are on enough of the host's contents."""
    size = contents.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    tokens = contents.select("host", F.xxhash64("digest").alias("mark"), F.explode("tokens").alias("t")).select("host", "mark", "t.*")
    # As each content counts once, the exclusive or of their hashes stands for the set of them.
    vectors = tokens.groupBy("host", "token").agg(F.count("*").alias("on"), F.bit_xor("mark").alias("vector"), F.bool_and("once").alias("once"))
    enough = vectors.where(F.col("once") & (F.col("on") >= LEAST_PAGES)).join(size, "host")
    return enough.where(100 * F.col("on") >= LEAST_SHARE * F.col("pages")).select("host", "token", "vector", "on")


def ordered(contents: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes' tokens that have the same rank in their class on all contents, with that rank."""
    x = contents.select("host", F.col("tokens.token").alias("page")).join(classes, "host").select("host", "page", F.explode("classes").alias("c"))
    x = x.select("host", "c.vector", "c.on", F.posexplode(F.array_intersect("page", "c.tokens")).alias("rank", "token"))
    x = x.groupBy("host", "vector", "token").agg(F.max("on").alias("on"), F.min("rank").alias("rank"), F.max("rank").alias("last"))
    return x.where("rank = last").select("host", "token", "vector", "on", "rank")


def nested(contents: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, template): the tokens of the classes that nest.

    Two classes nest if on every content one of them lies between two neighbours, or outside, of the other. Of two that
    don't, the one on more contents stays.
    """
    c = classes.select("host", F.explode("classes").alias("c"))
    many = c.where("size(c.tokens) > 1")
    pairs = many.withColumnRenamed("c", "a").join(many.withColumnRenamed("c", "b"), "host").where("struct(a.on, a.vector) > struct(b.on, b.vector)")
    pairs = stored(pairs.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "html-pairs")
    x = contents.select("host", F.col("tokens.token").alias("page")).join(pairs, "host").select("host", "page", F.explode("pairs").alias("p")).select("host", "page", "p.*")
    x = x.withColumn("both", F.array_intersect("page", F.concat("a.tokens", "b.tokens")))
    # k lies in one gap of o if k's tokens are neighbours among both classes', or not on this content.
    together = lambda k: f"(array_position(both, element_at({k}.tokens, -1)) - array_position(both, {k}.tokens[0]) = greatest(size({k}.tokens) - 1, 0) or not array_contains(both, {k}.tokens[0]))"
    cross = x.where(f"not ({together('a')} or {together('b')})").select("host", F.expr("-a.on as less"), F.col("a.vector").alias("a"), F.col("b.vector").alias("b")).distinct()
    gone = cross.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("less", F.expr("-1 * cast(a as decimal(20, 0)) as down"), "a", "b"))).alias("x"))
    # From the class on most contents on: a class that is gone takes no other with it.
    gone = gone.select("host", F.expr("aggregate(x, cast(array() as array<bigint>), (g, p) -> if(array_contains(g, p.a), g, array_union(g, array(p.b))))").alias("gone"))
    stay = c.join(gone, "host", "left").where("not coalesce(array_contains(gone, c.vector), false)")
    return stored(stay.groupBy("host").agg(F.flatten(F.collect_list("c.tokens")).alias("template")), "html-templates")


def templates(parsed: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's template."""
    # Copies of a page under other urls are one content.
    contents = parsed.select("host", "digest", F.expr("transform(tokens, t -> struct(t.token, t.once))").alias("tokens"))
    contents = stored(contents.dropDuplicates(["host", "digest"]), "html-contents")
    classes = grouped(covering(contents).withColumn("rank", F.lit(0)), "html-classes")
    return nested(contents, grouped(ordered(contents, classes), "html-ordered"))


def cut(pages: DataFrame) -> DataFrame:
    """Pages joined with their host's template (null without one), with the blocks of text outside it and the slot of each: the template's token before it."""
    # Each step is bound to a name once a page: an expression inside a function of elements would be evaluated for each.
    numbered = "transform(tokens, (t, i) -> struct(i, t.token, t.chars, t.links, t.role, t.main, t.text, coalesce(array_contains(template, t.token), false) as fixed))"
    block = "struct(b.text, b.chars, b.links, b.role, b.main, coalesce(try_element_at(filter(places, x -> x.i < b.i), -1).token, 0L) as slot)"
    within = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    blocks = f"transform(filter(n, b -> b.chars is not null and not b.fixed), b -> {block})"
    places = "transform(filter(n, x -> x.fixed), x -> struct(x.i, x.token))"
    return pages.withColumn("blocks", F.expr(within(numbered, "n", within(places, "places", blocks)))).drop("tokens")


def verdicts(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """(host, template, menus, linked): with the slots that are mostly links and those that are so by half."""
    slots = cut(parsed.join(found, "host")).select("host", F.explode("blocks").alias("b")).groupBy("host", F.col("b.slot").alias("slot")).agg(F.sum("b.chars").alias("chars"), F.sum("b.links").alias("links"))
    over = lambda k: F.collect_list(F.when(100 * F.col("links") >= k * F.col("chars"), F.col("slot")))
    return stored(found.join(slots.groupBy("host").agg(over(LINKS).alias("menus"), over(SOME_LINKS).alias("linked")), "host", "left"), "html-verdicts")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    parsed = stored(page_tokens(pages), "html-tokens")
    # A row per host, which is broadcast while small: the pages' texts aren't shuffled.
    slots = cut(parsed.join(verdicts(parsed, templates(parsed)), "host", "left"))
    stays = f"b.text is not null and not coalesce(array_contains(menus, b.slot), false) and not (b.role = {HINT}) and not (b.role = {HINT_IN_ARTICLE} and coalesce(array_contains(linked, b.slot), false))"
    left = slots.select("page_id", "url", F.expr(f"filter(blocks, b -> {stays})").alias("left"))
    main = F.expr("if(exists(left, b -> b.main), filter(left, b -> b.main), left)")
    return left.select("page_id", "url", F.array_join(F.transform(main, lambda b: b["text"]), "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
