"""Paper pages as ordered event tables: sections, tables, references, links.

A page is cut into tag and text events with one regular expression and exploded; all
state (open elements, current heading, current cell) comes from windows over one page's
events.  A page is one input row, so a page's window is bounded by that row.  Events are
shuffled once, by page; every later window and aggregate reuses that placement.
"""

from __future__ import annotations

import html.entities
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkfolio.functions import headings as hd, ids
from sparkfolio.functions.tex import tex_to_text
from sparkfolio.functions.text import clean_block, clean_inline, literal_map, squeeze, strip
from sparkfolio.scale import cut_lineage

# Limits of the extraction.
MAX_TABLES, MAX_ROWS, MAX_COLS, MAX_CELL = 40, 80, 24, 160
MAX_CAPTION, MAX_RENDER, MAX_MATH = 600, 1500, 400
MAX_REFERENCES, MAX_REFERENCE_CHARS = 500, 700
MAX_LINKS, MAX_CONTEXT, CONTEXT_SIDE = 50, 200, 90
SECTION_CAPS = {"abstract": 3000, "methodology": 8000, "setup": 6000, "experiments": 12000, "limitations": 3000}
MAX_HARDWARE, MAX_HARDWARE_CHARS, MAX_HARDWARE_TOTAL = 8, 400, 2000
HARDWARE_PREFIX = "Hardware and compute mentions found elsewhere in the paper:"
# Tag and class vocabularies of the page format.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
SKIP_TAGS = ("script", "style", "noscript", "svg", "head", "header", "footer", "nav", "button", "select", "option",
             "textarea", "form", "dialog", "template")
SKIP_CLASSES = ("ltx_page_footer", "ltx_page_logo", "ltx_note_mark", "ltx_note_type", "ltx_tag_equation", "ltx_ERROR",
                "ltx_phantom", "ltx_pagination")
BREAK_TAGS = ("p", "div", "li", "ul", "ol", "section", "article", "tr", "figcaption", "figure", "table", "blockquote",
              "pre", "dd", "dt", "dl", "caption", "h1", "h2", "h3", "h4", "h5", "h6")
LEVELS = {"part": 1, "chapter": 1, "section": 1, "appendix": 1, "bibliography": 1, "subsection": 2, "subsubsection": 3,
          "paragraph": 4, "subparagraph": 5}
IGNORED_HEADINGS = ("abstract", "keywords", "classification", "acknowledgements")
PAPER_MARKUP = r"""class\s*=\s*["'][^"']*\bltx_(?:document|title_document|title_section|abstract|para|bibitem)\b"""
LABEL = r"(?i)\b(table|figure|tab\.|fig\.)\s*([A-Z]?\d+(?:\.\d+)?)"


def looks_like_paper(page: Column) -> Column:
    return F.coalesce(page, F.lit("")).rlike(PAPER_MARKUP)


def unescape(c: Column) -> Column:
    """Resolve numeric and the classic named character references."""
    known = html.entities.name2codepoint
    names = literal_map({name: chr(code) for name, code in known.items()})
    parts = F.regexp_extract_all(c, F.lit(r"&#?[A-Za-z0-9]+;|[^&]+|&"), F.lit(0))
    code = lambda p: F.coalesce(
        F.conv(F.nullif(F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1), F.lit("")), 16, 10).try_cast("int"),
        F.nullif(F.regexp_extract(p, r"^&#(\d{1,7});$", 1), F.lit("")).try_cast("int"))
    symbol = lambda p: F.when(code(p).between(1, 0x10FFFF) & ~code(p).between(0xD800, 0xDFFF), F.decode(
        F.unhex(F.lpad(F.hex(code(p)), 8, "0")), "UTF-32"))
    one = lambda p: F.when(~p.startswith("&"), p).otherwise(
        F.coalesce(F.try_element_at(names, F.regexp_extract(p, r"^&([A-Za-z0-9]+);$", 1)), symbol(p), p))
    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def _attr(raw: Column, name: str) -> Column:
    value = F.regexp_extract(raw, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("end", T.IntegerType()), T.StructField("rank", T.IntegerType())])))
def element_ends(pages: pa.Array) -> pa.Array:
    """Where each element of a page ends: the index of the end tag, and how many elements that tag has closed before it.

    A page is a list with ``+name`` for a start tag, ``-name`` for an end tag and an empty string for anything else.  An
    end tag closes the last open element of its name and all that were opened inside; without one it closes nothing.
    Elements that are still open at the end of the page have no end.
    """
    ends, ranks, sizes = [], [], []
    for marks in pages.to_pylist():
        end, rank = [None] * len(marks), [None] * len(marks)
        stack: list[int] = []
        still_open: dict[str, int] = {}
        for at, mark in enumerate(marks):
            name = mark[1:]
            if mark.startswith("+"):
                stack.append(at)
                still_open[name] = still_open.get(name, 0) + 1
            elif mark and still_open.get(name):
                closed, inner = 0, None
                while inner != name:
                    last = stack.pop()
                    inner = marks[last][1:]
                    still_open[inner] -= 1
                    end[last], rank[last] = at, closed
                    closed += 1
        ends += end
        ranks += rank
        sizes.append(len(marks))
    bounds = pa.array([0, *accumulate(sizes)], pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(ends, pa.int32()), pa.array(ranks, pa.int32())], ["end", "rank"]))


def raw_events(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, raw, text, end_pos): start tags, void tags and texts in page order.

    ``end_pos`` is where the element of a start tag ends.  Positions leave room for the ends of all
    elements that one end tag closes, inner ones first.
    """
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    pattern = r"""(?s)<!--.*?(?:-->|\z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*>|[^<]+|<"""
    name = lambda raw: F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][a-zA-Z0-9:_-]*)", 1))
    is_void = lambda raw: name(raw).isin(*VOID) | raw.endswith("/>")
    mark = lambda raw: (F.when(~raw.rlike(r"^</?[a-zA-Z]"), F.lit("")).when(raw.startswith("</"), F.concat(F.lit("-"), name(raw)))
                        .when(is_void(raw), F.lit("")).otherwise(F.concat(F.lit("+"), name(raw))))
    cut = pages.select("page_id", F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("parts"))
    cut = cut.withColumn("ends", element_ends(F.transform("parts", mark))).withColumn("width", F.size("parts").cast("long") + 1)
    ev = cut.select("page_id", "width", F.posexplode(F.arrays_zip("parts", "ends")).alias("at", "part")).select(
        "page_id", (F.col("at") * F.col("width")).alias("pos"), F.col("part.parts").alias("raw"),
        (F.col("part.ends.end") * F.col("width") + F.col("part.ends.rank")).alias("end_pos")).repartition("page_id")
    is_tag = F.col("raw").rlike(r"^<[a-zA-Z]")
    ev = ev.filter(~F.col("raw").rlike(r"^<[!?]|^</[a-zA-Z]")).select(
        "page_id", "pos", "end_pos", "raw", is_tag.alias("is_tag"), name(F.col("raw")).alias("tag"), F.when(~is_tag, unescape(F.col("raw"))).alias("data"))
    kind = F.when(~F.col("is_tag"), "text").when(is_void(F.col("raw")), "void").otherwise("open")
    ev = ev.select("page_id", "pos", "end_pos", kind.alias("kind"), "tag", "raw", "data", squeeze(F.col("data")).alias("core"))
    edge = lambda pattern: F.when(F.col("data").rlike(pattern), " ").otherwise("")
    text = F.when(F.col("core") == "", " ").otherwise(F.concat(edge(r"^\s"), F.col("core"), edge(r"\s$")))
    return ev.select("page_id", "pos", "kind", "tag", "raw", F.coalesce(text, F.lit("")).alias("text"), "end_pos")


def _element_kind(tag: Column, cls: Column, raw: Column) -> Column:
    """Role of an opened element, by the first rule that matches."""
    has = lambda *names: F.arrays_overlap(cls, F.array(*[F.lit(n) for n in names]))
    title_type = F.regexp_extract(F.array_join(cls, " "), r"(?:^| )ltx_title_(\S+)", 1)
    is_title = has("ltx_title")
    return (
        F.when(tag.isin(*SKIP_TAGS) | has(*SKIP_CLASSES)
               | F.exists(cls, lambda c: c.startswith("ar5iv-") | c.contains("modal")), "skip")
        .when(has("ltx_abstract"), "abstract")
        .when(is_title & (title_type == "document"), "doctitle")
        .when(is_title & title_type.isin(*IGNORED_HEADINGS), "skip")
        .when(is_title & title_type.isin(*LEVELS), "heading")
        .when((tag == "math") & raw.rlike(r"""(?i)\salttext\s*=\s*["']?\s*[^\s"']"""), "math")
        .when((tag == "figcaption") | has("ltx_caption"), "caption")
        .when(has("ltx_tag_bibitem", "ltx_role_refnum"), "biblabel").when(has("ltx_tag"), "captag")
        .when(tag.isin("figure", "div", "span", "section") & has("ltx_table", "ltx_figure"), "container")
        .when((tag == "table") & has("ltx_tabular"), "tabular")
        .when(tag == "tr", "row").when(tag.isin("td", "th"), "cell")
        .when(has("ltx_bibitem"), "bibitem").when(has("ltx_bibblock"), "bibblock")
        .when(has("ltx_note"), "note").when(tag == "a", "anchor").when(tag == "p", "para").otherwise("plain")
    )


def page_events(pages: DataFrame) -> DataFrame:
    """Visible events with the role of each element and what it closes.

    An element gives an open event and, where its own end tag or that of an element around it
    closes it, a close event with the same role and the opening event as ``opener``.  Skipped
    blocks are gone, a math element is one text event.
    """
    ev = raw_events(pages)
    cls = F.when(F.col("kind") == "open", F.filter(F.split(_attr(F.col("raw"), "class"), r"\s+"), lambda c: c != ""))
    ev = ev.withColumn("cls", cls).withColumn("role", F.when(F.col("kind") == "open", _element_kind(F.col("tag"), F.col("cls"), F.col("raw"))))
    opener = F.struct(F.col("pos").alias("pos"), F.col("role").alias("role"), F.col("raw").alias("raw"))
    own = F.struct("pos", "kind", "text", "cls", F.lit(None).cast("struct<pos:bigint,role:string,raw:string>").alias("opener"))
    end = F.struct(F.col("end_pos").alias("pos"), F.lit("close").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("array<string>").alias("cls"), opener.alias("opener"))
    both = F.when(F.col("end_pos").isNotNull(), F.array(own, end)).otherwise(F.array(own))
    ev = ev.select("page_id", "tag", "role", "raw", F.inline(both))
    hidden = F.col("role").isin("skip", "math")
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(hidden & (F.col("kind") == "open"), 1).when(hidden & (F.col("kind") == "close"), -1).otherwise(0)
    ev = ev.withColumn("_skip", F.sum(delta).over(page))
    math_text = F.substring(tex_to_text(unescape(_attr(F.col("raw"), "alttext"))), 1, MAX_MATH)
    math_text = F.when(F.lower(_attr(F.col("raw"), "display")) == "block", F.concat(F.lit(" "), math_text, F.lit(" "))).otherwise(math_text)
    is_math = (F.col("role") == "math") & (F.col("kind") == "open") & (F.col("_skip") == 1)
    ev = ev.filter(((F.col("_skip") == 0) & ~F.coalesce(hidden, F.lit(False))) | is_math)
    return ev.select(
        "page_id", "pos", F.when(is_math, "text").otherwise(F.col("kind")).alias("kind"), "tag", "role", "raw", "cls", "opener",
        F.when(is_math, math_text).when((F.col("kind") == "void") & (F.col("tag") == "br"), " ").otherwise(F.col("text")).alias("text"))


#: Columns of ``routed_events`` that count open elements of a role.
DEPTHS = {"abs": "abstract", "head": "heading", "cap": "caption", "cont": "container", "tab": "tabular", "bib": "bibitem", "block": "bibblock",
          "lab": "biblabel", "doc": "doctitle"}


def routed_events(pages: DataFrame) -> DataFrame:
    """Visible events with their place: open heading, caption, container, cell, bibliography item.

    ``route`` is where a text goes: heading, caption, bibliography, table cell, document
    title or section.
    """
    ev = page_events(pages)
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = lambda *roles: (F.col("kind") == "open") & F.col("role").isin(*roles)
    closes = lambda *roles: (F.col("kind") == "close") & F.col("role").isin(*roles)

    def depth(*roles):
        return F.sum(F.when(opens(*roles), 1).when(closes(*roles), -1).otherwise(0)).over(page)

    def last_open(cond):
        return F.last(F.when(cond, F.col("pos")), ignorenulls=True).over(page)

    # windows of one order that do not need each other are added together: one sort, one operator
    ev = ev.withColumns({f"d_{name}": depth(role) for name, role in DEPTHS.items()} | {"_head": last_open(opens("heading")), "_bib": last_open(opens("bibitem")),
        "_block": F.last(F.when(opens("bibblock"), F.col("pos")).when(closes("bibblock"), -F.col("pos")).when(opens("bibitem"), F.lit(0)), ignorenulls=True).over(page),
        "front": F.sum(F.when(opens("heading") & F.col("raw").rlike("ltx_title_(?:" + "|".join(k for k, v in LEVELS.items() if v == 1) + r")\b"), 1).otherwise(0)).over(page) == 0})
    row_open, row_close = opens("row") & (F.col("d_tab") == 1), closes("row") & (F.col("d_tab") == 1)
    cell_open, cell_close = opens("cell") & (F.col("d_tab") == 1), closes("cell") & (F.col("d_tab") == 1)
    mark = lambda o, c: F.last(F.when(o, F.col("pos")).when(c, F.lit(-1)), ignorenulls=True).over(page)
    by_depth = Window.partitionBy("page_id", "d_cont").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda depth_col, value: F.when(F.col(depth_col) > 0, value)
    ev = ev.withColumns({
        "d_tag": F.sum(F.when(opens("captag") & (F.col("d_cap") > 0), 1).when(closes("captag") & (F.col("d_cap") > 0), -1).otherwise(0)).over(page),
        "head_id": inside("d_head", F.col("_head")), "bib_id": inside("d_bib", F.col("_bib")), "block_id": inside("d_bib", F.col("_block")),
        "tab_id": inside("d_tab", last_open(opens("tabular") & (F.col("d_tab") == 1))), "row_id": inside("d_tab", mark(row_open, row_close)),
        "cell_id": inside("d_tab", mark(cell_open, cell_close | row_close)),
        "cont_id": inside("d_cont", F.last(F.when(opens("container"), F.col("pos")), ignorenulls=True).over(by_depth))}).drop("_head", "_bib", "_block")
    is_text = F.col("text") != ""
    route = (F.when(~is_text, None).when(F.col("d_head") > 0, "heading").when(F.col("d_cap") > 0, "caption")
             .when(F.col("d_bib") > 0, "bibliography").when(F.col("d_tab") > 0, "cell").when(F.col("d_doc") > 0, "doctitle")
             .otherwise("section"))
    # Headings, tables, references and links all start here: the events are stored once, as their plan repeated in
    # every branch of a query takes longer to optimise than to run.
    return cut_lineage(ev.withColumn("route", route))


def _joined(value: Column, order: Column) -> Column:
    """Text pieces of a group in page order (a group lies inside one page)."""
    pieces = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(pieces, lambda p: p["v"]), "")


def headings(ev: DataFrame) -> DataFrame:
    """(page_id, open_pos, pos, level, type, title, top_kind, sub_kind): every heading, in force from ``pos`` on."""
    kinds = F.regexp_extract("opener.raw", r"ltx_title_(" + "|".join(LEVELS) + r")\b", 1)
    level_map = literal_map(LEVELS)
    closed = ev.filter((F.col("kind") == "close") & (F.col("role") == "heading")).select(
        "page_id", F.col("opener.pos").alias("open_pos"), "pos", kinds.alias("type"))
    text = ev.filter(F.col("route") == "heading").groupBy("page_id", F.col("head_id").alias("open_pos")).agg(
        clean_inline(_joined(F.col("text"), F.col("pos"))).alias("title"))
    rows = closed.join(text, ["page_id", "open_pos"]).filter(F.col("title") != "").withColumn(
        "level", F.try_element_at(level_map, F.col("type")).cast("int"))
    appendix = (F.col("type") == "appendix") | F.col("title").rlike(r"(?i)^appendix\b")
    rows = rows.withColumn("raw_kind", F.when(F.col("level") == 1, F.when(F.col("type") == "bibliography", "references").otherwise(
        hd.heading_class(F.col("title"), appendix))))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("raw_kind").isin("experiments", "setup")).over(before), F.lit(False))
    rows = rows.withColumn("own_kind", F.when(F.col("raw_kind") == hd.UNNAMED, F.when(seen, "experiments").otherwise("methodology")).when(
        F.col("raw_kind") != "none", F.col("raw_kind")))
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("top_pos", F.last(F.when(F.col("level") == 1, F.col("pos")), ignorenulls=True).over(upto))
    rows = rows.withColumn("top_kind", F.max(F.when(F.col("pos") == F.col("top_pos"), F.col("own_kind"))).over(
        Window.partitionBy("page_id", "top_pos")))
    # Overrides of deeper headings: one ordered fold over the headings of a page.
    override = F.when(F.col("level") > 1, hd.classify_sub(F.col("title")))
    item = F.struct("pos", "open_pos", "level", "type", "title", "top_kind", override.alias("override"))
    per_page = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("hs"))
    start = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("level"),
                     F.array().cast("array<string>").alias("out"))

    def fold(acc: Column, h: Column) -> Column:
        keep = acc["kind"].isNotNull() & (h["level"] > acc["level"]) & (h["level"] > 1)
        kind = F.when(keep, acc["kind"]).otherwise(h["override"])
        return F.struct(kind.alias("kind"), F.when(keep, acc["level"]).otherwise(h["level"]).alias("level"),
                        F.concat(acc["out"], F.array(F.coalesce(kind, F.lit("")))).alias("out"))

    folded = per_page.select("page_id", "hs", F.aggregate("hs", start, fold)["out"].alias("subs"))
    flat = folded.select("page_id", F.explode(F.arrays_zip("hs", "subs")).alias("z"))
    return flat.select("page_id", "z.hs.open_pos", "z.hs.pos", "z.hs.level", "z.hs.type", "z.hs.title", "z.hs.top_kind",
                       F.nullif(F.col("z.subs"), F.lit("")).alias("sub_kind"))


def scoped_events(ev: DataFrame, heads: DataFrame) -> DataFrame:
    """Events with the section they belong to (``target``) and the nearest heading title."""
    marks = heads.select("page_id", "pos", F.struct("top_kind", "sub_kind", "title").alias("mark"))
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.join(marks, ["page_id", "pos"], "left").withColumn("scope", F.last("mark", ignorenulls=True).over(page))
    target = (F.when(F.col("d_abs") > 0, "abstract")
              .when((F.col("d_bib") > 0) | (F.col("scope.top_kind") == "references"), None)
              .otherwise(F.coalesce(F.col("scope.sub_kind"), F.col("scope.top_kind"))))
    return cut_lineage(ev.withColumn("target", target))


_GRID = T.ArrayType(T.ArrayType(T.StringType()))


@F.arrow_udf(_GRID)
def expand_spans(tables: pa.Array) -> pa.Array:
    """Rows of (text, colspan, rowspan) cells to plain rows: spans repeat the cell text."""
    def grid(rows):
        out, carry = [], {}           # carry: column -> [rows left, text]
        for cells in rows:
            line = []

            def take_carried():
                while len(line) in carry:
                    column = len(line)
                    line.append(carry[column][1])
                    carry[column][0] -= 1
                    if not carry[column][0]:
                        del carry[column]

            for cell in cells:
                take_carried()
                first = len(line)
                line.extend([cell["text"]] * cell["colspan"])
                if cell["rowspan"] > 1:
                    carry.update({first + i: [cell["rowspan"] - 1, cell["text"]] for i in range(cell["colspan"])})
            while carry and max(carry) >= len(line):
                if len(line) in carry:
                    take_carried()
                else:
                    line.append("")
            out.append(line)
        return out
    return pa.array([grid(rows) for rows in tables.to_pylist()], pa.list_(pa.list_(pa.string())))


def _span(raw: Column, name: str, most: int) -> Column:
    n = F.coalesce(strip(_attr(raw, name)).try_cast("int"), F.lit(1))
    return F.greatest(F.lit(1), F.least(n, F.lit(most)))


def tables(ev: DataFrame, scoped: DataFrame) -> DataFrame:
    """(page_id, tab_id, close_pos, table_index, label, caption, rows, section, target)."""
    cells = ev.filter((F.col("route") == "cell") & (F.col("cell_id") > 0)).groupBy("page_id", "cell_id").agg(
        clean_inline(_joined(F.col("text"), F.col("pos"))).alias("text"))
    cut = F.when(F.length("text") > MAX_CELL, F.concat(F.substring("text", 1, MAX_CELL - 3), F.lit("..."))).otherwise(F.col("text"))
    opened = ev.filter((F.col("kind") == "open") & (F.col("role") == "cell") & (F.col("d_tab") == 1) & (F.col("row_id") > 0))
    placed = opened.select("page_id", "tab_id", "row_id", F.col("pos").alias("cell_id"), _span(F.col("raw"), "colspan", 50).alias(
        "colspan"), _span(F.col("raw"), "rowspan", 100).alias("rowspan")).join(cells, ["page_id", "cell_id"], "left").withColumn(
        "text", F.coalesce(cut, F.lit("")))
    rows = placed.groupBy("page_id", "tab_id", "row_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("cell_id", "text", "colspan", "rowspan"))),
        lambda c: F.struct(c["text"].alias("text"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"))).alias("cells"))
    grids = rows.groupBy("page_id", "tab_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row_id", "cells"))), lambda r: r["cells"]).alias("cells"))
    filled = F.filter(F.transform(expand_spans("cells"), lambda r: F.struct(
        F.exists(r, lambda c: c != "").alias("any"), F.slice(r, 1, MAX_COLS).alias("r"))), lambda r: r["any"])
    grids = grids.withColumn("rows", F.slice(F.transform(filled, lambda r: r["r"]), 1, MAX_ROWS)).drop("cells")
    conts = containers(ev)
    roots = scoped.filter((F.col("kind") == "open") & (F.col("role") == "tabular") & (F.col("d_tab") == 1)).select(
        "page_id", F.col("pos").alias("tab_id"), _attr(F.col("raw"), "id").alias("ident"),
        F.coalesce("scope.title", F.lit("")).alias("section"))
    ends = scoped.filter((F.col("kind") == "close") & (F.col("role") == "tabular") & (F.col("d_tab") == 0)).select(
        "page_id", F.col("opener.pos").alias("tab_id"), F.col("pos").alias("close_pos"), "target")
    # figure and table blocks around a table, at any depth; the innermost that has a caption or a label names it
    blocks = conts.select("page_id", "cont_id", F.coalesce("close_pos", F.lit(2**63 - 1)).alias("block_end"), "is_table", "label", "caption")
    has_name = (F.coalesce("caption", F.lit("")) != "") | (F.coalesce("label", F.lit("")) != "")
    around = roots.select("page_id", "tab_id").join(blocks, "page_id").filter((F.col("cont_id") < F.col("tab_id")) & (F.col("block_end") > F.col("tab_id")))
    around = around.groupBy("page_id", "tab_id").agg(F.bool_or("is_table").alias("in_block"), F.max_by(
        F.struct(F.col("label").alias("l"), F.col("caption").alias("k")), F.when(has_name, F.col("cont_id"))).alias("pick"))
    t = grids.join(roots, ["page_id", "tab_id"]).join(ends, ["page_id", "tab_id"], "left").join(around, ["page_id", "tab_id"], "left")
    inside = F.coalesce("in_block", F.lit(False))
    non_empty = F.size(F.filter(F.flatten("rows"), lambda c: c != ""))
    t = t.filter((non_empty >= 2) & ((F.size("rows") >= 2) | inside))
    pick = F.col("pick")
    label, caption = table_label(pick["l"], pick["k"])
    number = F.coalesce(F.nullif(F.regexp_extract("ident", r"\.T(\d+)", 1), F.lit("")),
                        F.nullif(F.regexp_extract("ident", r"^T(\d+)$", 1), F.lit("")))
    t = t.withColumn("label", F.when(pick.isNotNull(), label).otherwise(F.coalesce(F.concat(F.lit("Table "), number), F.lit(""))))
    t = t.withColumn("caption", F.when(pick.isNotNull(), caption).otherwise("")).withColumn(
        "table_index", F.row_number().over(Window.partitionBy("page_id").orderBy("close_pos")).cast("long"))
    return t.select("page_id", "tab_id", "close_pos", "table_index", "label", "caption", "rows", "section", "target")


def containers(ev: DataFrame) -> DataFrame:
    """(page_id, cont_id, close_pos, is_table, label, caption) of figure and table blocks."""
    opened = ev.filter((F.col("kind") == "open") & (F.col("role") == "container")).select(
        "page_id", F.col("pos").alias("cont_id"), F.array_contains("cls", "ltx_table").alias("is_table"))
    texts = ev.filter((F.col("route") == "caption") & F.col("cont_id").isNotNull()).groupBy("page_id", "cont_id").agg(
        clean_inline(_joined(F.when(F.col("d_tag") == 0, F.col("text")).otherwise(""), F.col("pos"))).alias("caption"),
        F.regexp_replace(clean_inline(_joined(F.when(F.col("d_tag") > 0, F.col("text")).otherwise(""), F.col("pos"))), r"[: ]+$", "").alias("label"))
    ends = ev.filter((F.col("kind") == "close") & (F.col("role") == "container")).select(
        "page_id", F.col("opener.pos").alias("cont_id"), F.col("pos").alias("close_pos"))
    return opened.join(texts, ["page_id", "cont_id"], "left").join(ends, ["page_id", "cont_id"], "left")


def table_label(label: Column, caption: Column) -> tuple[Column, Column]:
    """Normal form of a table label ("Tab. 3:" is "Table 3") and the cut caption."""
    lab, cap = F.coalesce(label, F.lit("")), F.coalesce(caption, F.lit(""))
    source = F.when(lab != "", lab).otherwise(F.substring(cap, 1, 40))
    name = F.initcap(F.regexp_replace(F.regexp_extract(source, LABEL, 1), r"\.$", ""))
    name = F.when(name == "Tab", "Table").when(name == "Fig", "Figure").otherwise(name)
    number = F.regexp_extract(source, LABEL, 2)
    return F.when(name != "", F.concat(name, F.lit(" "), number)).otherwise(lab), F.substring(cap, 1, MAX_CAPTION)


def section_pieces(scoped: DataFrame, heads: DataFrame, tabs: DataFrame, ev: DataFrame) -> DataFrame:
    """(page_id, target, pos, piece): everything that makes up section text, in order."""
    in_figure = containers(ev).select("page_id", "cont_id", "is_table")
    cap = scoped.filter((F.col("route") == "caption") & F.col("target").isNotNull()).join(
        in_figure, ["page_id", "cont_id"], "left").filter(~F.coalesce("is_table", F.lit(False)))
    text = scoped.filter(F.col("route") == "section").select("page_id", "target", "pos", F.lit(0).alias("sub"), F.col("text").alias("piece"))
    parts = [text, cap.select("page_id", "target", "pos", F.lit(0).alias("sub"), F.col("text").alias("piece"))]
    ends = scoped.filter((F.col("kind") == "close") & F.col("tag").isin(*BREAK_TAGS) & F.col("role").isNotNull()
                         & (F.col("d_tab") == 0) & (F.col("d_bib") == 0))
    parts.append(ends.select("page_id", "target", "pos", F.lit(2).alias("sub"), F.lit("\n").alias("piece")))
    titles = scoped.filter((F.col("kind") == "close") & (F.col("role") == "heading")).select("page_id", "pos", "target").join(
        heads.select("page_id", "pos", "title"), ["page_id", "pos"])
    parts.append(titles.select("page_id", "target", "pos", F.lit(1).alias("sub"), F.concat(F.lit("\n"), "title", F.lit("\n")).alias("piece")))
    head = F.concat_ws(" ", F.nullif("label", F.lit("")), F.nullif("caption", F.lit("")))
    body = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")
    rendered = F.concat(F.when(head != "", F.concat(F.lit("["), head, F.lit("]\n"))).otherwise(""), body)
    parts.append(tabs.select("page_id", "target", F.col("close_pos").alias("pos"), F.lit(1).alias("sub"),
                             F.concat(F.lit("\n"), F.substring(rendered, 1, MAX_RENDER), F.lit("\n")).alias("piece")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("target").isin(*SECTION_CAPS))


def empty_container_lines(scoped: DataFrame, ev: DataFrame, tabs: DataFrame) -> DataFrame:
    """Captions of table blocks that hold no table, as one bracketed section line each."""
    shown = tabs.select(F.col("page_id").alias("of_page"), "tab_id")
    bare = containers(ev).filter("is_table").join(shown, (F.col("page_id") == F.col("of_page")) & F.col("tab_id").between(F.col("cont_id"), F.col("close_pos")), "left_anti")
    line = F.concat_ws(" ", F.nullif("label", F.lit("")), F.nullif("caption", F.lit("")))
    at = scoped.select("page_id", F.col("pos").alias("close_pos"), "target")
    return bare.join(at, ["page_id", "close_pos"]).filter(line != "").select(
        "page_id", "target", F.col("close_pos").alias("pos"), F.lit(1).alias("sub"),
        F.concat(F.lit("\n["), F.substring(line, 1, MAX_CAPTION), F.lit("]\n")).alias("piece"))


def sections(pages: DataFrame, hardware: bool = True) -> DataFrame:
    """(page_id, section, text): cleaned section texts within their caps."""
    ev = routed_events(pages)
    heads = headings(ev)
    scoped = scoped_events(ev, heads)
    tabs = tables(ev, scoped)
    pieces = section_pieces(scoped, heads, tabs, ev).unionByName(
        empty_container_lines(scoped, ev, tabs).filter(F.col("target").isin(*SECTION_CAPS)))
    texts = pieces.groupBy("page_id", F.col("target").alias("section")).agg(
        clean_block(_joined(F.col("piece"), F.struct("pos", "sub"))).alias("text"))
    if hardware:
        paras = hardware_paragraphs(scoped)
        lines = hardware_mentions(paras).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(
            F.collect_list(F.struct("rank", "sentence"))), lambda s: s["sentence"]), "\n").alias("hw"))
        hw = lines.select("page_id", F.lit("setup").alias("section"), F.concat(F.lit(HARDWARE_PREFIX + "\n"), "hw").alias("hw"))
        texts = texts.join(hw, ["page_id", "section"], "full").withColumn(
            "text", strip(F.concat_ws("\n", "hw", F.col("text")))).drop("hw")
    cap = literal_map(SECTION_CAPS)
    return texts.select("page_id", "section", F.substring(F.col("text"), F.lit(1), F.try_element_at(cap, F.col("section")).cast("int")).alias("text")).filter(
        F.col("text") != "")


def hardware_paragraphs(scoped: DataFrame) -> DataFrame:
    """(page_id, pos, text) of the paragraphs in method, experiment and limitation sections."""
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ev = scoped.withColumn("d_p", F.sum(F.when(F.col("role") == "para", F.when(F.col("kind") == "open", 1).when(
        F.col("kind") == "close", -1).otherwise(0)).otherwise(0)).over(page)).withColumn(
        "para_id", F.last(F.when((F.col("kind") == "open") & (F.col("role") == "para"), F.col("pos")), ignorenulls=True).over(page))
    inside = ev.filter((F.col("d_p") > 0) & (F.col("text") != "") & (F.col("d_tab") == 0) & (F.col("d_bib") == 0)
                       & F.col("target").isin("methodology", "experiments", "limitations"))
    return inside.groupBy("page_id", F.col("para_id").alias("pos")).agg(clean_inline(_joined(F.col("text"), F.col("pos"))).alias("text"))


def hardware_mentions(paragraphs: DataFrame, pattern: str = hd.HARDWARE) -> DataFrame:
    """(page_id, rank, sentence): distinct sentences that name hardware, the first 8 and 2,000 characters."""
    split = F.split(F.col("text"), r"(?<=[.!?])\s+(?=[A-Z0-9\"“(\[])")
    found = paragraphs.filter(F.col("text").rlike(pattern)).select(
        "page_id", "pos", F.posexplode(split).alias("spos", "sentence")).withColumn("sentence", strip(F.col("sentence"))).filter(
        (F.col("sentence") != "") & F.col("sentence").rlike(pattern)).withColumn(
        "sentence", F.substring("sentence", 1, MAX_HARDWARE_CHARS))
    first = found.groupBy("page_id", "sentence").agg(F.min(F.struct("pos", "spos")).alias("at"))
    w = Window.partitionBy("page_id").orderBy("at", "sentence")
    ranked = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MAX_HARDWARE)
    total = F.sum(F.length("sentence")).over(Window.partitionBy("page_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("total", total).filter(F.col("total") <= MAX_HARDWARE_TOTAL).select(
        "page_id", F.col("rank").cast("long").alias("rank"), "sentence")


def hardware_snippet(text: Column, pattern: str) -> Column:
    """First hardware mention with a little context, at most 60 characters."""
    hit = F.regexp_extract(text, rf"(?is).{{0,12}}(?:{pattern}).{{0,24}}", 0)
    return F.substring(squeeze(hit), 1, 60)


def anchors(scoped: DataFrame) -> DataFrame:
    """(page_id, open_pos, close_pos, href, front, in_bib, bib_id, section): absolute http links."""
    opened = scoped.filter((F.col("kind") == "open") & (F.col("role") == "anchor")).select(
        "page_id", F.col("pos").alias("open_pos"), strip(_attr(F.col("raw"), "href")).alias("h"),
        F.array_contains("cls", "ltx_url").alias("is_url"), "front", (F.col("d_bib") > 0).alias("in_bib"), "bib_id",
        F.col("target").alias("section"))
    bare = F.col("is_url") & F.col("h").rlike(r"(?i)^(?:[a-z0-9-]+\.)+[a-z]{2,}(?:[/:?#].*)?$") & ~F.col("h").rlike(
        r"(?i)\.(?:png|jpe?g|gif|svg|pdf|html?|css|js|txt|bib|tex|eps|zip)$")
    opened = opened.withColumn("h", F.when(bare, F.concat(F.lit("https://"), "h")).otherwise(F.col("h"))).filter(
        F.col("h").rlike(r"(?i)^https?://"))
    ends = scoped.filter((F.col("kind") == "close") & (F.col("role") == "anchor")).select(
        "page_id", F.col("opener.pos").alias("open_pos"), F.col("pos").alias("close_pos"))
    return opened.withColumn("href", unescape(F.col("h"))).drop("h", "is_url").join(ends, ["page_id", "open_pos"], "left")


def references(ev: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, ref_index, text, title, arxiv_id, doi, urls): one row per bibliography item."""
    # Text before the first block and between blocks forms blocks of its own.
    pieces = ev.filter((F.col("route") == "bibliography") & (F.col("d_lab") == 0))
    blocks = pieces.groupBy("page_id", "bib_id", "block_id").agg(
        F.min("pos").alias("first_pos"), clean_inline(_joined(F.col("text"), F.col("pos"))).alias("block")).filter("block <> ''")
    per = blocks.groupBy("page_id", "bib_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first_pos", "block"))), lambda b: b["block"]).alias("blocks"))
    urls = links.filter("in_bib").groupBy("page_id", "bib_id").agg(F.slice(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("open_pos", "href"))), lambda u: u["href"])), 1, 8).alias("urls"))
    items = ev.filter((F.col("kind") == "open") & (F.col("role") == "bibitem")).select("page_id", F.col("pos").alias("bib_id"))
    rows = items.join(per, ["page_id", "bib_id"], "left").join(urls, ["page_id", "bib_id"], "left").withColumn(
        "blocks", F.coalesce("blocks", F.array().cast("array<string>"))).withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))
    rows = rows.withColumn("text", F.array_join("blocks", " ")).filter((F.col("text") != "") | (F.size("urls") > 0))
    w = Window.partitionBy("page_id").orderBy("bib_id")
    rows = rows.withColumn("ref_index", F.row_number().over(w).cast("long")).filter(F.col("ref_index") <= MAX_REFERENCES)
    return rows.select("page_id", "ref_index", F.substring("text", 1, MAX_REFERENCE_CHARS).alias("text"),
                       reference_title(F.col("blocks"), F.col("text")).alias("title"),
                       ids.find_arxiv_id(F.col("text"), F.col("urls")).alias("arxiv_id"),
                       ids.find_doi(F.col("text"), F.col("urls")).alias("doi"), "urls")


# What the second block of a bibliography entry starts with when it names a place
# of publication, and the sizes of a title.
VENUE_STARTS = ("in", "arxiv", "url", "proceedings", "journal", "corr", "technical report", "preprint", "available")
TITLE_CHARS = (8, 300)


def _names_venue(block: Column) -> Column:
    """Starts with a known word, or has a volume, page numbers, a range of numbers or an issue in brackets."""
    shape = F.regexp_replace(F.lower(block), "[0-9]+", "#")
    start = F.concat(F.regexp_replace(shape, "[^a-z#]+", " "), F.lit(" "))
    known = F.lit(False)
    for word in VENUE_STARTS:
        known = known | start.startswith(f"{word} ")
    close = F.regexp_replace(shape, r" ?([(\u2013-]) ?", "$1")
    numbers = close.contains("#(#)") | close.contains("#-#") | close.contains("#\u2013#")
    words = F.split(F.replace(F.regexp_replace(shape, "[^a-z#.]+", " "), F.lit("p. #"), F.lit("p.#")), " ")
    return known | numbers | F.exists(words, lambda w: w.isin("vol", "volume") | w.startswith("vol.") | w.startswith("volume.") | w.startswith("p.#") | w.startswith("pp.#"))


def reference_title(blocks: Column, text: Column) -> Column:
    """Title of a bibliography entry: the first of what is in quotes, what follows the year in
    brackets, and the second block unless it names a venue."""
    fits = lambda t: F.length(t).between(*TITLE_CHARS)
    in_quotes = F.get(F.filter(F.split(text, "[\u201c\u201d\"]"), lambda t, i: (i % 2 == 1) & fits(t)), 0)
    rest = F.get(F.split(text, r"\((?:19|20)\d\d[a-z]?\)\.?\s+", 2), 1)
    sentence = F.get(F.split(rest, r"(?<=[.?!])(?=\s|$)"), 0)
    after_year = F.when(fits(sentence) & sentence.rlike("[.?!]$"), sentence)
    second = F.get(blocks, 1)
    by_place = F.when((F.size(blocks) > 2) | ~_names_venue(second), second)
    found = F.get(F.split(F.coalesce(in_quotes, after_year, by_place, F.lit("")), r"\s+URL\s|https?://"), 0)
    words = F.split(squeeze(found), " ")
    ends_with_year = F.element_at(words, -1).rlike(r"^(?:19|20)\d\d[a-z]?\.?$")
    kept = F.array_join(F.when(ends_with_year, F.slice(words, 1, F.size(words) - 1)).otherwise(words), " ")
    title = F.regexp_replace(kept, "^[ .,;]+|[ .,;]+$", "")
    return F.when(F.length(title) >= 4, F.substring(title, 1, TITLE_CHARS[1])).otherwise("")


def doc_title(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("route") == "doctitle").groupBy("page_id").agg(clean_inline(_joined(F.col("text"), F.col("pos"))).alias("title"))


def coverage(sections_wide: DataFrame, parser_ok: Column = None) -> DataFrame:
    """Complete when abstract, methodology and experiments are all there; lists what is missing."""
    need = ("abstract", "methodology", "experiments")
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    missing = F.array_compact(F.array(*[F.when(blank(c), c) for c in need]))
    ok = F.lit(True) if parser_ok is None else parser_ok
    status = F.when((F.size(missing) == 0) & ok, "complete").otherwise("incomplete")
    return sections_wide.withColumn("missing", missing).withColumn("coverage", status)


# Headings that open the sections of a plain text.
_EXPERIMENT_HEADS = (
    r"(?:experiments?(?:\s+(?:and|&)\s+results?|\s+on[^\r\n]*)?|experimental(?:\s+(?:evaluation|results?|setup))?"
    r"|evaluations?(?:\s+and\s+analysis)?|implementation\s+and\s+evaluation|quantitative\s+evaluation|results?|benchmarks?)"
)
_NUMBERING = r"(?:(?:\d+|[ivxlcdm]+)[.)]?\s+)?"
PLAIN_SECTIONS = {
    "abstract": (r"(?is)(?:abstract|tóm tắt)\s*[\r\n]+(.*?)(?=(?:(?:1|i)\.?\s+)?introduction|giới thiệu|\z)", 2000),
    "methodology": (
        rf"(?is){_NUMBERING}(?:method|methodology|proposed method|proposed approach|architecture|model|approach|framework|system|phương pháp)"
        rf"\s*[\r\n]+(.*?)(?={_NUMBERING}{_EXPERIMENT_HEADS}|thực nghiệm|\z)", 4000),
    "experiments": (
        rf"(?is){_NUMBERING}(?:{_EXPERIMENT_HEADS}|kết quả)\s*[\r\n]+(.*?)(?={_NUMBERING}(?:limitations?|discussion|related work|conclusion)|\z)", 4000),
    "limitations": (
        rf"(?is){_NUMBERING}(?:limitations?|discussion|future work|giới hạn)\s*[\r\n]+(.*?)(?=(?:references|acknowledgments|tài liệu tham khảo)|\z)", 2000),
}


def text_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Sections of a plain text by its headings, else by position (and then marked so)."""
    found = df
    for name, (pattern, cap) in PLAIN_SECTIONS.items():
        found = found.withColumn(f"_{name}", F.substring(squeeze(F.regexp_extract(F.col(text), pattern, 1)), 1, cap))
        found = found.withColumn(f"_has_{name}", F.col(text).rlike(pattern))
    fallback = (F.col("_methodology") == "") & (F.col("_experiments") == "")
    cuts = {"abstract": (1, 1500), "methodology": (1501, 5000), "experiments": (6501, 5000), "limitations": (11501, 2500)}
    out = [F.when(fallback, F.substring(F.col(text), *cuts[n])).otherwise(F.col(f"_{n}")).alias(n) for n in PLAIN_SECTIONS]
    any_head = F.lit(False)
    for name in PLAIN_SECTIONS:
        any_head = any_head | F.col(f"_has_{name}")
    return found.select(*df.columns, *out, F.when(fallback, "fallback").when(any_head, "heading").otherwise("unknown").alias("heading"),
                        F.when(fallback, "degraded").when(any_head, "success").otherwise("unknown").alias("parser_status"))


def reading_order(blocks: DataFrame, max_pages: int = 8) -> DataFrame:
    """(doc_id, text): blocks of two-column pages, left half top-down, then right half.

    ``blocks``: (doc_id, page, width, x0, y0, text), pages from 0.
    """
    kept = blocks.filter((F.col("page") < max_pages) & (strip(F.col("text")) != ""))
    item = F.struct((F.col("x0") >= F.col("width") / 2).alias("right"), "y0", strip(F.col("text")).alias("text"))
    per_page = kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda b: b["text"]), "\n\n").alias("t"))
    return per_page.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda p: p["t"]),
                                                       "\n\n--- PAGE BREAK ---\n\n").alias("text"))


def table_text(label: Column, caption: Column, section: Column, rows: Column, max_chars: int | None = 2500) -> Column:
    """Compact text of one table: label and caption line, then its rows."""
    head = F.regexp_replace(F.concat(F.lit("["), F.when(F.coalesce(label, F.lit("")) != "", label).otherwise("Table"), F.lit("] "),
                                     squeeze(F.coalesce(caption, F.lit("")))), " +$", "")
    head = F.when(F.coalesce(section, F.lit("")) != "", F.concat(head, F.lit(" (section: "), section, F.lit(")"))).otherwise(head)
    shown = rows if max_chars is None else F.slice(rows, 1, 40)
    lines = F.transform(shown, lambda r: F.array_join(F.transform(r, strip), " | "))
    text = F.array_join(F.concat(F.array(head), lines), "\n")
    if max_chars is None:
        return text
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(F.regexp_replace(F.substring(text, 1, max_chars), r"\s+$", ""), F.lit(" ...")))
