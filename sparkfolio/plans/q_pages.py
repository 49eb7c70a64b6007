"""Page extraction on the raw web pages.

The pages carry no paper markup, so the binding gives their title element the class of
a section heading, and (for links) turns their relative links into absolute ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import headings as hd
from sparkfolio.operators import links as lk, pages as pg
from sparkfolio.plans.bindings import sq
from sparkfolio.plans.registry import query, table
from sparkfolio.sources.pages import flag_pages

H1 = '<h1 class="ltx_title ltx_title_section">'


def paper_pages(spark, sf, links: bool = False):
    html = F.replace("html", F.lit("<h1>"), F.lit(H1))
    if links:
        nav = F.regexp_replace(html, "</?nav>", "")
        html = F.regexp_replace(nav, r'href="/([^"]*)"', 'href="https://GitHub.com/owner/$1"')
    return table(spark, sf, "pages").select("page_id", "url", html.alias("html"))


# What stays of a page for a reader: no head, nav and footer; text after the title element.
UNESC = "replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
BODY_SQL = """body AS (
  SELECT page_id, url, html, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
         regexp_extract(html, '(?s)</h1>(.*?)(<footer|$)', 1) AS rest,
         regexp_extract(html, '(?s)</nav>(.*?)<h1>', 1) AS lead,
         len(regexp_extract_all(regexp_replace(html, '(?s)<footer.*$', ''), '<[^!][^>]*>')) AS n_tags FROM pages)"""


@query("read_pages", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ar5iv' WHEN 1 THEN 'arxiv_html' ELSE 'unknown' END AS source, page_id % 2 = 0 AS is_paper FROM pages""")
def read_pages(spark, sf):
    k = F.col("page_id") % 3
    name = F.when(k == 0, F.concat(F.lit("data/ar5iv_"), "page_id")).when(k == 1, F.concat(F.lit("arxiv_"), "page_id")).otherwise(F.col("url"))
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<h1>"), F.lit(H1))).otherwise(F.col("html"))
    return flag_pages(table(spark, sf, "pages").select("page_id", name.alias("name"), html.alias("html")), "name").select(
        "page_id", "source", "is_paper")


@query("is_paper_page", "SELECT page_id, contains(html, '<h1>') AND page_id % 3 = 0 AS is_paper FROM pages")
def is_paper_page(spark, sf):
    html = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<h1>"), F.lit(H1))).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", pg.looks_like_paper(html).alias("is_paper"))


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
#: Every page read tag by tag with the stack of its open elements: an end tag closes the last element of its name and all inside;
#: ``hidden`` is the place in the stack of the outermost skipped element.
WALK_SQL = f"""tok AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT page_id, regexp_extract_all(
    regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', '', 'g'), '(?s)<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<') AS ts FROM pages)),
named AS (SELECT page_id, i, t, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM tok WHERE NOT regexp_matches(t, '^<[!?]')),
tag AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS k, t, name, CASE WHEN name = '' THEN 'text' WHEN starts_with(t, '</') THEN 'close'
    WHEN list_contains({_LIST(pg.VOID)}, name) OR ends_with(t, '/>') THEN 'void' ELSE 'open' END AS kind FROM named),
walk AS (
  SELECT page_id, 0 AS k, CAST([] AS VARCHAR[]) AS stack, 0 AS hidden, 0 AS closed, false AS shown, '' AS kind, '' AS t FROM pages
  UNION ALL
  SELECT page_id, k, next AS stack, CASE WHEN kind = 'open' AND hidden = 0 AND list_contains({_LIST(pg.SKIP_TAGS)}, name) THEN len(next) WHEN len(next) < hidden THEN 0 ELSE hidden END AS hidden,
    CASE WHEN kind <> 'close' THEN 0 WHEN hidden = 0 THEN len(stack) - len(next) ELSE greatest(0, hidden - 1 - len(next)) END AS closed,
    hidden = 0 AND NOT (kind = 'open' AND list_contains({_LIST(pg.SKIP_TAGS)}, name)) AS shown, kind, t
  FROM (SELECT g.*, w.stack, w.hidden, CASE WHEN g.kind = 'open' THEN list_append(w.stack, g.name) WHEN g.kind = 'close' AND list_contains(w.stack, g.name)
          THEN w.stack[1:len(w.stack) - list_position(list_reverse(w.stack), g.name)] ELSE w.stack END AS next
        FROM walk w JOIN tag g ON g.page_id = w.page_id AND g.k = w.k + 1))"""


@query("html_events", "WITH RECURSIVE " + WALK_SQL + """
SELECT page_id, count(*) FILTER (shown AND kind IN ('open', 'void')) AS n_open_or_void, CAST(sum(closed) AS BIGINT) AS n_close, count(*) FILTER (shown AND kind = 'text') AS n_text,
  md5(regexp_replace(""" + UNESC.format(x="coalesce(string_agg(t, '' ORDER BY k) FILTER (shown AND kind = 'text'), '')") + """, '\\s+', '', 'g')) AS text_md5
FROM walk GROUP BY page_id""")
def html_events(spark, sf):
    ev = pg.page_events(table(spark, sf, "pages"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text"))))
    text = F.regexp_replace(F.array_join(F.transform(pieces, lambda p: p["text"]), ""), r"\s+", "")
    return ev.groupBy("page_id").agg(
        F.count_if(F.col("kind").isin("open", "void")).alias("n_open_or_void"), F.count_if(F.col("kind") == "close").alias("n_close"),
        F.count_if(F.col("kind") == "text").alias("n_text"), F.md5(text).alias("text_md5"))


_TEXT = UNESC.format(x="regexp_replace(regexp_replace(regexp_replace({h}, '<br[^>]*>', ' ', 'g'), '</(p|div|article)>', chr(10), 'g'), '<[^>]*>', '', 'g')")


def _clean_sql(x):
    t = f"regexp_replace({x}, '[ \\t\\r\\f]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{2,}}', chr(10), 'g')"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


_KIND_SQL = """CASE WHEN regexp_matches(lower(title), '\\b(abstract|references?)\\b') THEN 'x' ELSE 'methodology' END"""


@query("sections", "WITH " + BODY_SQL + f""",
named AS (SELECT page_id, {sq(UNESC.format(x="regexp_replace(h1, '<[^>]*>', '', 'g')"))} AS title, {_TEXT.format(h='rest')} AS t FROM body)
SELECT page_id, 'methodology' AS section, substring({_clean_sql("chr(10) || title || chr(10) || t")}, 1, 8000) AS text FROM named WHERE title <> ''""")
def sections(spark, sf):
    return pg.sections(paper_pages(spark, sf))


@query("heading_scope", "WITH " + BODY_SQL + f"""
SELECT page_id, {sq(UNESC.format(x="regexp_replace(h1, '<[^>]*>', '', 'g')"))} AS title, 'methodology' AS top_kind,
  CAST(len(regexp_extract_all(rest, '(^|>)[^<>]+')) AS BIGINT) AS n_texts FROM body WHERE trim(h1) <> ''""")
def heading_scope(spark, sf):
    ev = pg.routed_events(paper_pages(spark, sf))
    heads = pg.headings(ev)
    scoped = pg.scoped_events(ev, heads)
    n = scoped.filter((F.col("kind") == "text") & F.col("target").isNotNull()).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_texts"))
    return heads.join(n, "page_id", "left").select("page_id", "title", "top_kind", F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


@query("event_routing", "WITH " + BODY_SQL + """
SELECT page_id, CAST(len(regexp_extract_all(h1, '(^|>)[^<>]+')) AS BIGINT) AS heading, CAST(len(regexp_extract_all(rest, '(^|>)[^<>]+|<br>')) AS BIGINT) + CAST(len(regexp_extract_all(lead, '[^<>]+<')) AS BIGINT) - CAST(len(regexp_extract_all(lead, '<!--[^>]*-->')) AS BIGINT) * 0 AS section,
  CAST(0 AS BIGINT) AS cell FROM body""")
def event_routing(spark, sf):
    ev = pg.routed_events(paper_pages(spark, sf))
    n = lambda r: F.count_if(F.col("route") == r).alias(r)
    return ev.groupBy("page_id").agg(n("heading"), n("section"), n("cell"))


_HREF = "regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href=\"/([^\"]*)\"', 1)"


@query("anchors", f"""
SELECT page_id, 'https://GitHub.com/owner/' || replace(h, '&amp;', '&') AS href, true AS front, false AS in_bib FROM (SELECT page_id, unnest({_HREF}) AS h FROM pages)""")
def anchors(spark, sf):
    ev = pg.routed_events(paper_pages(spark, sf, links=True))
    return pg.anchors(pg.scoped_events(ev, pg.headings(ev))).select("page_id", "href", "front", "in_bib")


_LINK_SQL = f"""raw AS (SELECT page_id, unnest({_HREF}) AS h, unnest(range(len({_HREF}))) AS i FROM pages),
norm AS (SELECT page_id, i, regexp_replace(replace(h, '&amp;', '&'), '[.,;:)\\]}}>"'']+$', '') AS r FROM raw),
lk AS (SELECT page_id, lower(r) AS key, min(i) AS first_i, arg_min(r, i) AS r FROM norm GROUP BY ALL),
lrows AS (SELECT page_id, first_i, CASE WHEN r = '' THEN 'https://github.com/owner' ELSE 'https://github.com/owner/' || r END AS url, CASE WHEN r = '' THEN 'other' ELSE 'github' END AS kind
  FROM lk WHERE r = '' OR regexp_full_match(r, '[A-Za-z0-9_.-]+'))"""


def _links(spark, sf):
    ev = pg.routed_events(paper_pages(spark, sf, links=True))
    scoped = pg.scoped_events(ev, pg.headings(ev))
    return ev, scoped, lk.links(scoped, pg.anchors(scoped))


@query("links", "WITH " + _LINK_SQL + """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_i) AS link_index, url, kind, false AS in_bibliography, true AS is_primary FROM lrows""")
def links(spark, sf):
    return _links(spark, sf)[2].drop("context")


@query("primary_repos", "WITH " + _LINK_SQL + """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_i) AS rank, url FROM lrows WHERE kind = 'github'
QUALIFY rank <= 8""")
def primary_repos(spark, sf):
    return lk.code_urls(_links(spark, sf)[2])


@query("line_context", None)
def line_context(spark, sf):
    return _links(spark, sf)[2].select("page_id", "link_index", "context")


@query("extract_summary", "WITH " + BODY_SQL + "," + _LINK_SQL + f""",
named AS (SELECT page_id, {sq(UNESC.format(x="regexp_replace(h1, '<[^>]*>', '', 'g')"))} AS title, {_TEXT.format(h='rest')} AS t FROM body)
SELECT page_id, true AS is_paper, CAST(1 AS BIGINT) AS n_sections, CAST(length(substring({_clean_sql("chr(10) || title || chr(10) || t")}, 1, 8000)) AS BIGINT) AS section_chars,
  CAST(0 AS BIGINT) AS n_tables, CAST(0 AS BIGINT) AS n_references, CAST(0 AS BIGINT) AS n_with_id, CAST(0 AS BIGINT) AS n_with_doi,
  (SELECT count(*) FROM lrows WHERE lrows.page_id = named.page_id) AS n_links, (SELECT count(*) FROM lrows WHERE lrows.page_id = named.page_id) AS n_primary FROM named""")
def extract_summary(spark, sf):
    src = paper_pages(spark, sf, links=True)
    ev, scoped, link_rows = _links(spark, sf)
    found = pg.anchors(scoped)
    return lk.extraction_report(
        src.withColumn("is_paper", pg.looks_like_paper(F.col("html"))), pg.sections(src), pg.tables(ev, scoped),
        pg.references(ev, found), link_rows)


def _marked_pages(spark, sf, swaps):
    """Pages whose menu list is given the markup of another block (the pages have none of their own)."""
    html = F.regexp_replace("html", "</?nav>", "")
    for old, new in swaps:
        html = F.replace(html, F.lit(old), F.lit(new))
    html = F.regexp_replace(html, r'href="/([^"]*)"', 'href="https://example.org/abs/2401.0$1"')
    return table(spark, sf, "pages").select("page_id", html.alias("html"))


_MENU = "regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"/[^\"]*\">([^<]*)</a>', 1)"


@query("references", f"""
SELECT page_id, i + 1 AS ref_index, trim({UNESC.format(x='t')}) AS text FROM (SELECT page_id, unnest({_MENU}) AS t, unnest(range(len({_MENU}))) AS i FROM pages)""")
def references(spark, sf):
    ev = pg.routed_events(_marked_pages(spark, sf, [("<li>", '<li class="ltx_bibitem"><span class="ltx_bibblock">'), ("</li>", "</span></li>")]))
    scoped = pg.scoped_events(ev, pg.headings(ev))
    return pg.references(ev, pg.anchors(scoped)).select("page_id", "ref_index", "text")


@query("tables", f"""
SELECT page_id, CAST(1 AS BIGINT) AS table_index, array_to_string(list_filter(list_transform({_MENU}, lambda t: trim({UNESC.format(x='t')})), lambda t: t <> ''), ';') AS cells FROM pages
WHERE len(list_filter({_MENU}, lambda t: trim(t) <> '')) >= 2""")
def tables(spark, sf):
    ev = pg.routed_events(_marked_pages(spark, sf, [("<ul>", '<table class="ltx_tabular">'), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")]))
    scoped = pg.scoped_events(ev, pg.headings(ev))
    return pg.tables(ev, scoped).select("page_id", "table_index", F.array_join(F.flatten("rows"), ";").alias("cells"))


@query("hardware_sentences", """
WITH s AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS s, unnest(range(len(string_split(t, chr(1))))) AS i
  FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+([A-Z0-9"“(\\[])', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents)),
f AS (SELECT doc_id, substring(trim(s), 1, 400) AS sentence, min(i) AS i FROM s WHERE regexp_matches(s, '(^|[^A-Za-zÀ-ÿ])(that|la|der|los)([^A-Za-zÀ-ÿ]|$)') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, sentence) AS rank FROM f),
c AS (SELECT *, sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY rank) AS total FROM r WHERE rank <= 8)
SELECT doc_id AS page_id, rank, sentence FROM c WHERE total <= 2000""")
def hardware_sentences(spark, sf):
    from sparkfolio.functions.text import squeeze

    paras = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.lit(0).alias("pos"), squeeze(F.col("text")).alias("text"))
    return pg.hardware_mentions(paras, r"(?:^|[^A-Za-zÀ-ÿ])(?:that|la|der|los)(?:[^A-Za-zÀ-ÿ]|$)")


@query("coverage", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 OR trim(text) = '' OR doc_id % 7 = 0 THEN 'incomplete' ELSE 'complete' END AS coverage,
  array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'abstract' END, CASE WHEN trim(text) = '' THEN 'methodology' END, CASE WHEN doc_id % 5 = 0 THEN 'experiments' END], lambda x: x IS NOT NULL), ',') AS missing
FROM documents""")
def coverage(spark, sf):
    wide = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("abstract"), F.col("text").alias("methodology"),
        F.when(F.col("doc_id") % 5 == 0, " \n").otherwise(F.col("lang")).alias("experiments"))
    out = pg.coverage(wide, F.col("doc_id") % 7 != 0)
    return out.select("doc_id", "coverage", F.array_join("missing", ",").alias("missing"))


@query("plain_sections", f"""
WITH d AS (SELECT doc_id, {sq('text')} AS t FROM documents),
x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Abstract' || chr(10) || regexp_replace(t, '[^a-zA-Z ]', '', 'g') || chr(10) || '1 Introduction' || chr(10) || 'zz' || chr(10) || 'Methodology' || chr(10) || 'qqq ' || CAST(doc_id AS VARCHAR) || ' yy' || chr(10) || 'Results' || chr(10) || 'www' || chr(10) || 'Limitations' || chr(10) || 'none' ELSE 'Qz ' || regexp_replace(t, '[^ ]', 'x', 'g') END AS text, t FROM d)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'heading' ELSE 'fallback' END AS heading, CASE WHEN doc_id % 2 = 0 THEN 'success' ELSE 'degraded' END AS parser_status,
  CASE WHEN doc_id % 2 = 0 THEN 'qqq ' || CAST(doc_id AS VARCHAR) || ' yy' ELSE substring(text, 1501, 5000) END AS methodology, CASE WHEN doc_id % 2 = 0 THEN 'www' ELSE substring(text, 6501, 5000) END AS experiments,
  CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE substring(text, 11501, 2500) END AS limitations FROM x""")
def plain_sections(spark, sf):
    from sparkfolio.functions.text import squeeze

    t = squeeze(F.col("text"))
    with_heads = F.concat(F.lit("Abstract\n"), F.regexp_replace(t, "[^a-zA-Z ]", ""), F.lit("\n1 Introduction\nzz\nMethodology\nqqq "),
                          F.col("doc_id").cast("string"), F.lit(" yy\nResults\nwww\nLimitations\nnone"))
    text = F.when(F.col("doc_id") % 2 == 0, with_heads).otherwise(
        F.concat(F.lit("Qz "), F.regexp_replace(t, "[^ ]", "x")))
    out = pg.text_sections(table(spark, sf, "documents").select("doc_id", text.alias("text")))
    return out.select("doc_id", "heading", "parser_status", "methodology", "experiments", "limitations")


@query("heading_classes", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'experiments' WHEN 1 THEN 'setup' WHEN 2 THEN CASE WHEN doc_id % 8 = 2 THEN 'experiments' ELSE 'methodology' END ELSE '-' END AS top, CASE doc_id % 4 WHEN 1 THEN 'setup' ELSE '-' END AS sub FROM documents""")
def heading_classes(spark, sf):
    k = F.col("doc_id") % 4
    title = F.when(k == 0, "Main Results").when(k == 1, "Training Details").when(k == 2, F.concat(F.lit("Q"), F.col("doc_id").cast("string"))).otherwise("Related Work")
    return table(spark, sf, "documents").select(
        "doc_id", F.coalesce(hd.classify_top(title, F.lit(False), F.col("doc_id") % 8 == 2), F.lit("-")).alias("top"),
        F.coalesce(hd.classify_sub(title), F.lit("-")).alias("sub"))
