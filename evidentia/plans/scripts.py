"""Queries over the scripts of pages and the sources behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assets as A
from ..operators import pages as P
from ..operators import scoring
from ..operators.tables import result
from . import code as PC
from .web import YEAR, _pages

# Test values: the code in a page's script and in its source map, by the remainder of its id.
_CODE = ["\n".join(x * (1 if len(x) > 8 else 2)) + "\n" for _, _, x in PC.PIECES]


def _piece(shift: int):
    chosen = F.lit("")
    for i, x in enumerate(_CODE):
        chosen = F.when((F.col("page_id") + shift) % len(_CODE) == i, F.lit(x)).otherwise(chosen)
    return chosen


def scripted(spark, sf_dir):
    """Pages with a readable script that is made of their markup, one tag to a line, behind a piece of code; a style, a minified script and, for some, a source map."""
    p = _pages(spark, sf_dir)
    root = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1)
    lined = F.replace(F.col("html"), F.lit(">"), F.lit(">\n"))
    at = lambda name: F.concat(root, F.lit(name))
    loaded = F.create_map(at("/a.css"), F.concat(_piece(0), lined), at("/js/app.js?v=1"), F.concat(_piece(0), lined), at("/js/min.js"), F.replace(lined, F.lit("\n"), F.lit(" ")), at("/js/small.js"), F.lit("// hm\n") , at("/js/more.js"), F.concat(lined, _piece(3)))
    source = F.struct(F.lit("app.js.map").alias("url"), F.array(F.lit("src/app.ts")).alias("sources"), F.when(F.col("page_id") % 5 == 3, " \n").otherwise(F.concat(_piece(7), F.lit("export default 1;"))).alias("content"))
    return p.withColumn("assets", loaded).withColumn("source_maps", F.when(F.col("page_id") % 3 == 1, F.array(source)))


def page_asset_hits(spark, sf_dir):
    """Signals of the code that each page loads, and where they come first: script 0, script 1 or the source map behind them."""
    found = A.hits(A.sub_subjects(scripted(spark, sf_dir)))
    return found.select("page_id", "signal_id", F.floor((F.col("fire_seq") - A.AFTER_PAGE) / A.A_SUBJECT).cast("int").alias("sub"))


def page_asset_reports(spark, sf_dir):
    """Reports of pages with and without what they load."""

    def made(folder):
        p = scripted(spark, sf_dir)
        prepared = P.prepare(p)
        # written once, as both reports need them
        own = folder.write(P.hits(prepared, YEAR).withColumn("evidence", F.array().cast("array<string>")), "own")
        thin = folder.write(prepared.select(F.col("page_id").alias("subject_id"), "thin"), "thin")
        both = A.merged(own, A.hits(A.sub_subjects(p)))
        report = lambda h: scoring.reports(h.withColumnRenamed("page_id", "subject_id"), thin).select("subject_id", "score", "verdict", "ai", "human")
        alone = report(own).select("subject_id", F.col("score").alias("score_alone"))
        return report(both).join(alone, "subject_id")

    return result(spark, "assets", made)


QUERIES = {f.__name__: f for f in (page_asset_hits, page_asset_reports)}

_PIECE = lambda shift: "CASE " + " ".join(f"WHEN (page_id + {shift}) % {len(_CODE)} = {i} THEN '{PC._q(x)}'" for i, x in enumerate(_CODE)) + " ELSE '' END"
_LINED = "replace(html, '>', '>' || chr(10))"
_SUBS = f"""loaded AS (SELECT page_id, 0 AS n, {_PIECE(0)} || {_LINED} AS src FROM pages UNION ALL SELECT page_id, 1, {_LINED} || {_PIECE(3)} FROM pages),
fit AS (SELECT *, length(src) - length(replace(src, chr(10), '')) + 1 AS k FROM loaded), readable AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS sub, src FROM fit WHERE strlen(src) >= 400 AND k >= 8 AND strlen(src) <= 300 * k),
behind AS (SELECT page_id, chr(10) || {_PIECE(7)} || 'export default 1;' AS src FROM pages WHERE page_id % 3 = 1 AND page_id % 5 <> 3),
subs AS (SELECT * FROM readable UNION ALL SELECT page_id, (SELECT count(*) FROM readable r WHERE r.page_id = b.page_id), src FROM behind b),
s AS (SELECT page_id * 4 + sub AS subject_id, regexp_replace(src, '\\r\\n?', chr(10), 'g') AS src FROM subs)"""
SQL = {"page_asset_hits": f"WITH {PC._HITS.replace(PC._SRC, _SUBS)} SELECT subject_id // 4 AS page_id, signal_id, min(subject_id % 4)::INT AS sub FROM hits GROUP BY ALL"}
