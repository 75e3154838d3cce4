"""Queries over the driver's tables that apply each page and deck operator, with the same computations in SQL.

The tables hold no pages or decks, so both sides derive them by the same rules: blocks from the lines of documents, words
from their words, images and pixels from line items, cards from parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import markup
from ..functions import text as X
from ..functions.folding import folded
from ..functions.ranges import page_list, page_ranges
from ..operators import cards, duplicates, layout, ocr_words, pages
from ..sinks import files
from ..sinks.decks import tsv_line
from ..sources import deck_source
from ..sources.stores import scratch

SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blanks at line ends, mixed line ends, control characters and runs of empty lines."""
    noise = F.lit(".  \r\n\n\n\n\n\x01")
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(". "), noise).alias("text"))


NOISY = "SELECT doc_id, replace(coalesce(text, ''), '. ', '.  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || chr(1)) AS text FROM documents"


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


TEXT_CLEAN = rf"""WITH a AS ({NOISY}), b AS (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\r', chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]', '', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '[\t\p{{Z}}]+(\n|$)', '\1', 'g') AS t FROM c),
e AS (SELECT doc_id, trim(regexp_replace(t, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10)) AS t FROM d)
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM e"""


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.replace("text", F.lit("th"), F.lit("�≤α")), F.lit(""))
    rows = X.once(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), {"_solid": X.solid_metrics(F.col("text")), "_math": X.count_math(F.col("text"))})
    return rows.select("doc_id", F.col("_solid.chars").cast("long").alias("chars"), "_solid.garbage_ratio", "_solid.alnum_ratio", F.col("_math").cast("long").alias("math_signs"))


TEXT_METRICS = rf"""WITH a AS (SELECT doc_id, coalesce(replace(text, 'th', chr(65533) || '≤α'), '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_replace(t, '{SQL_SPACE}', '', 'g') AS s FROM a)
SELECT doc_id, length(s) AS chars,
  CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^\x{{fffd}}\p{{Co}}\p{{Cc}}]', '', 'g')) / length(s)::DOUBLE ELSE 0.0 END AS garbage_ratio,
  CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(s)::DOUBLE ELSE 1.0 END AS alnum_ratio,
  length(t) - length(translate(t, '{C.MATH_SIGNS}', '')) AS math_signs FROM b"""


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = markup.visible_text(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(seen).cast("long").alias("n"), F.md5(seen).alias("digest"), X.preview(seen).alias("preview"))


VISIBLE = rf"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(t, '{SQL_SPACE}+', ' ', 'g'), ' ') AS t FROM b)
SELECT page_id, length(t) AS n, md5(t) AS digest, CASE WHEN length(t) > 70 THEN left(t, 67) || '...' ELSE t END AS preview FROM c"""


def html_unknown_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag-like fragments of pages that are no known tag, as they are reported for cards."""
    tags = table(spark, sf_dir, "pages").select("page_id", markup.unknown_tags(F.coalesce("html", F.lit(""))).alias("tags"))
    return tags.select("page_id", F.size("tags").cast("long").alias("n_unknown"), F.array_join(F.slice("tags", 1, 3), " ").alias("first"), F.md5(F.array_join("tags", " ")).alias("digest"))


UNKNOWN = rf"""WITH a AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '</?\s*[A-Za-z][A-Za-z0-9-]*[^>]*>') AS t FROM pages),
b AS (SELECT page_id, list_filter(t, lambda x: NOT list_contains([{', '.join(f"'{t}'" for t in sorted(C.HTML_TAGS))}], lower(regexp_extract(x, '</?\s*([A-Za-z][A-Za-z0-9-]*)', 1)))) AS u FROM a),
c AS (SELECT page_id, list_transform(u, lambda x: CASE WHEN length(x) <= {C.PREVIEW_SNIPPET} THEN x ELSE regexp_extract(x, '</?\s*[A-Za-z][A-Za-z0-9-]*') END) AS u FROM b)
SELECT page_id, len(u) AS n_unknown, array_to_string(u[1:3], ' ') AS first, md5(array_to_string(u, ' ')) AS digest FROM c"""


# ---- duplicates and page lists


def keyed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the digest of their text but for case and white space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(X.squeezed(F.coalesce("text", F.lit(""))))).alias("key"))


def doc_normalized_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document with the same text but for case and white space."""
    return duplicates.first_seen(keyed_texts(spark, sf_dir), "key", "doc_id").select("doc_id", "duplicate_of")


KEYED = f"SELECT doc_id, md5(lower(trim(regexp_replace(coalesce(text, ''), '{SQL_SPACE}+', ' ', 'g'), ' '))) AS key FROM documents"
DEDUP = f"WITH a AS ({KEYED}), b AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS f FROM a) SELECT doc_id, CASE WHEN f < doc_id THEN f END AS duplicate_of FROM b"


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.repeated(keyed_texts(spark, sf_dir), "key", "doc_id")


GROUPS = f"WITH a AS ({KEYED}) SELECT key, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM a GROUP BY key HAVING count(*) > 1"


def page_ranges_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_of = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("page"))
    return page_ranges(pages_of, ["user_id"], "page")


def page_ranges_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_of = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("page"))
    return pages_of.groupBy("user_id").agg(F.collect_set("page").alias("p")).select("user_id", page_list(F.col("p")).alias("ranges"))


RANGES = """WITH a AS (SELECT DISTINCT user_id, event_id % 50 AS p FROM events), b AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM a),
c AS (SELECT user_id, min(p) AS lo, max(p) AS hi FROM b GROUP BY user_id, g)
SELECT user_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM c GROUP BY user_id"""


# ---- words and blocks


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word_idx", "text"))
    i = F.col("word_idx")
    return split.select(
        "doc_id", "word_idx", "text", F.when(i % 9 == 4, 4).otherwise(5).alias("level"), F.floor(i / 40).cast("int").alias("block_num"), (F.floor(i / 20) % 2).cast("int").alias("par_num"),
        (F.floor(i / 10) % 3).cast("int").alias("line_num"), F.when(i % 13 == 5, F.lit(None)).otherwise(((F.col("doc_id") * 31 + i * 17) % 103 - 2).cast("double")).alias("conf"),
    )


def ocr_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ocr_words.regroup(words(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"), "confidence", (F.col("confidence") < C.LOW_CONFIDENCE).alias("low_confidence"))


OCR = rf"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), r AS (SELECT doc_id, p - 1 AS i, w[p] AS text FROM s, range(1, len(w) + 1) AS t(p)),
k AS (SELECT doc_id, i, text, i // 40 AS b, (i // 20) % 2 AS p, (i // 10) % 3 AS l, CASE WHEN i % 13 <> 5 THEN ((doc_id * 31 + i * 17) % 103 - 2)::DOUBLE END AS conf
  FROM r WHERE i % 9 <> 4 AND regexp_replace(text, '{SQL_SPACE}', '', 'g') <> ''),
n AS (SELECT *, coalesce((lag((b, p, l)) OVER w <> (b, p, l))::INT, 0) AS nl, coalesce((lag((b, p)) OVER w <> (b, p))::INT, 0) AS np FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT *, sum(nl) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
x AS (SELECT doc_id, run, string_agg(text, ' ' ORDER BY i) AS line, max(np) AS gap, sum(CASE WHEN conf >= 0 THEN conf END) AS cs, count(CASE WHEN conf >= 0 THEN 1 END) AS cn FROM u GROUP BY doc_id, run),
y AS (SELECT doc_id, string_agg(CASE WHEN gap = 1 THEN chr(10) ELSE '' END || line, chr(10) ORDER BY run) AS t, CASE WHEN sum(cn) > 0 THEN sum(cs) / sum(cn) END AS confidence FROM x GROUP BY doc_id)
SELECT doc_id, length(t) AS n, md5(t) AS digest, confidence, confidence < 60 AS low_confidence FROM y"""


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    s = F.col("seq")
    x0 = F.when(s % 2 == 0, 50.0).otherwise(320.0)
    y0 = (F.floor(s / 2) * 40 - (s % 5) * 30).cast("double")
    return lines.select("doc_id", "seq", x0.alias("x0"), y0.alias("y0"), (x0 + 200 + F.length("text") % 60).cast("double").alias("x1"), (y0 + 30).alias("y1"), "text", F.lit(0).alias("type"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_rows(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("seq", "x0", "y0", "x1", "y1", "text", "type")).alias("b"))
    return rows.select("doc_id", layout.text_blocks(F.col("b")).alias("blocks"))


BLOCKS = rf"""s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), r AS (SELECT doc_id, p - 1 AS seq, l[p] AS text FROM s, range(1, len(l) + 1) AS t(p)),
z AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 50.0::DOUBLE ELSE 320.0::DOUBLE END AS x0, ((seq // 2) * 40 - (seq % 5) * 30)::DOUBLE AS y0, length(regexp_replace(text, '{SQL_SPACE}', '', 'g')) AS c FROM r),
blocks AS (SELECT *, x0 + 200 + length(text) % 60 AS x1, y0 + 30 AS y1 FROM z WHERE c > 0)"""


def block_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", F.size("blocks").cast("long").alias("block_count"), layout.median_chars(F.col("blocks")).alias("median_block_chars"))


MEDIAN = f"WITH {BLOCKS}, d AS (SELECT doc_id FROM documents) SELECT d.doc_id, count(c) AS block_count, coalesce(median(c), 0.0)::DOUBLE AS median_block_chars FROM d LEFT JOIN blocks b ON d.doc_id = b.doc_id GROUP BY d.doc_id"


def two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", layout.multi_column(F.col("blocks"), F.lit(0.0), F.lit(612.0)).alias("multi_column"))


COLUMNS = f"""WITH {BLOCKS}, big AS (SELECT * FROM blocks WHERE c >= 40), l AS (SELECT * FROM big WHERE x1 <= 306 + 612 * 0.05::DOUBLE), q AS (SELECT * FROM big WHERE x0 >= 306 - 612 * 0.05::DOUBLE),
pairs AS (SELECT DISTINCT l.doc_id FROM l JOIN q ON l.doc_id = q.doc_id AND l.y0 < q.y1 AND q.y0 < l.y1), nl AS (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) >= 2), nq AS (SELECT doc_id FROM q GROUP BY 1 HAVING count(*) >= 2)
SELECT doc_id, doc_id IN (SELECT doc_id FROM pairs) AND doc_id IN (SELECT doc_id FROM nl) AND doc_id IN (SELECT doc_id FROM nq) AS multi_column FROM documents"""


def order_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_rows(spark, sf_dir).where(X.without_space(F.col("text")) != "")
    return layout.order_jumps_rows(rows, ["doc_id"]).select("doc_id", F.col("order_jumps").cast("long").alias("order_jumps"))


def order_jumps_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).where(F.size("blocks") > 0).select("doc_id", layout.order_jumps(F.col("blocks")).cast("long").alias("order_jumps"))


JUMPS = f"""WITH {BLOCKS}, j AS (SELECT doc_id, (y0 < lag(y0) OVER w - 24 AND x0 < lag(x1) OVER w - 10) AS jump FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, count(*) FILTER (WHERE jump) AS order_jumps FROM j GROUP BY doc_id"""


# ---- images and pixels


def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("l_partkey") % 600).cast("double") - 40, (F.col("l_suppkey") * 7 % 1000).cast("double") - 30
    images = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 9 - 60).alias("x1"), (y0 + F.col("l_linenumber") * 64).alias("y1"))).alias("images"))
    shares = layout.image_shares(F.col("images"), F.lit(0.0), F.lit(0.0), F.lit(512.0), F.lit(1024.0))
    return images.select("l_orderkey", layout.image_count(shares).cast("long").alias("image_count"), layout.image_coverage(shares).alias("image_coverage"))


COVERAGE = """WITH a AS (SELECT l_orderkey, (l_partkey % 600)::DOUBLE - 40 AS x0, (l_suppkey * 7 % 1000)::DOUBLE - 30 AS y0, l_quantity, l_linenumber FROM lineitem),
b AS (SELECT l_orderkey, least(x0 + l_quantity * 9 - 60, 512) - greatest(x0, 0) AS w, least(y0 + l_linenumber * 64, 1024) - greatest(y0, 0) AS h FROM a),
c AS (SELECT l_orderkey, CASE WHEN w > 0 AND h > 0 THEN w * h / 524288.0 END AS s FROM b)
SELECT l_orderkey, count(*) FILTER (WHERE s >= 0.02) AS image_count, least(coalesce(sum(s), 0), 1)::DOUBLE AS image_coverage FROM c GROUP BY l_orderkey"""


def ink_histogram_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("int") * 5 % 256).alias("grey"))
    return layout.background_rows(pixels, ["l_orderkey"])


MODE = """WITH a AS (SELECT l_orderkey, (l_quantity::INT * 5) % 256 AS grey FROM lineitem), b AS (SELECT l_orderkey, grey, count(*) AS n FROM a GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, grey) AS k, sum(n) OVER (PARTITION BY l_orderkey) AS pixels FROM b) SELECT l_orderkey, grey AS background, pixels::BIGINT AS pixels FROM c WHERE k = 1"""


def ink_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ASCII characters of a document as a raster of 64 grey pixels a line, with two text boxes."""
    d = F.col("doc_id")
    ascii_text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "")
    rows = table(spark, sf_dir, "documents").select("doc_id", ascii_text.alias("t")).withColumn("h", F.greatest(F.ceil(F.length("t") / 64), F.lit(1)).cast("int"))
    samples = F.encode(F.rpad("t", F.col("h") * 64, F.lit("#")), "UTF-8")
    box = lambda i: F.struct(F.lit(i).alias("seq"), (d % 20 * 2 + i * 50).cast("double").alias("x0"), (d % 5 * 4).cast("double").alias("y0"), (d % 20 * 2 + i * 50 + 33).cast("double").alias("x1"), (d % 5 * 4 + 12).cast("double").alias("y1"), F.lit("").alias("text"), F.lit(0).alias("type"))
    raster = F.struct(F.lit(64).alias("w"), "h", F.lit(64).alias("stride"), samples.alias("samples"))
    found = layout.with_ink(rows, "i", raster, F.array(box(0), box(1)), F.lit(0.0), F.lit(0.0)).select("doc_id", "i")
    return found.select("doc_id", F.round("i.ink_ratio", 9).alias("ink_ratio"), F.round("i.nontext_ink_ratio", 9).alias("nontext_ink_ratio"))


INK = """WITH r AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS t FROM documents), a AS (SELECT doc_id, greatest(1, ceil(length(t) / 64.0))::BIGINT AS h, t FROM r),
b AS (SELECT doc_id, h, unnest(range(0, h * 64)) AS i, unnest(string_split(rpad(t, (h * 64)::INT, '#'), '')) AS c FROM a),
p AS (SELECT doc_id, h, i, i % 64 AS x, i // 64 AS y, ascii(c) AS g FROM b),
m AS (SELECT doc_id, g AS bg FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, g) AS k FROM p GROUP BY doc_id, g) WHERE k = 1),
q AS (SELECT p.doc_id, h, abs(g - bg) > 48 AS ink, x, y, (p.doc_id % 20) * 2 AS bx, (p.doc_id % 5) * 4 AS b_y FROM p JOIN m USING (doc_id)),
o AS (SELECT doc_id, h, ink, ((x >= greatest(0, trunc((bx - 3) * 0.5)) AND x < least(64, trunc((bx + 36) * 0.5) + 1)) OR (x >= greatest(0, trunc((bx + 47) * 0.5)) AND x < least(64, trunc((bx + 86) * 0.5) + 1)))
  AND y >= greatest(0, trunc((b_y - 3) * 0.5)) AND y < least(h, trunc((b_y + 15) * 0.5) + 1) AS inside FROM q)
SELECT doc_id, round(count(*) FILTER (WHERE ink) / (64.0::DOUBLE * max(h)), 9) AS ink_ratio, round(count(*) FILTER (WHERE ink AND NOT inside) / (64.0::DOUBLE * max(h)), 9) AS nontext_ink_ratio FROM o GROUP BY doc_id"""


# ---- decisions


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text as a page (doc_id, source, v, text), and beside it, by rule, pages that are empty, unreadable or short."""
    d, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    texts = (t, F.lit(""), F.regexp_replace(t, "[a-z]", "-"), F.regexp_replace(t, "[aeiou]", "�"), F.concat(F.lit("A line of page "), d.cast("string")))
    pages_of = F.array_compact(F.array(*(F.when(held, F.struct(F.lit(i).alias("v"), text.alias("text"))) for i, (held, text) in enumerate(zip(page_rules(), texts, strict=True)))))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(pages_of).alias("p")).select("doc_id", "source", "p.*")


def page_rules() -> tuple[Column, ...]:
    """Which documents have a page of each kind."""
    return F.lit(True), *(F.col("doc_id") % n == 0 for n in (17, 19, 23, 5))


def page_number() -> Column:
    return (F.col("doc_id") * 5 + F.col("v")).cast("int")


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of ``page_rows`` (doc_id, source, page_no) without a look at their texts."""
    found = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.array_compact(F.array(*(F.when(held, i) for i, held in enumerate(page_rules()))))).alias("v"))
    return found.select("doc_id", "source", page_number().alias("page_no"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with the metrics of their texts; layout metrics by rule."""
    rows = page_rows(spark, sf_dir).withColumn("k", F.col("doc_id") + F.col("v"))
    rows = X.once(rows, {"_solid": X.solid_metrics(F.col("text")), "_math": X.count_math(F.col("text"))})
    k = F.col("k")
    return rows.select(
        F.concat(F.lit("doc"), "doc_id").alias("doc_id"), page_number().alias("page_no"), "source", "text", "_solid.*",
        ((k % 4) / 1000.0).alias("ink_ratio"), ((k % 5) / 100.0).alias("nontext_ink_ratio"), (k % 6).cast("int").alias("image_count"), ((k % 7) / 10.0).alias("image_coverage"),
        (k % 11 * 9).cast("int").alias("drawing_count"), (k % 3).cast("int").alias("table_count"), (k % 15).cast("int").alias("block_count"), ((k % 50) / 1.0).alias("median_block_chars"), (k % 8 == 0).alias("multi_column"),
        (k % 6).cast("int").alias("order_jumps"), (F.col("_math") >= C.MATH_LEAST).alias("has_math"), F.when(k % 31 == 0, F.lit("ValueError: damaged")).alias("error"),
    )


MEASURED = rf"""whole AS (SELECT doc_id AS d, source, coalesce(text, '') AS text FROM documents),
t0 AS (SELECT *, d + v AS k, 'doc' || d AS doc_id, (d * 5 + v)::INT AS page_no FROM (SELECT d, source, 0 AS v, text FROM whole UNION ALL SELECT d, source, 1, '' FROM whole WHERE d % 17 = 0
  UNION ALL SELECT d, source, 2, regexp_replace(text, '[a-z]', '-', 'g') FROM whole WHERE d % 19 = 0 UNION ALL SELECT d, source, 3, regexp_replace(text, '[aeiou]', chr(65533), 'g') FROM whole WHERE d % 23 = 0
  UNION ALL SELECT d, source, 4, 'A line of page ' || d FROM whole WHERE d % 5 = 0)),
t1 AS (SELECT *, regexp_replace(text, '{SQL_SPACE}', '', 'g') AS s FROM t0),
t2 AS (SELECT *, length(s) AS chars, CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^\x{{fffd}}\p{{Co}}\p{{Cc}}]', '', 'g')) / length(s)::DOUBLE ELSE 0 END AS garbage,
  CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(s)::DOUBLE ELSE 1 END AS alnum, (k % 7) / 10.0::DOUBLE AS coverage, k % 31 = 0 AS failed FROM t1),
t3 AS (SELECT *, CASE WHEN chars = 0 AND (k % 4) / 1000.0::DOUBLE < 0.001 THEN NULL WHEN chars = 0 THEN 'no_text' WHEN garbage > 0.10 THEN 'garbled' WHEN chars >= 20 AND alnum < 0.15 THEN 'few_letters'
  WHEN chars < 50 AND ((k % 5) / 100.0::DOUBLE >= 0.02 OR coverage >= 0.10) THEN 'short' END AS quality_code FROM t2),
t4 AS (SELECT *, CASE WHEN failed THEN 'replace' WHEN quality_code IN ('no_text', 'garbled', 'few_letters') THEN 'replace' WHEN quality_code IS NOT NULL OR coverage >= 0.4 THEN 'supplement' END AS ocr_mode,
  CASE WHEN failed THEN 0 ELSE (coverage >= 0.3)::INT + (coverage < 0.3 AND k % 6 >= 3)::INT + ((k % 11) * 9 >= 50)::INT + (k % 3 > 0)::INT + (k % 15 >= 12 AND k % 50 < 25)::INT END AS n_reasons,
  NOT failed AND k % 6 >= 2 AND k % 6 >= 0.25 * greatest(k % 15 - 1, 1) AS jumps FROM t3)"""


def quality_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = pages.decide(measured(spark, sf_dir))
    reasons = F.when(F.col("error").isNotNull(), F.lit(0)).otherwise(F.size(pages.complex_reasons()))
    return decided.select("doc_id", "page_no", "quality_code", "ocr_mode", F.col("ocr_reason").isNotNull().alias("has_reason"), reasons.cast("long").alias("n_reasons"))


DECISION = f"WITH {MEASURED} SELECT doc_id, page_no, quality_code, ocr_mode, ocr_mode IS NOT NULL AS has_reason, n_reasons::BIGINT AS n_reasons FROM t4"


def quality_summary_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = pages.decide(measured(spark, sf_dir))
    return decided.groupBy("source").agg(
        F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.count_if(F.col("ocr_mode") == "replace").alias("replace"), F.count_if(F.col("ocr_mode") == "supplement").alias("supplement"),
        F.count_if(F.col("quality_code") == "no_text").alias("no_text"), F.count_if(F.col("quality_code") == "garbled").alias("garbled"), F.count_if(F.col("quality_code") == "short").alias("short"),
    )


SUMMARY = f"""WITH {MEASURED} SELECT source, count(*) AS pages, sum(chars)::BIGINT AS chars, count(*) FILTER (WHERE ocr_mode = 'replace') AS replace, count(*) FILTER (WHERE ocr_mode = 'supplement') AS supplement,
count(*) FILTER (WHERE quality_code = 'no_text') AS no_text, count(*) FILTER (WHERE quality_code = 'garbled') AS garbled, count(*) FILTER (WHERE quality_code = 'short') AS short FROM t4 GROUP BY source"""


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.assemble(pages.decide(measured(spark, sf_dir)))
    return found.select("doc_id", "page_no", "method", "blank", "low_confidence", "complex_content", F.size("warnings").cast("long").alias("n_warnings"), F.size("notes").cast("long").alias("n_notes"), "needs_review", "is_problem")


RESULTS = f"""WITH {MEASURED}, r AS (SELECT doc_id, page_no, CASE WHEN failed THEN 'FAILED' ELSE 'DIRECT' END AS method, NOT failed AND chars = 0 AND ocr_mode IS NULL AS blank, NOT failed AND coalesce(ocr_mode = 'replace', false) AS low_confidence,
n_reasons > 0 AS complex_content, failed::INT + (NOT failed AND ocr_mode IS NOT NULL)::INT + (n_reasons > 0)::INT + jumps::INT AS n_warnings,
(NOT failed AND chars = 0 AND ocr_mode IS NULL)::INT + (NOT failed AND k % 8 = 0)::INT + (NOT failed AND length(text) - length(translate(text, '{C.MATH_SIGNS}', '')) >= 3)::INT AS n_notes, ocr_mode FROM t4)
SELECT doc_id, page_no, method, blank, low_confidence, complex_content, n_warnings::BIGINT AS n_warnings, n_notes::BIGINT AS n_notes, n_warnings > 0 AS needs_review, n_warnings > 0 OR ocr_mode IS NOT NULL AS is_problem FROM r"""


# ---- cards


def card_values(spark: SparkSession, sf_dir: str, deck: Column | str = "p_size") -> DataFrame:
    """(deck_id, number, question, answer, o: options) from parts, with faults by rule."""
    p = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select("*", F.row_number().over(Window.partitionBy(deck).orderBy("p_partkey")).alias("number"), (F.col(deck) if isinstance(deck, str) else deck).cast("string").alias("deck_id"))
    fourth = F.when(p % 17 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit("\t"), F.lit('"'), "p_partkey"))
    options = F.when(p % 10 == 0, F.array(*map(F.lit, ("w", "x", "y", "z")))).when(p % 19 == 0, F.array("p_name", "p_brand", "p_type")).otherwise(F.array("p_name", "p_brand", "p_type", fourth))
    question = F.when(p % 11 == 0, "  ").when(p % 13 == 0, "<b></b>").when(p % 29 == 0, "TODO").when(p % 5 == 0, F.concat(F.lit("Same <i>question</i> "), (p % 15).cast("string"))).otherwise(F.concat_ws(" ", F.lit("#"), "p_type", "p_brand", (p % 40).cast("string")))
    rows = base.select("deck_id", "number", p.alias("p"), "p_name", question.alias("question"), options.alias("o"))
    answer = F.when(F.col("p") % 23 == 0, "nothing").when((F.col("p") % 7 == 0) & (F.col("p") % 10 != 0), F.upper("p_name")).otherwise(F.get("o", (F.col("p") % 3).cast("int")))
    return rows.select("deck_id", "number", "question", answer.alias("answer"), "o")


CARDS = """c0 AS (SELECT p_size::VARCHAR AS deck_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS number, p_partkey AS p, p_name,
  CASE WHEN p_partkey % 11 = 0 THEN '  ' WHEN p_partkey % 13 = 0 THEN '<b></b>' WHEN p_partkey % 29 = 0 THEN 'TODO' WHEN p_partkey % 5 = 0 THEN 'Same <i>question</i> ' || (p_partkey % 15) ELSE '# ' || p_type || ' ' || p_brand || ' ' || (p_partkey % 40) END AS question,
  CASE WHEN p_partkey % 10 = 0 THEN ['w', 'x', 'y', 'z'] WHEN p_partkey % 19 = 0 THEN [p_name, p_brand, p_type]
    ELSE [p_name, p_brand, p_type, CASE WHEN p_partkey % 17 = 0 THEN upper(p_brand) ELSE 'size ' || p_size || chr(9) || '"' || p_partkey END] END AS o FROM part),
c1 AS (SELECT *, CASE WHEN p % 23 = 0 THEN 'nothing' WHEN p % 7 = 0 AND p % 10 <> 0 THEN upper(p_name) ELSE o[(p % 3)::INT + 1] END AS answer,
  trim(regexp_replace(question, '<[^>]*>', '', 'g'), ' ') AS shown, list_transform(o, lambda x: lower(x)) AS n FROM c0),
c2 AS (SELECT *, lower(shown) AS nq, lower(answer) AS na, len(o) = 4 AS four, len(list_distinct(n)) = len(n) AS apart FROM c1),
c3 AS (SELECT *, CASE WHEN trim(question) = '' THEN 'empty' WHEN shown = '' THEN 'html_only' WHEN nq = 'todo' THEN 'placeholder' END AS e1,
  CASE WHEN NOT four THEN 'options_count' WHEN NOT apart THEN 'option_twin' WHEN list_contains(o, answer) THEN NULL WHEN list_contains(n, na) THEN 'answer_near' ELSE 'answer_absent' END AS e2 FROM c2),
c4 AS (SELECT *, e1 IS NULL AND e2 IS NULL AS sound, nq || '|' || na || '|' || array_to_string(list_sort(n), '|') AS ck FROM c3),
c5 AS (SELECT *, CASE WHEN sound THEN min(CASE WHEN sound THEN number END) OVER (PARTITION BY deck_id, ck) END AS lead FROM c4),
c6 AS (SELECT *, CASE WHEN lead < number THEN lead END AS duplicate_of, sound AND lead = number AS valid FROM c5),
c7 AS (SELECT *, CASE WHEN valid THEN min(CASE WHEN valid THEN number END) OVER (PARTITION BY deck_id, nq) END AS g, count(CASE WHEN valid THEN 1 END) OVER (PARTITION BY deck_id, nq) AS gn FROM c6),
cards AS (SELECT *, CASE WHEN valid AND gn > 1 THEN g END AS question_group, ['A', 'B', 'C', 'D'][list_position(o, answer)] AS letter FROM c7)"""


def card_rows(spark: SparkSession, sf_dir: str, deck: Column | str = "p_size") -> DataFrame:
    """The same as parsed cards."""

    def field(value: Column) -> Column:
        quoted = F.concat(F.lit("'"), value, F.lit("'"))
        whole = lambda seen: F.struct(F.lit("str").alias("py_type"), value.alias("value"), quoted.alias("repr"), seen.alias("visible"), folded(seen).alias("norm"), quoted.alias("shown"), F.array().cast("array<string>").alias("tags"))
        return X.let(markup.visible_text(value), whole)

    keys = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(f"'{k}'").alias("repr"), F.lit(None).cast("string").alias("hint")) for k in C.REQUIRED))
    items = F.struct(F.lit("list").alias("py_type"), F.transform("o", field).alias("items"))
    empty = field(F.lit(None).cast("string"))
    return card_values(spark, sf_dir, deck).select(
        "deck_id", F.lit("Python").alias("format"), F.array().cast("array<string>").alias("notes"), F.lit(None).cast("string").alias("error"), "number", F.lit("dict").alias("py_type"), F.concat(F.lit("question: "), "question").alias("label"),
        keys.alias("keys"), field(F.col("question")).alias("question"), field(F.col("answer")).alias("answer"), F.when(F.lit(False), empty).alias("explanation"), items.alias("options"),
    )


def validation_digest(validated: DataFrame) -> DataFrame:
    codes = lambda c: F.array_join(F.transform(c, lambda e: e["code"]), ",")
    return validated.select("deck_id", F.col("number").cast("long").alias("number"), codes("errors").alias("errors"), codes("warnings").alias("warnings"), F.col("duplicate_of").cast("long").alias("duplicate_of"), F.col("question_group").cast("long").alias("question_group"), "valid")


def card_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_digest(cards.validate(card_rows(spark, sf_dir)))


VALIDATE = f"""WITH {CARDS} SELECT deck_id, number, array_to_string(list_filter([e1, e2], lambda x: x IS NOT NULL), ',') AS errors, CASE WHEN question_group < number THEN 'same_question' ELSE '' END AS warnings,
duplicate_of, question_group, valid FROM cards"""


def deck_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks written as files of JSON, read by the deck source and validated: the whole path of a file."""
    values = card_values(spark, sf_dir)
    card = F.concat(F.when(F.col("number") > 1, ",\n").otherwise(""), F.to_json(F.struct("question", "answer", F.col("o").alias("options"))))
    ends = values.groupBy("deck_id").agg((F.max("number") + 1).alias("last"))
    pieces = values.select("deck_id", "number", card.alias("piece")).unionAll(ends.select("deck_id", F.lit(0), F.lit("```json\n["))).unionAll(ends.select("deck_id", "last", F.lit("]\n```")))
    files.save(pieces, folder := scratch(spark, "decks"), name=files.file_name(F.col("deck_id"), ".json"), order=["number"])
    return validation_digest(cards.validate(deck_source.load(spark, folder, ids="name", glob="*.json")))


def question_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.question_groups(cards.validate(card_rows(spark, sf_dir)))
    return found.select("deck_id", F.col("first").cast("long").alias("first"), F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"))


QUESTION_GROUPS = f"WITH {CARDS} SELECT deck_id, question_group AS first, string_agg(number::VARCHAR, ',' ORDER BY number) AS numbers FROM cards WHERE question_group IS NOT NULL GROUP BY 1, 2"


def deck_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.deck_summary(cards.validate(card_rows(spark, sf_dir)))


DECK_SUMMARY = f"""WITH {CARDS} SELECT deck_id, count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT sound) AS invalid, count(duplicate_of) AS duplicates,
count(*) FILTER (WHERE question_group < number) AS duplicate_questions FROM cards GROUP BY deck_id"""


def answer_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.export_rows(cards.validate(card_rows(spark, sf_dir))).select("deck_id", F.col("number").cast("long").alias("number"), "CorrectAnswer", "CorrectLetter")


LETTER = f'WITH {CARDS} SELECT deck_id, number, answer AS "CorrectAnswer", letter AS "CorrectLetter" FROM cards WHERE valid'


def answer_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.distribution(cards.export_rows(cards.validate(card_rows(spark, sf_dir))))
    return found.select("deck_id", F.col("A").alias("n_a"), F.col("B").alias("n_b"), F.col("C").alias("n_c"), F.col("D").alias("n_d"), "total", F.round("chi2", 9).alias("chi2"), "unbalanced", "most", "least")


DISTRIBUTION = f"""WITH {CARDS}, d AS (SELECT deck_id, count(*) FILTER (WHERE letter = 'A') AS n_a, count(*) FILTER (WHERE letter = 'B') AS n_b, count(*) FILTER (WHERE letter = 'C') AS n_c, count(*) FILTER (WHERE letter = 'D') AS n_d, count(*) AS total
  FROM cards WHERE valid GROUP BY deck_id), e AS (SELECT *, CASE WHEN total >= 8 THEN (power(n_a - total / 4.0::DOUBLE, 2) + power(n_b - total / 4.0::DOUBLE, 2) + power(n_c - total / 4.0::DOUBLE, 2) + power(n_d - total / 4.0::DOUBLE, 2)) / (total / 4.0::DOUBLE) END AS x FROM d)
SELECT deck_id, n_a, n_b, n_c, n_d, total, round(x, 9) AS chi2, coalesce(x > {C.CHI2_CRITICAL}, false) AS unbalanced,
CASE greatest(n_a, n_b, n_c, n_d) WHEN n_a THEN 'A' WHEN n_b THEN 'B' WHEN n_c THEN 'C' ELSE 'D' END AS most, CASE least(n_a, n_b, n_c, n_d) WHEN n_a THEN 'A' WHEN n_b THEN 'B' WHEN n_c THEN 'C' ELSE 'D' END AS least FROM e"""


def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.export_rows(cards.validate(card_rows(spark, sf_dir))).select("deck_id", F.col("number").cast("long").alias("number"), tsv_line().alias("line"))


TSV_FIELD = "CASE WHEN contains({0}, chr(9)) OR contains({0}, '\"') OR starts_with({0}, '#') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
TSV = f"WITH {CARDS} SELECT deck_id, number, concat_ws(chr(9), {', '.join(TSV_FIELD.format(x) for x in ('question', 'o[1]', 'o[2]', 'o[3]', 'o[4]', 'answer', 'letter'))}, '') AS line FROM cards WHERE valid"


def letter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    options = F.array(*(F.concat(F.element_at(F.array(*map(F.lit, ("A. ", "(b) ", "c", "", " D: "))), ((p + i) % 5 + 1).cast("int")), F.col(c).cast("string")) for i, c in enumerate(("p_name", "p_brand", "p_type", "p_size"))))
    labelled = cards.labelled_letters(options)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(labelled, "").alias("labelled"), (F.size(labelled) >= 2).alias("warn"))


LABELS = r"""WITH a AS (SELECT p_partkey, [['A. ', '(b) ', 'c', '', ' D: '][((p_partkey + 0) % 5 + 1)::INT] || p_name, ['A. ', '(b) ', 'c', '', ' D: '][((p_partkey + 1) % 5 + 1)::INT] || p_brand, ['A. ', '(b) ', 'c', '', ' D: '][((p_partkey + 2) % 5 + 1)::INT] || p_type,
['A. ', '(b) ', 'c', '', ' D: '][((p_partkey + 3) % 5 + 1)::INT] || p_size] AS o FROM part), b AS (SELECT p_partkey, list_filter(['A', 'B', 'C', 'D'], lambda x, i: regexp_matches(o[i], '^\s*(?:\(?[A-Da-d]\)|[A-Da-d][.:)])\s+')) AS l FROM a)
SELECT p_partkey, array_to_string(l, '') AS labelled, len(l) >= 2 AS warn FROM b"""


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.stable_id(F.concat(F.lit("deck:"), "c_name")).alias("stable_id"))


IDS = "SELECT c_custkey, 1073741824 + ('0x' || substr(sha256('deck:' || c_name), 1, 12))::BIGINT % 1073741824 AS stable_id FROM customer"


def option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a shuffle puts each option, and the answer's new letter."""
    rows = cards.export_rows(cards.validate(card_rows(spark, sf_dir)), seed=42)
    return rows.select("deck_id", F.col("number").cast("long").alias("number"), F.concat_ws("|", *(f"Option{x}" for x in C.LETTERS)).alias("options"), "CorrectAnswer", "CorrectLetter")


SHUFFLED = "s0 AS (SELECT *, list_sort(list_transform([1, 2, 3, 4], lambda i: {'k': sha256('42:' || deck_id || ':' || number || ':' || (i - 1)), 'o': o[i]})) AS h FROM cards WHERE valid), s1 AS (SELECT *, list_transform(h, lambda x: x.o) AS mixed FROM s0)"
SHUFFLE = f"""WITH {CARDS}, {SHUFFLED} SELECT deck_id, number, array_to_string(mixed, '|') AS options, answer AS "CorrectAnswer", ['A', 'B', 'C', 'D'][list_position(mixed, answer)] AS "CorrectLetter" FROM s1"""


def option_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by draws from one generator through the cards of each deck."""
    rows = cards.export_rows(cards.validate(card_rows(spark, sf_dir)), seed=42, drawn=True)
    return rows.select("deck_id", F.col("number").cast("long").alias("number"), F.concat_ws("|", *(f"Option{x}" for x in C.LETTERS)).alias("options"), "CorrectAnswer", "CorrectLetter")


def swapped(options: str, i: int, j: str) -> str:
    """SQL for a list of four with the places i and j (from 1) exchanged."""
    return f"list_transform([1, 2, 3, 4], lambda k: CASE WHEN k = {i} THEN {options}[{j}] WHEN k = {j} THEN {options}[{i}] ELSE {options}[k] END)"


#: The generator from its definition: a state of 624 words from the seed, 227 new words a step, each tempered.
DRAWN = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY number) AS rank FROM cards WHERE valid),
g0(i, v) AS (SELECT 0::BIGINT, 19650218::BIGINT UNION ALL SELECT i + 1, (1812433253 * xor(v, v >> 30) + i + 1) % 4294967296 FROM g0 WHERE i < 623),
g1(k, v, first) AS (SELECT -1::BIGINT, v, NULL::BIGINT FROM g0 WHERE i = 0
  UNION ALL SELECT g1.k + 1, (xor(CASE WHEN g1.k = 622 THEN g1.first ELSE g0.v END, xor(g1.v, g1.v >> 30) * 1664525) + 42) % 4294967296 AS n, CASE WHEN g1.k = -1 THEN (xor(g0.v, xor(g1.v, g1.v >> 30) * 1664525) + 42) % 4294967296 ELSE g1.first END
  FROM g1 JOIN g0 ON g0.i = CASE WHEN g1.k = 622 THEN 1 ELSE g1.k + 2 END WHERE g1.k < 623),
m1 AS (SELECT k + 1 AS i, v FROM g1 WHERE k BETWEEN 1 AND 622 UNION ALL SELECT 1, v FROM g1 WHERE k = 623),
g2(k, v) AS (SELECT -1::BIGINT, v FROM m1 WHERE i = 1
  UNION ALL SELECT g2.k + 1, (xor(m1.v, xor(g2.v, g2.v >> 30) * 1566083941) - m1.i + 4294967296) % 4294967296 FROM g2 JOIN m1 ON m1.i = CASE WHEN g2.k = 621 THEN 1 ELSE g2.k + 3 END WHERE g2.k < 622),
seeded AS (SELECT list(v ORDER BY i) AS s FROM (SELECT 0 AS i, 2147483648 AS v UNION ALL SELECT CASE WHEN k = 622 THEN 1 ELSE k + 2 END, v FROM g2 WHERE k >= 0)),
steps(b, s, made) AS (SELECT 0::BIGINT, s, []::BIGINT[] FROM seeded
  UNION ALL SELECT b + 1, list_concat(s[228:], n), n FROM (SELECT b, s, list_transform(range(1, 228), lambda k: xor(xor(s[k + 397], ((s[k] & 2147483648) | (s[k + 1] & 2147483647)) >> 1), (s[k + 1] & 1) * 2567483615)) AS n
    FROM steps WHERE b < (SELECT max(rank) * 16 // 227 + 3 FROM ranked))),
t0 AS (SELECT (b - 1) * 227 + generate_subscripts(made, 1) AS n, unnest(made) AS v FROM steps WHERE b > 0), t1 AS (SELECT n, xor(v, v >> 11) AS v FROM t0), t2 AS (SELECT n, xor(v, (v << 7) & 2636928640) AS v FROM t1), t3 AS (SELECT n, xor(v, (v << 15) & 4022730752) AS v FROM t2),
words AS (SELECT n, xor(v, v >> 18) AS v FROM t3),
draws(n, rank, below, hit) AS (SELECT 0::BIGINT, 1::BIGINT, 4::BIGINT, NULL::STRUCT(rank BIGINT, below BIGINT, r BIGINT)
  UNION ALL SELECT n, CASE WHEN r < below AND below = 2 THEN rank + 1 ELSE rank END, CASE WHEN r >= below THEN below WHEN below = 2 THEN 4 ELSE below - 1 END, CASE WHEN r < below THEN {{'rank': rank, 'below': below, 'r': r}} END
    FROM (SELECT w.n, d.rank, d.below, CASE WHEN d.below = 4 THEN w.v >> 29 ELSE w.v >> 30 END AS r FROM draws d JOIN words w ON w.n = d.n + 1 WHERE d.rank <= (SELECT max(rank) FROM ranked))),
places AS (SELECT hit.rank AS rank, max(hit.r + 1) FILTER (WHERE hit.below = 4) AS j4, max(hit.r + 1) FILTER (WHERE hit.below = 3) AS j3, max(hit.r + 1) FILTER (WHERE hit.below = 2) AS j2 FROM draws WHERE hit IS NOT NULL GROUP BY 1),
d0 AS (SELECT *, {swapped('o', 4, 'j4')} AS o4 FROM ranked JOIN places USING (rank)), d1 AS (SELECT *, {swapped('o4', 3, 'j3')} AS o3 FROM d0), d2 AS (SELECT *, {swapped('o3', 2, 'j2')} AS mixed FROM d1)"""
OPTION_DRAWS = f"""WITH RECURSIVE {CARDS}, {DRAWN} SELECT deck_id, number, array_to_string(mixed, '|') AS options, answer AS "CorrectAnswer", ['A', 'B', 'C', 'D'][list_position(mixed, answer)] AS "CorrectLetter" FROM d2"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(".v1.txt"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.stem(path).alias("stem"), X.deck_title(path).alias("title"), X.zero_padded(F.col("c_custkey") % 2000, F.lit(1999)).alias("padded"))


NAMES = "SELECT c_custkey, replace(c_name, '#', '_') || '.v1' AS stem, replace(c_name, '#', ' ') || '.v1' AS title, lpad((c_custkey % 2000)::VARCHAR, 4, '0') AS padded FROM customer"

# ---- single figures of the operators above, and what SQL has no words for


def math_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = F.replace(F.coalesce("text", F.lit("")), F.lit("on"), F.lit("∑"))
    return table(spark, sf_dir, "documents").select("doc_id", X.count_math(signs).cast("long").alias("n"), (X.count_math(signs) >= C.MATH_LEAST).alias("has_math"))


MATH = "WITH a AS (SELECT doc_id, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'on', ''))) // 2 AS n FROM documents) SELECT doc_id, n, n >= 3 AS has_math FROM a"


def card_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cards.validate(card_rows(spark, sf_dir)).where(F.col("duplicate_of").isNotNull())
    return found.select("deck_id", F.col("number").cast("long").alias("number"), F.col("duplicate_of").cast("long").alias("duplicate_of"))


CARD_DEDUP = f"WITH {CARDS} SELECT deck_id, number, duplicate_of FROM cards WHERE duplicate_of IS NOT NULL"


def answer_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square of counted letters, and whether it is beyond the critical value."""
    letter = F.element_at(F.array(*map(F.lit, C.LETTERS)), ((F.col("l_linenumber") * F.col("l_suppkey")) % 5 % 4 + 1).cast("int"))
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("deck_id")).agg(*(F.count_if(letter == x).alias(x) for x in C.LETTERS), F.count("*").alias("total"))
    return cards.with_chi2(counts).select("deck_id", "total", F.round("chi2", 7).alias("chi2"), "unbalanced")


CHI2 = f"""WITH a AS (SELECT l_suppkey AS deck_id, (l_linenumber * l_suppkey) % 5 % 4 AS x FROM lineitem), b AS (SELECT deck_id, count(*) AS total, sum((x = 0)::INT) AS p, sum((x = 1)::INT) AS q, sum((x = 2)::INT) AS r, sum((x = 3)::INT) AS s FROM a GROUP BY 1),
c AS (SELECT deck_id, total, CASE WHEN total >= 8 THEN (power(p - total / 4.0::DOUBLE, 2) + power(q - total / 4.0::DOUBLE, 2) + power(r - total / 4.0::DOUBLE, 2) + power(s - total / 4.0::DOUBLE, 2)) / (total / 4.0::DOUBLE) END AS v FROM b)
SELECT deck_id, total, round(v, 7) AS chi2, coalesce(v > {C.CHI2_CRITICAL}, false) AS unbalanced FROM c"""


def most_least_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most and least frequent letter, the earliest of equally frequent ones."""
    n = lambda i: (F.col("c_custkey") * (i + 3) % 5).alias(C.LETTERS[i])
    counts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("deck_id"), *(n(i) for i in range(4)))
    return cards.with_chi2(counts.withColumn("total", sum(F.col(x) for x in C.LETTERS))).select("deck_id", "most", "least")


MOST = """WITH a AS (SELECT c_custkey AS deck_id, c_custkey * 3 % 5 AS p, c_custkey * 4 % 5 AS q, c_custkey * 5 % 5 AS r, c_custkey * 6 % 5 AS s FROM customer)
SELECT deck_id, CASE greatest(p, q, r, s) WHEN p THEN 'A' WHEN q THEN 'B' WHEN r THEN 'C' ELSE 'D' END AS most, CASE least(p, q, r, s) WHEN p THEN 'A' WHEN q THEN 'B' WHEN r THEN 'C' ELSE 'D' END AS least FROM a"""


SQL = {
    "text_clean": TEXT_CLEAN, "text_metrics": TEXT_METRICS, "visible_text": VISIBLE, "html_unknown_tags": UNKNOWN, "doc_normalized_dedup": DEDUP, "duplicate_groups": GROUPS, "page_ranges_rows": RANGES,
    "page_ranges_array": RANGES, "ocr_regroup": OCR, "block_median": MEDIAN, "two_column": COLUMNS, "order_jumps": JUMPS, "order_jumps_array": JUMPS, "image_coverage": COVERAGE, "ink_histogram_mode": MODE, "ink_ratios": INK,
    "quality_decision": DECISION, "quality_summary_by_source": SUMMARY, "page_results": RESULTS, "card_validate": VALIDATE, "deck_parse_json": VALIDATE, "question_groups": QUESTION_GROUPS,
    "deck_summary": DECK_SUMMARY, "answer_letter": LETTER, "answer_distribution": DISTRIBUTION, "tsv_rows": TSV, "letter_labels": LABELS, "stable_ids": IDS, "option_shuffle": SHUFFLE, "option_draws": OPTION_DRAWS, "file_names": NAMES,
    "math_count": MATH, "card_dedup": CARD_DEDUP, "answer_chi2": CHI2, "most_least_letter": MOST,
}
