"""Queries of the text, ingestion and frequency operators, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators.statistics import global_row_number
from lexmill.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fill(template: str, *values: str) -> str:
    for i, value in enumerate(values):
        template = template.replace(f"{{{i}}}", value)
    return template


_WS = r"[\s\x{3000}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{1680}\x{85}\x{1c}-\x{1f}\x{0b}]"
_CLEAN = "trim(regexp_replace({0}, '" + _WS + "+', ' ', 'g'), ' ')"
_STRIP = "regexp_replace({0}, '^" + _WS + "+|" + _WS + "+$', '', 'g')"


@query(f"SELECT doc_id, {fill(_CLEAN, 'text')} AS cleaned, CAST(length({fill(_CLEAN, 'text')}) AS BIGINT) AS n FROM documents")
def text_clean(spark, root):
    c = t.clean(F.col("text"))
    return table(spark, root, "documents").select("doc_id", c.alias("cleaned"), F.length(c).cast("bigint").alias("n"))


_LAYOUT = fill(_STRIP, "regexp_replace(regexp_replace({0}, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT file_id, received_at, {fill(_LAYOUT, 'text')} AS layout FROM extracted_docs")
def text_layout_normalize(spark, root):
    return table(spark, root, "extracted_docs").select("file_id", "received_at", t.layout(F.col("text")).alias("layout"))


_SENT = "list_filter(string_split(regexp_replace({0}, '([。！？])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"


@query(f"SELECT chunk_id, ingested_at, CAST(len({fill(_SENT, 'content')}) AS BIGINT) AS n_sentences, CAST(list_max(list_transform({fill(_SENT, 'content')}, lambda s: length(s))) AS BIGINT) AS longest FROM judgement_chunks")
def sentence_split(spark, root):
    s = t.sentences(F.col("content"))
    return table(spark, root, "judgement_chunks").select("chunk_id", "ingested_at", F.size(s).cast("bigint").alias("n_sentences"), F.array_max(F.transform(s, F.length)).cast("bigint").alias("longest"))


@query(f"""
WITH RECURSIVE d AS (SELECT DISTINCT chunk_id, content FROM judgement_chunks WHERE content IS NOT NULL AND length(content) > 800),
 s AS (SELECT chunk_id, md5(content) AS h, {fill(_SENT, 'content')} AS parts FROM d),
 f(chunk_id, h, parts, i, buf, out) AS (
  SELECT chunk_id, h, parts, 1, '', CAST([] AS VARCHAR[]) FROM s
  UNION ALL
  SELECT chunk_id, h, parts, i + 1,
   CASE WHEN length(buf) + length(parts[i]) > 800 AND buf <> '' THEN parts[i] ELSE buf || parts[i] END,
   CASE WHEN length(buf) + length(parts[i]) > 800 AND buf <> '' THEN list_append(out, buf) ELSE out END
  FROM f WHERE i <= len(parts)),
 e AS (SELECT chunk_id, h, list_filter(list_transform(list_append(out, buf), lambda x: {fill(_STRIP, 'x')}), lambda x: x <> '') AS pieces FROM f WHERE i = len(parts) + 1)
SELECT chunk_id, h AS text_hash, CAST(len(pieces) AS BIGINT) AS n_pieces, CAST(list_max(list_transform(pieces, lambda x: length(x))) AS BIGINT) AS longest, pieces[1] AS first_piece FROM e""")
def chunk_pack(spark, root):
    rows = table(spark, root, "judgement_chunks").where(F.length("content") > 800).select("chunk_id", "content").distinct()
    p = rows.withColumn("p", t.section_chunks(F.col("content")))
    return p.select("chunk_id", F.md5("content").alias("text_hash"), F.size("p").cast("bigint").alias("n_pieces"), F.array_max(F.transform("p", F.length)).cast("bigint").alias("longest"), F.get("p", F.lit(0)).alias("first_piece"))


@query(f"""
WITH p AS (SELECT file_id, received_at, list_filter(list_transform(string_split({fill(_LAYOUT, 'text')}, chr(10) || chr(10)), lambda x: {fill(_STRIP, 'x')}), lambda x: x <> '') AS ps FROM extracted_docs WHERE text IS NOT NULL)
SELECT file_id, received_at, CAST(len(ps) AS BIGINT) AS n_paragraphs, CAST(coalesce(list_max(list_transform(ps, lambda x: length(x))), 0) AS BIGINT) AS longest FROM p""")
def paragraph_split(spark, root):
    parts = F.filter(F.transform(F.split(t.layout(F.col("text")), "\n\n"), t.strip), lambda p: p != "")
    rows = table(spark, root, "extracted_docs").where("text is not null").withColumn("ps", parts)
    return rows.select("file_id", "received_at", F.size("ps").cast("bigint").alias("n_paragraphs"), F.coalesce(F.array_max(F.transform("ps", F.length)), F.lit(0)).cast("bigint").alias("longest"))


@query()
def paragraph_pack(spark, root):
    """Paragraphs with long ones packed by sentence: number and longest per file (tested against a plain version)."""
    rows = table(spark, root, "extracted_docs").where("text is not null").withColumn("ps", t.paragraphs(F.col("text")))
    return rows.select("file_id", "received_at", F.size("ps").alias("n_pieces"), F.array_max(F.transform("ps", F.length)).alias("longest"))


@query(f"""
WITH h AS (SELECT doc_id, text, unnest([('主文', '主\\s*文'), ('事實', '事\\s*實(?:及理由)?'), ('理由', '(?:理\\s*由|得心證之理由)')]) AS p FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, text, p[1] AS label, strpos(text, regexp_extract(text, p[2])) AS pos FROM h WHERE regexp_matches(text, p[2])),
 e AS (SELECT doc_id, label, pos, {fill(_CLEAN, "substr(text, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, label), length(text) + 1) - pos)")} AS body FROM s),
 w AS (SELECT doc_id, '全文' AS label, {fill(_CLEAN, 'text')} AS body FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id))
SELECT doc_id, label, CAST(length(body) AS BIGINT) AS n, md5(body) AS body_hash FROM e UNION ALL SELECT doc_id, label, CAST(length(body) AS BIGINT), md5(body) FROM w""")
def section_split(spark, root):
    rows = spread(table(spark, root, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", F.explode(t.sections(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.label", F.length("s.body").cast("bigint").alias("n"), F.md5("s.body").alias("body_hash"))


_LABEL = t.CLAUSE_LABEL.replace("　", "\\x{3000}")


@query(f"""
WITH d AS (SELECT file_id, received_at, {fill(_LAYOUT, 'text')} AS x FROM extracted_docs WHERE text IS NOT NULL),
 s AS (SELECT file_id, received_at, regexp_extract_all(x, '{_LABEL}') AS labels, string_split(regexp_replace(x, '({_LABEL})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM d),
 u AS (SELECT file_id, received_at, unnest(range(1, len(labels) + 1)) AS i, labels, parts FROM s),
 b AS (SELECT file_id, received_at, i, labels[i] AS label, regexp_replace(substr(parts[i + 1], length(labels[i]) + 1), '^[ \\n\\x{{3000}}：:]+|[ \\n\\x{{3000}}：:]+$', '', 'g') AS body, list_sum(list_transform(parts[1:i], lambda p: length(p))) AS pos FROM u)
SELECT file_id, received_at, label, CAST(pos AS BIGINT) AS char_at, CAST(length(body) AS BIGINT) AS n, md5(body) AS body_hash FROM b WHERE length(body) >= 10""")
def clause_split(spark, root):
    rows = spread(table(spark, root, "extracted_docs").where("text is not null").select("file_id", "received_at", "text")).select("file_id", "received_at", F.explode(t.clauses(F.col("text"))).alias("c"))
    return rows.select("file_id", "received_at", "c.label", F.col("c.at").cast("bigint").alias("char_at"), F.length("c.body").cast("bigint").alias("n"), F.md5("c.body").alias("body_hash"))


@query()
def clause_smart_split(spark, root):
    """By clause labels, or by paragraphs where there are fewer than three clauses: strategy and number of parts per file."""
    rows = table(spark, root, "extracted_docs").where("text is not null").withColumn("c", t.clauses(F.col("text")))
    few = F.size("c") < 3
    return rows.select("file_id", "received_at", F.when(few, "paragraph").otherwise("clause").alias("strategy"), F.when(few, F.size(t.paragraphs(F.col("text")))).otherwise(F.size("c")).alias("n_parts"))


_D = "translate({0}, '〇○零一二三四五六七八九０１２３４５６７８９', '0001234567890123456789')"
_UNIT = "coalesce(CASE WHEN regexp_extract({0}, '([0-9]?){1}', 0) = '' THEN 0 WHEN regexp_extract({0}, '([0-9]?){1}', 1) = '' THEN {2} ELSE CAST(regexp_extract({0}, '([0-9]?){1}', 1) AS BIGINT) * {2} END, 0)"


def _number(c: str) -> str:
    d = fill(_D, c)
    parts = " + ".join(fill(_UNIT, d, u, str(n)) for u, n in (("千", 1000), ("百", 100), ("十", 10)))
    last = f"coalesce(TRY_CAST(nullif(regexp_extract({d}, '([0-9])$', 1), '') AS BIGINT), 0)"
    return f"CASE WHEN regexp_matches({d}, '^[0-9]+$') THEN CAST(CAST({d} AS BIGINT) AS VARCHAR) WHEN regexp_matches({d}, '^[0-9十百千]+$') THEN CAST({parts} + {last} AS VARCHAR) END"


_ART = t.ARTICLE.replace("　", "\\x{3000}").replace("－", "\\x{ff0d}")
_ARTICLES = f"""
 u AS (SELECT *, unnest(regexp_extract_all(body, '{_ART}')) AS hit FROM src),
 g AS (SELECT *, regexp_extract(hit, '{_ART}', 1) AS law, regexp_extract(hit, '{_ART}', 2) AS n, regexp_extract(hit, '{_ART}', 3) AS m, regexp_extract(hit, '{_ART}', 4) AS k FROM u),
 a AS (SELECT *, law || '第' || ({_number('n')}) || coalesce('-' || ({_number("CASE WHEN m <> '' THEN m WHEN k <> '' THEN k END")}), '') || '條' AS article FROM g WHERE law <> '')"""


@query(f"WITH src AS (SELECT DISTINCT chunk_id, content AS body FROM judgement_chunks WHERE content IS NOT NULL), {_ARTICLES} SELECT DISTINCT chunk_id, article FROM a WHERE article IS NOT NULL")
def article_canonical(spark, root):
    rows = table(spark, root, "judgement_chunks").where("content is not null").select("chunk_id", F.explode(t.article_list(F.col("content"))).alias("article"))
    return rows.distinct()


@query(f"WITH src AS (SELECT DISTINCT chunk_id, content AS body FROM judgement_chunks WHERE content IS NOT NULL), {_ARTICLES} SELECT DISTINCT chunk_id, regexp_replace(article, '^(.*)第([0-9-]+)條$', '\\1__第_\\2_條') AS article_key FROM a WHERE article IS NOT NULL AND article NOT IN ({', '.join(repr(f'民法第{n}條') for n in t.BOILERPLATE_NUMBERS)})")
def article_keys(spark, root):
    """Id-form keys of the articles a chunk cites, without the boilerplate ones."""
    rows = table(spark, root, "judgement_chunks").where("content is not null").select("chunk_id", F.explode(t.article_list(F.col("content"))).alias("a")).where(~t.is_boilerplate(F.col("a")))
    return rows.select("chunk_id", t.article_key(F.col("a")).alias("article_key")).distinct()


@query(f"WITH v AS (SELECT DISTINCT x, regexp_extract(x, '第[ \\x{{3000}}]*({t.NUMERAL})', 1) AS tok FROM (SELECT unnest(cited_articles) AS x FROM clause_analyses)) SELECT DISTINCT tok, {_number('tok')} AS number FROM v WHERE tok <> ''")
def cn_numeral(spark, root):
    rows = table(spark, root, "clause_analyses").select(F.explode("cited_articles").alias("x")).select(F.regexp_extract("x", f"第[ 　]*({t.NUMERAL})", 1).alias("tok")).where("tok <> ''").distinct()
    return rows.select("tok", t.numeral(F.col("tok")).alias("number"))


def _pii(c):
    for pattern, mask in t.PII:
        c = f"regexp_replace({c}, '{pattern}', '{mask}', 'g')"
    return c


@query(f"SELECT doc_id, {_pii('text')} AS masked, {_pii('text')} <> text AS changed FROM documents")
def pii_mask(spark, root):
    m = t.mask_pii(F.col("text"))
    return table(spark, root, "documents").select("doc_id", m.alias("masked"), (m != F.col("text")).alias("changed"))


_DATE0 = "trim(translate(coalesce(case_date, ''), '/.', '--'), ' ')"
_DATE = f"CASE WHEN regexp_matches({_DATE0}, '^[0-9]{{7}}$') THEN lpad(CAST(TRY_CAST(substr({_DATE0}, 1, 3) AS INTEGER) + 1911 AS VARCHAR), 4, '0') || '-' || substr({_DATE0}, 4, 2) || '-' || substr({_DATE0}, 6, 2) WHEN regexp_matches({_DATE0}, '^[0-9]{{8}}$') THEN substr({_DATE0}, 1, 4) || '-' || substr({_DATE0}, 5, 2) || '-' || substr({_DATE0}, 7, 2) ELSE {_DATE0} END"
_MONTH = f"CASE WHEN regexp_matches({_DATE}, '^[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?$') THEN substr({_DATE}, 1, 7) ELSE 'unknown' END"


@query(f"SELECT chunk_id, ingested_at, {_DATE} AS day, {_MONTH} AS month FROM judgement_chunks")
def date_normalize(spark, root):
    return table(spark, root, "judgement_chunks").select("chunk_id", "ingested_at", t.date(F.col("case_date")).alias("day"), t.month(F.col("case_date")).alias("month"))


_ONE_CASE = f"(SELECT * FROM (SELECT case_id, cause, {_MONTH} AS month, row_number() OVER (PARTITION BY case_id ORDER BY chunk_no, section, ingested_at, chunk_id) AS r FROM judgement_chunks WHERE case_id IS NOT NULL) WHERE r = 1)"


def _cases(spark, root):
    """One row per case: its first chunk's cause and month, by an aggregation that partial sums serve."""
    rows = table(spark, root, "judgement_chunks").where("case_id is not null")
    first = F.min_by(F.struct("cause", t.month(F.col("case_date")).alias("month")), F.struct("chunk_no", "section", "ingested_at", "chunk_id"))
    return rows.groupBy("case_id").agg(first.alias("f")).select("case_id", "f.cause", "f.month")


_GROUP = "CASE " + " ".join(f"WHEN regexp_matches(cause, '{'|'.join(ws)}') THEN '{n}'" for n, ws in t.CAUSE_GROUPS) + f" ELSE '{t.OTHER_GROUP}' END"


@query(f"WITH c AS (SELECT {_GROUP} AS grp FROM {_ONE_CASE}) SELECT grp, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM c GROUP BY grp".replace("100.0", "1e2"))
def dispute_frequency(spark, root):
    groups = _cases(spark, root).groupBy(t.first_group(F.col("cause"), t.CAUSE_GROUPS, t.OTHER_GROUP).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


@query(f"SELECT cause, count(*) AS n FROM {_ONE_CASE} WHERE cause IS NOT NULL GROUP BY cause ORDER BY n DESC, cause LIMIT 10")
def topn_causes(spark, root):
    return _cases(spark, root).where("cause is not null").groupBy("cause").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cause").limit(10)


@query(f"SELECT month, count(*) AS n, month <> 'unknown' AS known FROM {_ONE_CASE} GROUP BY month")
def monthly_series(spark, root):
    return _cases(spark, root).groupBy("month").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("month") != "unknown")


@query(f"SELECT chunk_id, ingested_at, cause FROM judgement_chunks WHERE regexp_matches(cause, '{'|'.join(t.CAUSES)}') AND section IN ('理由', '主文', '全文') AND length(content) >= 60")
def keyword_filter(spark, root):
    rows = table(spark, root, "judgement_chunks").where(F.col("section").isin("理由", "主文", "全文") & (F.length("content") >= 60))
    return rows.where(t.contains_any(F.col("cause"), t.CAUSES)).select("chunk_id", "ingested_at", "cause")


@query("SELECT chunk_id, ingested_at, CASE " + " ".join(f"WHEN regexp_matches(content, '{'|'.join(ws)}') THEN '{n}'" for n, ws in t.RISK_SIGNALS) + f" ELSE '' END AS risk, coalesce(regexp_matches(content, '{'|'.join(t.CLAUSE_MARKERS)}'), false) AS marked FROM judgement_chunks")
def silver_risk(spark, root):
    return table(spark, root, "judgement_chunks").select("chunk_id", "ingested_at", t.first_group(F.col("content"), t.RISK_SIGNALS, "").alias("risk"), t.contains_any(F.col("content"), t.CLAUSE_MARKERS).alias("marked"))


_SIG = "CASE " + " ".join(f"WHEN regexp_matches(sentence, '{'|'.join(ws)}') THEN '{n}'" for n, ws in t.RISK_SIGNALS) + " ELSE '' END"


@query(f"""
WITH c AS (SELECT chunk_id, case_id, section, chunk_no, content FROM judgement_chunks WHERE content IS NOT NULL AND case_id IS NOT NULL GROUP BY ALL),
 s AS (SELECT case_id, section, chunk_no, chunk_id, unnest({fill(_SENT, 'content')}) AS sentence, generate_subscripts({fill(_SENT, 'content')}, 1) AS i FROM c),
 k AS (SELECT case_id, section, chunk_no, chunk_id, CAST(i AS BIGINT) AS sentence_no, sentence, {_SIG} AS risk FROM s WHERE length(sentence) >= 15 AND regexp_matches(sentence, '{'|'.join(t.CLAUSE_MARKERS)}')),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY section, chunk_no, chunk_id, sentence_no) AS rn FROM k WHERE risk <> '')
SELECT case_id, chunk_id, sentence_no, substr(sentence, 1, 300) AS quote, risk FROM r WHERE rn <= 3""")
def weak_label_rows(spark, root):
    """At most three silver-labelled sentences of each case, in order."""
    rows = table(spark, root, "judgement_chunks").where("content is not null and case_id is not null").select("chunk_id", "case_id", "section", "chunk_no", "content").distinct()
    s = rows.select("case_id", "section", "chunk_no", "chunk_id", F.posexplode(t.sentences(F.col("content"))).alias("i", "sentence")).withColumn("sentence_no", (F.col("i") + 1).cast("bigint"))
    k = s.where((F.length("sentence") >= 15) & t.contains_any(F.col("sentence"), t.CLAUSE_MARKERS)).withColumn("risk", t.first_group(F.col("sentence"), t.RISK_SIGNALS, "")).where("risk <> ''")
    order = Window.partitionBy("case_id").orderBy("section", "chunk_no", "chunk_id", "sentence_no")
    return k.withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("case_id", "chunk_id", "sentence_no", F.substring("sentence", 1, 300).alias("quote"), "risk")


@query("""
WITH d AS (SELECT DISTINCT case_id, section, chunk_no, content FROM judgement_chunks WHERE section IN ('理由', '主文', '全文') AND content <> '' AND case_id IS NOT NULL)
SELECT case_id, section, CAST(chunk_no // 200 AS BIGINT) AS part, CAST(sum(length(content)) + count(*) - 1 AS BIGINT) AS n, md5(string_agg(content, ' ' ORDER BY chunk_no, content)) AS text_hash FROM d GROUP BY case_id, section, chunk_no // 200""")
def case_concat(spark, root):
    """Text of each case's sections in chunk order, in parts of 200 chunks: one case may hold a large share of all rows."""
    rows = table(spark, root, "judgement_chunks").where(F.col("section").isin("理由", "主文", "全文") & (F.col("content") != "") & F.col("case_id").isNotNull()).select("case_id", "section", "chunk_no", "content").distinct()
    joined = rows.groupBy("case_id", "section", F.floor(F.col("chunk_no") / 200).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda x: x["content"]), " ").alias("text"))
    return joined.select("case_id", "section", "part", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("text_hash"))


@query("""
WITH d AS (SELECT DISTINCT case_id, section, chunk_no, content FROM judgement_chunks WHERE section IN ('理由', '主文', '全文') AND content <> '' AND case_id IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY section, chunk_no NULLS LAST, content) - 1 AS i FROM d),
 p AS (SELECT case_id, i // 200 AS part, count(*) AS m, sum(length(content)) AS n, md5(string_agg(content, ' ' ORDER BY i)) AS h FROM o GROUP BY case_id, i // 200)
SELECT case_id, CAST(sum(m) AS BIGINT) AS n_chunks, CAST(sum(n) + sum(m) - 1 AS BIGINT) AS n, count(*) AS n_parts, md5(string_agg(h, ' ' ORDER BY part)) AS text_digest FROM p GROUP BY case_id""")
def case_whole(spark, root):
    """Whole text of each case by section and chunk: its length, and a digest of the hashes of its parts of 200 rows in order.

    Parts go by the row's place in its case, so that none grows with a chunk number that many rows share.
    """
    rows = table(spark, root, "judgement_chunks").where(F.col("section").isin("理由", "主文", "全文") & (F.col("content") != "") & F.col("case_id").isNotNull()).select("case_id", "section", "chunk_no", "content").distinct()
    placed = global_row_number(rows, ["case_id", "section", F.asc_nulls_last("chunk_no"), "content"], "g")
    starts = placed.groupBy("case_id").agg(F.min("g").alias("start"))
    ordered = placed.join(starts, "case_id").select("case_id", (F.col("g") - F.col("start")).alias("i"), "content").withColumn("part", F.floor(F.col("i") / 200))
    # by case and part, else the parts of a case would stay where the join put the case
    spaced = ordered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "case_id", "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "content"))), lambda x: x["content"]), " ")
    parts = spaced.groupBy("case_id", "part").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("content")).alias("n"), F.md5(text).alias("h"))
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), " ")
    return parts.groupBy("case_id").agg(F.sum("m").alias("n_chunks"), (F.sum("n") + F.sum("m") - 1).alias("n"), F.count(F.lit(1)).alias("n_parts"), F.md5(hashes).alias("text_digest"))


@query(f"""
WITH src AS (SELECT DISTINCT case_id, content AS body FROM judgement_chunks WHERE content IS NOT NULL AND case_id IS NOT NULL), {_ARTICLES},
 k AS (SELECT DISTINCT case_id, article FROM a WHERE article IS NOT NULL AND article NOT IN ({', '.join(repr(f'民法第{n}條') for n in t.BOILERPLATE_NUMBERS)}))
SELECT case_id, list_sort(list(article)) AS relevant, count(*) AS n_relevant FROM k GROUP BY case_id HAVING count(*) >= 2""")
def gold_builder(spark, root):
    """Cases with at least two substantive articles, as queries with their relevant articles."""
    rows = table(spark, root, "judgement_chunks").where("content is not null and case_id is not null").select("case_id", F.explode(t.article_list(F.col("content"))).alias("article")).where(~t.is_boilerplate(F.col("article"))).distinct()
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_list("article")).alias("relevant"), F.count(F.lit(1)).alias("n_relevant")).where("n_relevant >= 2")


@query("""WITH c AS (SELECT analysis_id, max(len(coalesce(cross_corroborated, []))) AS n FROM triangulated_evidence GROUP BY analysis_id)
SELECT CAST(least(n, 3) AS INTEGER) AS bin, count(*) AS n_analyses FROM c GROUP BY 1""")
def histogram_capped(spark, root):
    rows = table(spark, root, "triangulated_evidence").groupBy("analysis_id").agg(F.max(F.coalesce(F.size("cross_corroborated"), F.lit(0))).alias("n"))
    return rows.groupBy(F.least("n", F.lit(3)).alias("bin")).agg(F.count(F.lit(1)).alias("n_analyses"))


_SQ = "regexp_replace({0}, '\\s+', '', 'g')"


@query("SELECT chunk_id, ingested_at, coalesce(nullif(court, ''), nullif(cause, ''), nullif(case_id, '')) AS first_value FROM judgement_chunks")
def first_nonempty(spark, root):
    return table(spark, root, "judgement_chunks").select("chunk_id", "ingested_at", t.first_nonempty(F.col("court"), F.col("cause"), F.col("case_id")).alias("first_value"))


@query("""
WITH a AS (SELECT analysis_id, ingested_at, trim(analysis, ' ') AS d, regexp_extract(analysis, '(?s)\\{.*\\}') AS i FROM clause_analyses),
 j AS (SELECT analysis_id, ingested_at, CASE WHEN d LIKE '{%' AND json_valid(d) THEN d WHEN i <> '' AND json_valid(i) THEN i END AS x FROM a)
SELECT analysis_id, ingested_at, x IS NOT NULL AS parsed, x ->> '$.issue' AS issue, x ->> '$.application' AS application FROM j""")
def robust_json(spark, root):
    j = t.robust_json(F.col("analysis"), "issue string, rule string, application string")
    rows = table(spark, root, "clause_analyses").select("analysis_id", "ingested_at", j.alias("j"))
    return rows.select("analysis_id", "ingested_at", F.col("j").isNotNull().alias("parsed"), "j.issue", "j.application")


@query("SELECT model, llm_source, count(*) AS n, count(*) FILTER (llm_source = 'mock') AS n_mock, round(avg(duration_sec), 4) AS mean_duration FROM (SELECT DISTINCT analysis_id, model, llm_source, duration_sec FROM clause_analyses) GROUP BY model, llm_source")
def source_summary(spark, root):
    """Rows per model and source with the mock rows counted apart."""
    rows = table(spark, root, "clause_analyses").select("analysis_id", "model", "llm_source", "duration_sec").distinct()
    return rows.groupBy("model", "llm_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("llm_source") == "mock").alias("n_mock"), F.round(F.avg("duration_sec"), 4).alias("mean_duration"))


@query("SELECT analysis_id, hit.chunk_id AS chunk_id, round(hit.score, 4) AS score FROM (SELECT analysis_id, unnest(law_hits) AS hit FROM (SELECT DISTINCT analysis_id, law_hits FROM triangulated_evidence)) WHERE hit IS NOT NULL")
def hit_flatten(spark, root):
    rows = table(spark, root, "triangulated_evidence").select("analysis_id", "law_hits").distinct().select("analysis_id", F.explode("law_hits").alias("hit")).where("hit is not null")
    return rows.select("analysis_id", "hit.chunk_id", F.round("hit.score", 4).alias("score"))


@query("""WITH l AS (SELECT lower(regexp_replace(label, '^[\\s.]+|[\\s.]+$', '', 'g')) AS x FROM rater_labels)
SELECT count(*) FILTER (x IN ('supported', 'partial', 'unsupported', 'hallucination', 'accurate', 'incomplete')) AS n_valid, count(*) FILTER (x IS NULL OR x = '') AS n_blank, count(*) FILTER (x <> '' AND x NOT IN ('supported', 'partial', 'unsupported', 'hallucination', 'accurate', 'incomplete')) AS n_invalid FROM l""")
def label_tally(spark, root):
    """Valid, blank and invalid votes."""
    x = F.lower(F.regexp_replace("label", r"^[\s.]+|[\s.]+$", ""))
    good = x.isin("supported", "partial", "unsupported", "hallucination", "accurate", "incomplete")
    return table(spark, root, "rater_labels").agg(F.count_if(good).alias("n_valid"), F.count_if(x.isNull() | (x == "")).alias("n_blank"), F.count_if((x != "") & ~good).alias("n_invalid"))
