"""Readers: statutes, judgements, contracts, gold sets, label sheets, external corpora. All give DataFrames."""

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as t

STATUTES = "Laws array<struct<LawName: string, LawCategory: string, LawArticles: array<struct<ArticleType: string, ArticleNo: string, ArticleContent: string>>>>"
RECORD = "JID string, case_id string, JYEAR string, JCASE string, JNO string, court string, JCOURT string, JDATE string, date string, JTITLE string, cause string, JFULL string, full_text string, summary string"
# Keys under which files wrap their list.
ENVELOPES = ("data", "items", "results", "Judgements")


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "^\ufeff", "")


def statutes(spark: SparkSession, path: str, laws: tuple[str, ...] = t.LAWS) -> DataFrame:
    """chunk_id, law_name, law_category, article_no, text, content of the articles of the named laws.

    The file may begin with a byte order mark. Chapter rows (type other than A) and rows with a blank
    number or content are left out.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json(_bare(F.col("value")), STATUTES).alias("j"))
    law = raw.select(F.explode("j.Laws").alias("l")).where(F.col("l.LawName").isin(*laws))
    rows = law.select("l.LawName", "l.LawCategory", F.explode("l.LawArticles").alias("a")).where("a.ArticleType = 'A'")
    no, content = t.clean(F.col("a.ArticleNo")), t.clean(F.col("a.ArticleContent"))
    kept = rows.select(F.col("LawName").alias("law_name"), F.col("LawCategory").alias("law_category"), no.alias("article_no"), content.alias("content")).where("article_no <> '' and content <> ''")
    return kept.select(F.concat("law_name", F.lit("__"), F.replace("article_no", F.lit(" "), F.lit("_"))).alias("chunk_id"), "law_name", "law_category", "article_no", F.concat_ws(" ", "law_name", "article_no", "content").alias("text"), "content")


def _unwrapped(values: DataFrame) -> DataFrame:
    """Records of JSON texts (column value): a list, a list under one of ENVELOPES, or one object; what is no JSON or no object gives none."""
    v = values.select(F.try_parse_json(_bare(F.col("value"))).alias("v")).where("v is not null")
    lists = [F.try_variant_get("v", f"$.{name}", "array<variant>") for name in ENVELOPES]
    inside = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists, F.array("v"))
    one = v.select(F.explode(inside).alias("r")).select(F.to_json("r").alias("j")).where("j like '{%'")
    return one.select(F.from_json("j", RECORD).alias("r")).select("r.*")


def judgement_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of a directory, recursively, by suffix in any letter case: .json, .jsonl, .csv and .zip of .json members.

    Malformed files, lines and members give no rows.
    """
    look = lambda glob: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    whole = look("*.{json,JSON,Json}").text(path, wholetext=True)
    lines = look("*.{jsonl,JSONL,Jsonl}").text(path).where("trim(value) <> ''")
    packed = look("*.{zip,ZIP,Zip}").format("binaryFile").load(path).select("content")

    def members(batches):
        import pandas as pd

        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for name in archive.namelist():
                            if name.lower().endswith(".json"):
                                try:
                                    texts.append(archive.read(name).decode("utf-8-sig"))
                                except (UnicodeDecodeError, zipfile.BadZipFile, OSError):
                                    continue
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame({"value": texts})

    values = whole.unionByName(lines).unionByName(packed.mapInPandas(members, "value string"))
    records = _unwrapped(values)
    return records.unionByName(_csv_records(spark, path), allowMissingColumns=True).select(records.columns)


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,CSV}").option("header", True).option("multiLine", True)
    try:
        got = rows.csv(path)
    except Exception as error:  # a folder without such files has no schema to infer
        if "UNABLE_TO_INFER_SCHEMA" in str(error) or "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], RECORD)
        raise
    known = {c.split()[0] for c in RECORD.split(", ")}
    named = got.toDF(*(c.lstrip("\ufeff") for c in got.columns))
    return named.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in named.columns if c in known))


def judgement_chunks(records: DataFrame, causes: tuple[str, ...] = t.CAUSES, limit: int = 800, least: int = 60) -> DataFrame:
    """chunk_id, case_id, court, case_date, cause, section, chunk_no, text, content of the relevant records.

    Sections and pieces shorter than `least` are dropped; chunk_no counts before that, so it has gaps.
    """
    col = lambda *names: t.first_nonempty(*(F.col(n) for n in names))
    blank = F.lit("")
    case = F.coalesce(col("JID", "case_id"), F.concat_ws(",", *(F.coalesce(n, blank) for n in ("JYEAR", "JCASE", "JNO"))))
    rows = records.select(t.clean(case).alias("case_id"), t.clean(F.coalesce(col("court", "JCOURT"), blank)).alias("court"), t.date(col("JDATE", "date")).alias("case_date"), t.clean(F.coalesce(col("JTITLE", "cause"), blank)).alias("cause"), F.coalesce(col("JFULL", "full_text", "summary"), blank).alias("full"))
    rows = rows.where(t.contains_any(F.col("cause"), causes) & (F.col("case_id") != ""))
    parts = rows.select("*", F.explode(t.sections(F.col("full"))).alias("s")).where(F.length("s.body") >= least)
    cut = parts.select("*", F.posexplode(t.section_chunks(F.col("s.body"), limit)).alias("chunk_no", "content")).where(F.length("content") >= least)
    header = F.concat(F.lit("["), F.concat_ws(" ", "court", "case_id", "cause", "s.label"), F.lit("]"))
    return cut.select(F.concat("case_id", F.lit("__"), "s.label", F.lit("_"), F.col("chunk_no").cast("string")).alias("chunk_id"), "case_id", "court", "case_date", "cause", F.col("s.label").alias("section"), "chunk_no", F.concat_ws(" ", header, "content").alias("text"), "content")


def contracts(spark: SparkSession, path: str, digital: Callable[[bytes], tuple[str, int]] | None = None, ocr: Callable[[bytes], tuple[str, int]] | None = None, least: int = 50) -> DataFrame:
    """path, text, source, page_count of contract files.

    .txt is read as it is. Other files go through `digital`, and through `ocr` where that gives fewer than
    `least` characters: both are functions bytes -> (text, pages), plugged in by the caller (no PDF or OCR
    library is required). Without a plug-in such files give an empty text and source `none`.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,TXT}").text(path, wholetext=True)
    plain = texts.select(F.input_file_name().alias("path"), _bare(F.col("value")).alias("text"), F.lit("text").alias("source"), F.lit(1).alias("page_count"))
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,PDF,png,PNG,jpg,JPG,jpeg,JPEG,tif,TIF,tiff}").load(path).select("path", "content")

    def extract(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                text, pages, source = "", 0, "none"
                if digital and name.lower().endswith(".pdf"):
                    text, pages = digital(content)
                    source = "digital"
                if ocr and len(text.strip()) < least:
                    text, pages = ocr(content)
                    source = "ocr"
                rows.append((name, text, source, pages))
            yield pd.DataFrame(rows, columns=["path", "text", "source", "page_count"])

    return plain.unionByName(binary.mapInPandas(extract, "path string, text string, source string, page_count int"))


def contract_clauses(documents: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """key, clause_index, label, text, full_text, char_offset; by clause labels, or by paragraphs where there are fewer than three clauses."""
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t")).withColumn("_c", t.clauses(F.col("_t")))
    by_label = rows.where(F.size("_c") >= 3).select(key, F.posexplode("_c").alias("clause_index", "c"))
    labelled = by_label.select(key, "clause_index", "c.label", F.col("c.body").alias("text"), F.concat_ws(" ", "c.label", "c.body").alias("full_text"), F.col("c.at").alias("char_offset"))
    paras = rows.where(F.size("_c") < 3).select(key, t.layout(F.col("_t")).alias("_t"), F.posexplode(t.paragraphs(F.col("_t"))).alias("clause_index", "text"))
    other = paras.select(key, "clause_index", F.concat(F.lit("段"), (F.col("clause_index") + 1).cast("string")).alias("label"), "text", F.col("text").alias("full_text"), (F.expr("position(text, _t)") - 1).alias("char_offset"))
    return labelled.unionByName(other)


def _each_object(values: DataFrame) -> DataFrame:
    """Objects `r` of whole texts: JSON lines where every line is JSON by itself, else a list, an envelope, or one object."""
    lines = values.withColumn("l", F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != ""))
    by_line = (F.size("l") > 1) & F.forall("l", lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"))
    marked = lines.withColumn("by_line", by_line)
    a = marked.where("by_line").select(F.explode("l").alias("x")).select(F.try_parse_json("x").alias("r"))
    v = marked.where("not by_line").select(F.try_parse_json("value").alias("v")).where("v is not null")
    lists = [F.try_variant_get("v", path, "array<variant>") for path in ("$", *(f"$.{n}" for n in ENVELOPES))]
    return a.unionByName(v.select(F.explode(F.coalesce(*lists, F.array("v"))).alias("r")))


GOLD = "id string, query string, relevant_ids array<string>, expected_risk string, clause_type string, source string, cat string"


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """Gold queries of a JSONL file, a JSON array, or an object with `items`."""
    values = spark.read.text(path, wholetext=True).select(_bare(F.col("value")).alias("value"))
    return _each_object(values).select(F.from_json(F.to_json("r"), GOLD).alias("r")).where("r.id is not null or r.query is not null").select("r.*")


def pick(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first column that is one of the candidates in any letter case, by the candidates' order, else one that contains a candidate."""
    low = {c.lower().strip().lstrip("\ufeff"): c for c in columns}
    for name in candidates:
        if name.lower() in low:
            return low[name.lower()]
    return next((c for name in candidates for k, c in low.items() if name.lower() in k), None)


def label_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one or several CSV sheets with a header; files may differ in columns; a byte order mark is dropped. Files of one header are read by one scan."""
    texts = spark.read.option("pathGlobFilter", "*.{csv,CSV}").option("recursiveFileLookup", True).text(path, wholetext=True)
    head = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^\ufeff|\r$", ""))
    out = None
    for header, files in texts.groupBy(head.alias("h")).agg(F.array_sort(F.collect_list("_metadata.file_path"))).orderBy("h").toLocalIterator():
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "sample_id string, label string")


# The names that external corpora and query sets give their fields.
CORPUS_KEYS = ("law_id", "id", "reference_law_id", "article_id")
CORPUS_TEXTS = ("content", "text", "law_text", "article")
QUERY_TEXTS = ("query_tw", "query", "question", "query_en", "fact")
QUERY_GOLD = ("reference_law_id", "relevant_ids", "gold", "answer_law_id")


def _objects(spark: SparkSession, path: str) -> DataFrame:
    values = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,jsonl}").text(path, wholetext=True)
    return _each_object(values.select(_bare(F.col("value")).alias("value")))


def external_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) with the id and text under any of the usual names."""
    r = _objects(spark, path)
    got = lambda names: t.first_nonempty(*(F.try_variant_get("r", f"$.{n}", "string") for n in names))
    return r.select(got(CORPUS_KEYS).alias("id"), got(CORPUS_TEXTS).alias("text")).where("id is not null and text is not null")


def external_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant_ids): the gold ids may be a list or one string."""
    r = _objects(spark, path)
    many = F.coalesce(*(F.try_variant_get("r", f"$.{n}", "array<string>") for n in QUERY_GOLD))
    one = t.first_nonempty(*(F.try_variant_get("r", f"$.{n}", "string") for n in QUERY_GOLD))
    text = t.first_nonempty(*(F.try_variant_get("r", f"$.{n}", "string") for n in QUERY_TEXTS))
    return r.select(text.alias("query"), F.coalesce(many, F.when(one.isNotNull(), F.array(one))).alias("relevant_ids")).where("query is not null")


def inspect(spark: SparkSession, path: str, files: int = 20) -> list[tuple[str, str]]:
    """(file, first 200 characters) of the first files of a directory: names are listed, and only these files are read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    names = []
    while found.hasNext():
        names = sorted([*names, found.next().getPath().toString()])[:files]
    if not names:
        return []
    rows = spark.read.text(names, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.substring("value", 1, 200).alias("head"))
    return [(r["path"], r["head"]) for r in rows.orderBy("path").collect()]


def guarded(path: str, forbidden: str = "test") -> str:
    """The path, unless one of its folders is held-out material."""
    if forbidden in path.rstrip("/").split("/"):
        raise ValueError(f"{path} lies in held-out material ({forbidden}/)")
    return path


def without_held_out(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return rows.join(held_out.select(key).distinct(), key, "left_anti")

