"""Files as sources and sinks: JSON logs, markdown, feeds, state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import markdown

NOTE = "rel_path string, dir string, title string, type string, lead string, body string, aliases array<string>, tags array<string>, frontmatter map<string,string>, links array<struct<target:string,section:string,display:string,line:int,wiki:boolean>>"
CHUNK = "file string, pos int, anchor string, heading string, text string"
#: Bytes of a note that are read; a larger file is no note.
NOTE_BYTES = 1 << 20


def read_log(spark: SparkSession, path: str, cycle: str) -> DataFrame:
    """Cycles of a JSON document {"cycles": [...]}, in order (pos)."""
    doc = spark.read.schema(f"cycles array<struct<{cycle}>>").option("multiLine", True).json(path)
    return doc.select(F.posexplode("cycles").alias("pos", "c")).select("pos", "c.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; those that don't parse are left out."""
    return read_lines_marked(spark, path, schema).where("_corrupt is null").drop("_corrupt", "_row")


def read_lines_marked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line with its place (_row: file, split and number in it, in file order) and the text of what doesn't parse (_corrupt)."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("_row")).where("trim(value) <> ''")
    got = lines.withColumn("v", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return got.select("_row", "v.*")


def before_malformed(marked: DataFrame) -> DataFrame:
    """The rows of each file before its first line that doesn't parse."""
    first = marked.where("_corrupt is not null").groupBy(F.col("_row.file").alias("__file")).agg(F.min("_row").alias("__first"))
    return marked.join(first, F.col("_row.file") == F.col("__file"), "left").where("__first is null or _row < __first").drop("__file", "__first", "_corrupt", "_row")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _markdown(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, text) of all markdown files below a folder but hidden ones."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    base = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/") + "/"
    got = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("size"), "value")
    full = F.regexp_replace(F.url_decode(F.regexp_replace("p", "\\+", "%2B")), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rel = F.when(F.startswith(full, F.lit(base)), F.substring(full, len(base) + 1, 1 << 30)).otherwise(F.raise_error(F.concat(full, F.lit(f" isn't below {base}"))))
    return got.select(rel.alias("rel_path"), "size", F.col("value").alias("text")).where(~F.col("rel_path").rlike("(^|/)\\.[^/]"))


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a folder of markdown: front matter, title, tags, lead and links."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([markdown.note(r, t) for r, t in zip(f["rel_path"], f["text"], strict=True)], columns=[c.split(" ")[0] for c in NOTE.replace("struct<", "").split(", ")])

    return _markdown(spark, path).where(F.col("size") <= NOTE_BYTES).select("rel_path", "text").mapInPandas(parse, NOTE)


def read_docs(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Sections of the documents at the top of a folder and in its docs folder, cut at second-level headings."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, i, *s) for r, t in zip(f["rel_path"], f["text"], strict=True) for i, s in enumerate(markdown.sections(t))]
            yield pd.DataFrame(rows, columns=["file", "pos", "anchor", "heading", "text"])

    docs = _markdown(spark, path).where(F.col("rel_path").rlike("^(docs/)?[^/]+$") & ~F.col("rel_path").isin(*skip))
    return docs.select("rel_path", "text").mapInPandas(parse, CHUNK)


@F.pandas_udf(T.ArrayType(T.StringType()))
def segments(texts: pd.Series) -> pd.Series:
    """Pieces of a text of at most 512 bytes, cut at white space where there is some near the end."""
    return texts.map(lambda t: markdown.segments(t or ""))


# ---- feeds -----------------------------------------------------------------

_ATOM = "entry array<struct<id:string,title:string,summary:string,published:string>>"
_RSS = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>"
PAPER = "id, title, snippet, year"


def _papers(df: DataFrame, items: Column, ident: str, title: str, text: str, day: str | None) -> DataFrame:
    from ..functions import text as X

    one = df.select(F.explode(items).alias("i"))
    squeeze = lambda c: X.collapse(F.coalesce(F.col(f"i.{c}"), F.lit("")))
    year = X.year_of(F.col(f"i.{day}")) if day else F.lit(0)
    return one.select(squeeze(ident).alias("id"), squeeze(title).alias("title"), F.substring(squeeze(text), 1, 500).alias("snippet"), year.alias("year"))


def atom_papers(df: DataFrame, column: str = "value") -> DataFrame:
    """Papers of Atom answers, one answer a row."""
    return _papers(df, F.from_xml(F.col(column), _ATOM, {"rowTag": "feed"})["entry"], "id", "title", "summary", "published")


def feed_papers(df: DataFrame, query: str, limit: int, column: str = "value") -> DataFrame:
    """Papers of a feed that is Atom, or else RSS: those with a term of the query."""
    from ..functions import text as X

    atom = F.from_xml(F.col(column), _ATOM, {"rowTag": "feed"})["entry"]
    rss = F.transform(F.from_xml(F.col(column), _RSS, {"rowTag": "rss"})["channel"]["item"], lambda i: F.struct(i["link"].alias("id"), i["title"].alias("title"), i["description"].alias("summary"), i["pubDate"].alias("published")))
    got = _papers(df, F.when(F.size(atom) > 0, atom).otherwise(rss), "id", "title", "summary", "published")
    return got.where(X.any_term(F.concat_ws(" ", "title", "snippet"), query)).limit(limit)


def scholar_papers(df: DataFrame, column: str = "value") -> DataFrame:
    doc = F.from_json(F.col(column), "data array<struct<paperId:string,title:string,abstract:string,year:int>>")
    return df.select(F.explode(doc["data"]).alias("i")).select(F.col("i.paperId").alias("id"), "i.title", F.coalesce("i.abstract", F.lit("")).alias("snippet"), F.coalesce("i.year", F.lit(0)).alias("year"))


def web_papers(df: DataFrame, limit: int, column: str = "value") -> DataFrame:
    """Hits of a web search: results of type 0 alone."""
    doc = F.from_json(F.col(column), "data array<struct<t:int,url:string,title:string,snippet:string>>")
    return df.select(F.explode(doc["data"]).alias("i")).where("i.t = 0").select(F.col("i.url").alias("id"), "i.title", F.substring(F.coalesce("i.snippet", F.lit("")), 1, 500).alias("snippet"), F.lit(0).alias("year")).limit(limit)


def relaxed(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Documents with all terms; without any, those with all but the last, and so on down to two terms."""
    low = F.lower("text")
    held = F.lit(0)
    so_far = F.lit(True)
    for t in terms:
        so_far = so_far & low.contains(t.lower())
        held = held + so_far.cast("int")
    got = docs.select("doc", "text", held.alias("held")).where(F.col("held") >= min(2, len(terms)))
    best = got.agg(F.max("held").alias("best"))
    return got.join(F.broadcast(best), F.col("held") == F.col("best")).select("doc", "held").orderBy("doc").limit(limit)


# ---- sinks -----------------------------------------------------------------


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_state(df: DataFrame, path: str) -> None:
    """The state as a whole; what was there is replaced."""
    df.write.mode("overwrite").json(path)


def isolated(connections: DataFrame) -> DataFrame:
    """Connections for which no predicate was found."""
    return connections.where(F.coalesce("predicate", F.lit("")).isin("", "NONE"))


def with_time(verdicts: DataFrame, now: str) -> DataFrame:
    return verdicts.withColumn("timestamp", F.when(F.coalesce("timestamp", F.lit("")) == "", F.lit(now)).otherwise(F.col("timestamp")))


def usage(calls: DataFrame) -> DataFrame:
    """(ts, tool, flags, wall_ms): names of flags, never their values."""
    flags = F.transform(F.filter("argv", lambda a: a.startswith("-")), lambda a: F.substring_index(F.regexp_replace(a, "^-+", ""), "=", 1))
    return calls.select("ts", "tool", flags.alias("flags"), "wall_ms")


# ---- bundles ---------------------------------------------------------------


def bundle(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, text): one document for each entity, paths unique in order of var_name, claims by predicate."""
    base = F.regexp_replace(F.lower(F.trim("name")), "[^\\p{L}\\p{Nd}]+", "-")
    w = Window.partitionBy("role_type", "base").orderBy("var_name")
    e = entities.withColumn("base", F.btrim(base, F.lit("-"))).withColumn("i", F.row_number().over(w))
    path = F.concat(F.lower("role_type"), F.lit("/"), "base", F.when(F.col("i") > 1, F.concat(F.lit("-"), F.col("i").cast("string"))).otherwise(""), F.lit(".md"))
    e = e.select("var_name", "name", "brief", "role_type", path.alias("path"))
    to = e.select(F.col("var_name").alias("object"), F.col("path").alias("to"), F.col("name").alias("to_name"))
    line = F.when(F.col("to").isNull(), F.coalesce("object", F.lit("yes"))).otherwise(F.concat(F.lit("["), "to_name", F.lit("](/"), "to", F.lit(")")))
    rows = claims.join(to, "object", "left").select(F.col("subject").alias("var_name"), "predicate", F.concat(F.lit("- "), line).alias("line"))
    parts = rows.groupBy("var_name", "predicate").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines")).groupBy("var_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("\n## "), "predicate", F.lit("\n"), "lines"))), "\n").alias("body"))
    head = F.concat(F.lit("---\ntype: "), "role_type", F.lit("\ntitle: "), "name", F.lit("\n---\n# "), "name", F.lit("\n"), F.coalesce("brief", F.lit("")), F.lit("\n"))
    return e.join(parts, "var_name", "left").select("path", F.concat(head, F.coalesce("body", F.lit(""))).alias("text"))


def bundle_faults(docs: DataFrame) -> DataFrame:
    """(path, fault, detail) of a bundle's (path, text): front matter, type, links to nowhere, log dates."""
    plain = docs.where(~F.col("path").rlike("(^|/)(index|log)\\.md$"))
    front = F.regexp_extract("text", "(?s)^---\\n(.*?)\\n---", 1)
    head = plain.select("path", F.when(front == "", "no front matter").when(~front.rlike("(?m)^type: *\\S"), "no type").alias("fault"), F.lit("").alias("detail")).where("fault is not null")
    target = F.regexp_replace(F.col("t"), "#.*$", "")
    links = docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("\\]\\(([^)\\s]+)\\)"), F.lit(1)))).alias("t")).where(~F.col("t").rlike("^[a-z]+:|^#"))
    # From the root, or beside the document.
    full = F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(F.regexp_extract("path", "^(.*/)?", 0), target))
    broken = links.withColumn("to", full).join(docs.select(F.col("path").alias("to")), "to", "left_anti").select("path", F.lit("broken link").alias("fault"), F.col("t").alias("detail"))
    days = docs.where(F.col("path").rlike("(^|/)log\\.md$")).select("path", F.posexplode(F.regexp_extract_all("text", F.lit("(?m)^## +(.*?) *$"), F.lit(1))).alias("pos", "day"))
    w = Window.partitionBy("path").orderBy("pos")  # headings of one log
    days = days.withColumn("before", F.lag("day").over(w))
    fault = F.when(~F.col("day").rlike("^\\d{4}-\\d{2}-\\d{2}$"), "log heading is no date").when(F.col("before") < F.col("day"), "log not newest first")
    return head.unionByName(broken).unionByName(days.select("path", fault.alias("fault"), F.col("day").alias("detail")).where("fault is not null"))
