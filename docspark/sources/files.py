"""Files as tables: recursive listings, delimited text, JSON, logs, vCards, settings, mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .tables import Tables


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, size, mtime) of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def extension(path: Column) -> Column:
    """The effective extension: compound for compressed tar files."""
    return F.lower(F.regexp_extract(path, r"(?i)(\.tar\.(?:gz|bz2|xz)|\.[^./]+)$", 1))


# Beginnings and names of files that are no documents.
JUNK_STARTS = ("~$", "~wrl", "._")
JUNK_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")


def is_junk(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = name.isin(*JUNK_NAMES)
    for s in JUNK_STARTS:
        out = out | name.startswith(s)
    return out


def delimited(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header; every column a string, blanks kept."""
    return spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("inferSchema", False).option("emptyValue", "").csv(path)


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """Top-level (key, value) pairs of JSON objects; text that isn't an object gives no rows."""
    pairs = F.explode(F.from_json(column, "map<string,string>")).alias("key", "value")
    return df.select(*(c for c in df.columns if c != column), pairs)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines (plain or gzip): line, and its JSON as a variant, null where it isn't JSON."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.try_parse_json("value").alias("json"))


def settings(df: DataFrame, column: str) -> DataFrame:
    """(section, key, value) of INI text; keys before a section have an empty one."""
    blocks = F.explode(F.split(F.concat(F.lit("[]\n"), F.col(column)), r"(?m)^(?=\[)")).alias("block")
    rows = df.select(*(c for c in df.columns if c != column), blocks).withColumn("section", F.regexp_extract("block", r"^\[([^\]]*)\]", 1)).withColumn("line", F.explode(F.split("block", "\n")))
    pair = r"^\s*([^#;=:\[\s][^=:]*?)\s*[=:]\s*(.*?)\s*$"
    return rows.filter(F.col("line").rlike(pair)).select(*(c for c in df.columns if c != column), "section", F.regexp_extract("line", pair, 1).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))


def contacts(df: DataFrame, column: str) -> DataFrame:
    """(name, emails, phones) of each card in vCard text."""
    card = F.explode(F.filter(F.split(column, "BEGIN:VCARD"), lambda x: x.contains("END:VCARD"))).alias("card")
    field = lambda name: F.regexp_extract_all("card", F.lit(rf"(?m)^{name}[^:\n]*:(.*?)\s*$"), F.lit(1))
    return df.select(*(c for c in df.columns if c != column), card).select(*(c for c in df.columns if c != column), F.get(field("FN"), 0).alias("name"), field("EMAIL").alias("emails"), field("TEL").alias("phones"))


def mail(df: DataFrame, column: str) -> DataFrame:
    """(subject, sender, body) of message text: headers up to the first empty line."""
    header = lambda name: F.trim(F.regexp_extract(F.regexp_extract(column, r"(?s)^(.*?)\r?\n\r?\n", 1), rf"(?mi)^{name}:(.*)$", 1))
    coded = r"(?is)^=\?utf-8\?b\?([^?]*)\?=$"  # a header that isn't plain ASCII, or holds line breaks, is one encoded word
    subject = header("Subject")
    subject = F.when(subject.rlike(coded), F.decode(F.unbase64(F.regexp_extract(subject, coded, 1)), "UTF-8")).otherwise(subject)
    return df.select(*(c for c in df.columns if c != column), subject.alias("subject"), header("From").alias("sender"), F.regexp_extract(column, r"(?s)\r?\n\r?\n(.*)$", 1).alias("body"))


@query("S01_table_scan", "SELECT id, source_path FROM v_source_files")
def table_scan(t: Tables) -> DataFrame:
    return t.source_files.select("id", "source_path")


@query("S02_first_row", "SELECT id FROM v_source_files ORDER BY id LIMIT 1")
def first_row(t: Tables) -> DataFrame:
    return t.source_files.select("id").orderBy("id").limit(1)


@query("S03_tree_scan")
def tree_scan(t: Tables) -> DataFrame:
    """The table's own files, as a file tree."""
    return listing(t.spark, t.sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "ext", "size")


@query("S08_extension", "SELECT id, REGEXP_EXTRACT(source_path,'(\\.[^./]+)$',1) AS ext FROM v_source_files")
def extensions(t: Tables) -> DataFrame:
    return t.source_files.select("id", extension(F.col("source_path")).alias("ext"))


@query("S09_junk", "SELECT id FROM v_source_files WHERE NOT STARTS_WITH(LOWER(STRING_SPLIT(source_path,'/')[-1]),'~$') AND MOD(dir_id,7) <> 0")
def without_junk(t: Tables) -> DataFrame:
    named = t.source_files.withColumn("p", F.when(F.col("dir_id") % 7 == 0, F.concat(F.lit("/x/~$"), F.col("id"))).otherwise(F.col("source_path")))
    return named.filter(~is_junk(F.col("p"))).select("id")


@query("S12_json_pairs", "SELECT id, 'k' AS key, metadata->>'$.k' AS value FROM v_activity_events")
def json_pairs(t: Tables) -> DataFrame:
    return json_paths(t.activity_events.select("id", "metadata"), "metadata")


@query("S14_settings", "SELECT id, 'file' AS section, 'format' AS key, source_format AS value FROM v_corpus UNION ALL SELECT id, '', 'lang', lang FROM v_corpus")
def settings_rows(t: Tables) -> DataFrame:
    return settings(t.corpus.select("id", F.concat(F.lit("lang = "), F.col("lang"), F.lit("\n[file]\n# note\nformat: "), F.col("source_format"), F.lit("\n")).alias("ini")), "ini")


@query("S19_contacts", "SELECT c_custkey, c_name AS name, LOWER(REPLACE(c_name,'#','.'))||'@example.org' AS email FROM customer")
def contact_rows(t: Tables) -> DataFrame:
    card = F.concat(F.lit("BEGIN:VCARD\nFN:"), F.col("c_name"), F.lit("\nEMAIL;TYPE=work:"), F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org\nEND:VCARD\n"))
    return contacts(t.raw("customer").select("c_custkey", card.alias("vcf")), "vcf").select("c_custkey", "name", F.get("emails", 0).alias("email"))


@query("S21_mail", "SELECT id, title AS subject, source_format AS sender, content AS body FROM v_corpus")
def mail_rows(t: Tables) -> DataFrame:
    title = F.col("title")
    plain = ~title.contains("\n") & (F.trim(title) == title) & title.rlike(r"^[\x20-\x7E]*$")
    subject = F.when(plain, title).otherwise(F.concat(F.lit("=?utf-8?B?"), F.regexp_replace(F.base64(F.encode(title, "UTF-8")), r"\s", ""), F.lit("?=")))
    text = F.concat(F.lit("From: "), F.col("source_format"), F.lit("\nSubject: "), subject, F.lit("\n\n"), F.col("content"))
    return mail(t.corpus.select("id", text.alias("eml")), "eml")


@query("S37_rate_table", "SELECT provider_id, model, input_rate FROM v_rates WHERE input_rate >= 0 AND output_rate >= 0")
def rate_table(t: Tables) -> DataFrame:
    return t.rates.filter("input_rate >= 0 and output_rate >= 0").select("provider_id", "model", "input_rate")
