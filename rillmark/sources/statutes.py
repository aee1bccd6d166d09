"""Statute collections: JSON files, ZIP archives, section files, rendered documents."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark import packaging
from rillmark.functions import text as TX
from rillmark.operators import ingest

from .html_pages import block_texts, lines_of

FRAGMENT = "struct<fragmentId:string,hloubka:int,typ:string,xhtml:string,souboroveDokumenty:array<string>>"
SCHEMA = f"metadata struct<castkaCislo:string,predpisCislo:string,rocnik:string,datumUcinnostiZneniOd:string>, fragmenty array<{FRAGMENT}>"
#: The sections of a monolithic dataset, each kept as JSON lines.
SECTIONS = {
    "law_fragments": "id string, law_iri string, text string, paragraph string",
    "definitions": "id string, law_links array<string>",
    "links": "id string, source string, target string",
    "terms": "id string, name string",
    "metadata": "law_id string, citace string, name string",
}


def section(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A section's records; lines that are no JSON are left out."""
    schema = T.StructType.fromDDL(f"{SECTIONS[name]}, _corrupt string")
    return spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").filter("_corrupt IS NULL").drop("_corrupt")


def bad_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The lines that ``section`` leaves out."""
    schema = T.StructType.fromDDL(f"{SECTIONS[name]}, _corrupt string")
    read = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).filter(read["_corrupt"].isNotNull()).select(F.col("value").alias("line"))


def collections(spark: SparkSession, path: str) -> DataFrame:
    """name, metadata and fragmenty of JSON files (one document a file)."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "metadata", "fragmenty")


def fragments(docs: DataFrame, law: Column | None = None) -> DataFrame:
    """Text fragments of collections in document order, with their paragraph context:
    fragment_id, law_iri, text, paragraph, pos."""
    iri = TX.iri_of_citation(F.coalesce(F.col("metadata.predpisCislo"), F.lit(""))) if law is None else law
    rows = docs.select(iri.alias("law_iri"), F.posexplode("fragmenty").alias("pos", "f"))
    rows = rows.select("law_iri", "pos", F.col("f.typ").alias("typ"), F.concat("law_iri", F.lit("/"), F.coalesce("f.fragmentId", F.lit("None"))).alias("fragment_id"), TX.strip_tags(F.coalesce("f.xhtml", F.lit(""))).alias("text"))
    rows = rows.filter(F.col("typ").isin(*ingest.TEXT_TYPES) & (F.col("text") != ""))
    return ingest.paragraph_context(rows).select("fragment_id", "law_iri", "text", "paragraph", "pos")


def member_of(names: list[str], strict: bool) -> str | None:
    """The statute in an archive: the first *IZ.json; else, unless strict, any JSON."""
    if strict:
        return next((n for n in names if n.endswith("IZ.json")), None)
    found = [n for n in names if n.lower().endswith(".json")]
    return next((n for n in found if "_iz.json" in n.lower()), found[0] if found else None)


def _members(strict: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = member_of(z.namelist(), strict)
                    rows.append((path, name, z.read(name).decode("utf-8-sig", "replace") if name else None))
            yield pd.DataFrame(rows, columns=["path", "member", "body"])

    return run


def archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, member and body (JSON text, null if there is none) of ZIP files, unpacked on
    the executors that read them."""
    return unpacked(spark.read.format("binaryFile").load(path), strict)


def unpacked(files: DataFrame, strict: bool = True) -> DataFrame:
    """The same of ZIP files that are rows (path, content)."""
    packaging.send(files.sparkSession)
    return files.select("path", "content").mapInPandas(_members(strict), "path string, member string, body string")


def archive_laws(files: DataFrame) -> DataFrame:
    """ZIP files named Sb_{year}_{number}_...: adds law_iri; others are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    year, number = F.regexp_extract(name, "^Sb_([0-9]{4})_([0-9]+)_", 1), F.regexp_extract(name, "^Sb_([0-9]{4})_([0-9]+)_", 2)
    return files.withColumn("law_iri", F.when(year != "", TX.law_iri(number, year))).filter("law_iri IS NOT NULL")


def archive_fragments(files: DataFrame) -> DataFrame:
    """Fragments of the statutes in ``archives``."""
    parsed = files.filter("body IS NOT NULL").select(F.from_json("body", SCHEMA).alias("d")).select("d.*")
    return fragments(parsed)


def is_collection(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.metadata").startswith("{") & F.get_json_object(body, "$.fragmenty").startswith("["), F.lit(False))


def rendered(bodies: DataFrame) -> DataFrame:
    """``bodies`` (name, body) as readable text: header lines and one block for each
    fragment; other JSON pretty-printed."""
    packaging.send(bodies.sparkSession)
    rows = bodies.withColumns({"_is": is_collection(F.col("body")), "_d": F.from_json("body", SCHEMA)})
    meta = F.col("_d.metadata")

    def some(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", c)

    header = F.array_compact(
        F.array(
            F.concat(F.lit("Source file: "), "name"),
            F.concat(F.lit("Legal collection item: "), some(meta["predpisCislo"]), F.lit("/"), some(meta["rocnik"]), F.lit(" Sb.")),
            F.concat(F.lit("Collection issue number: "), some(meta["castkaCislo"])),
            F.concat(F.lit("Effective wording date: "), some(meta["datumUcinnostiZneniOd"])),
        )
    )
    # a collection stays one row: exploded, each fragment would carry the whole body with it
    fragments = F.when(F.col("_is"), F.coalesce("_d.fragmenty", F.array())).otherwise(F.array())
    rows = rows.select("name", "_is", "body", header.alias("header"), fragments.alias("parts"))
    rows = rows.withColumn("texts", block_texts(F.transform("parts", lambda f: F.coalesce(f["xhtml"], F.lit("")))))

    def block(f: Column, text: Column) -> Column:
        label = F.array_compact(F.array(F.coalesce(F.nullif(f["typ"], F.lit("")), F.lit("Fragment")), F.concat(F.lit("depth="), f["hloubka"].cast("string")), F.concat(F.lit("id="), F.nullif(f["fragmentId"], F.lit("")))))
        return F.when(text != "", F.concat(F.lit("["), F.array_join(label, " | "), F.lit("]\n"), text))

    blocks = F.array_compact(F.zip_with("parts", "texts", block))
    text = F.concat_ws("\n\n", F.array_join("header", "\n"), F.nullif(F.array_join(blocks, "\n\n"), F.lit("")))
    pretty = F.pandas_udf(_pretty, "string")
    return rows.select("name", F.when(F.col("_is"), text).otherwise(pretty(F.when(~F.col("_is"), F.col("body")))).alias("text"))


def _pretty(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in bodies:
        yield batch.map(lambda b: json.dumps(json.loads(b), ensure_ascii=False, indent=2), na_action="ignore")


#: File types that are taken in.
SUFFIXES = ("txt", "json", "zip", "pdf", "docx")


def _text_of(suffix: str, content: bytes) -> tuple[str | None, str | None]:
    """Text and error of a file."""
    try:
        if suffix == "txt":
            return content.decode("utf-8", "ignore"), None
        if suffix == "json":
            return content.decode("utf-8-sig"), None
        if suffix == "zip":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                name = member_of(z.namelist(), False)
                return (z.read(name).decode("utf-8-sig"), None) if name else (None, "no JSON collection in the archive")
        if suffix == "pdf":
            try:
                from pypdf import PdfReader
            except ModuleNotFoundError:
                return None, "PDF files need pypdf"
            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages).strip(), None
        if suffix == "docx":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                body = z.read("word/document.xml").decode()
            return lines_of(body.replace("</w:p>", "<br>").replace("<w:tab/>", "\t")), None
        return None, f"unsupported file type: {suffix}"
    except (ValueError, KeyError, zipfile.BadZipFile) as e:
        return None, f"{type(e).__name__}: {e}"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        suffix = batch["path"].str.rsplit(".", n=1).str[-1].str.lower()
        found = [_text_of(s, c) for s, c in zip(suffix, batch["content"], strict=True)]
        yield pd.DataFrame({"path": batch["path"], "suffix": suffix, "size_bytes": batch["length"], "body": [t for t, _ in found], "error": [e for _, e in found]})


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of every supported type: path, suffix, size_bytes, text, error.  Statute
    collections are rendered, other JSON pretty-printed; a file that fails has an error and
    does not stop the others."""
    packaging.send(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(_parse, "path string, suffix string, size_bytes long, body string, error string")
    structured = raw.filter("suffix IN ('json', 'zip') AND body IS NOT NULL")
    text = rendered(structured.select(F.col("path").alias("name"), "body"))
    named = text.withColumnsRenamed({"name": "_path"})
    joined = raw.join(named, raw.path == named["_path"], "left")
    return joined.select("path", "suffix", "size_bytes", F.coalesce("text", "body").alias("text"), "error")


def uploads(files: DataFrame, now: Column) -> DataFrame:
    """Registry rows of new files (path, length): supported types and not empty."""
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(suffix.isin(*SUFFIXES) & (F.col("length") > 0)).select(F.expr("uuid()").alias("id"), TX.safe_filename(name).alias("filename"), "path", F.col("length").alias("size_bytes"), F.lit("uploaded").alias("status"), now.alias("uploaded_at"))


def newest_first(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("uploaded_at"), "id")
