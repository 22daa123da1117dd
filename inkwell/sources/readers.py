"""Sources: Word documents, JSON and JSONL files, Parquet tables, and the cache of parsed documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "filename string, text string, endnotes map<string,string>, mtime timestamp"
INDEX = "term_index map<string,int>, term_to_chunks map<string,array<string>>, entity_associations map<string,array<string>>, name_changes map<string,array<string>>, version string"
ENDNOTES = "map<string,string>"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> tuple[str, dict[str, str]]:
    """The text of a Word file, a line per paragraph, italic runs between <italic> tags, and its endnotes by id."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    def run_text(r) -> str:
        parts = ["\t" if x.tag == _W + "tab" else "\n" if x.tag == _W + "br" else x.text or "" for x in r if x.tag in (_W + "t", _W + "tab", _W + "br")]
        text = "".join(parts)
        i = r.find(f"{_W}rPr/{_W}i")
        italic = i is not None and i.get(_W + "val", "true") not in ("0", "false", "off")
        return f"<italic>{text}</italic>" if italic and text.strip() else text

    def blocks(root):
        return ["".join(run_text(r) for r in p.iter(_W + "r")) for p in root.iter(_W + "p")]

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = [b for b in blocks(ET.fromstring(z.read("word/document.xml"))) if b.strip()]
        notes = {}
        if "word/endnotes.xml" in z.namelist():
            for n in ET.fromstring(z.read("word/endnotes.xml")).iter(_W + "endnote"):
                text = "\n".join(blocks(n)).strip()
                if text:
                    notes[n.get(_W + "id")] = text
    return "\n".join(body), notes


def _parse(batches):
    for batch in batches:
        text, notes = [], []
        for content in batch.column(2):
            try:
                t, n = docx_text(content.as_py())
            except Exception:  # noqa: BLE001 - a broken file is a row without text, not the end of the scan
                t, n = None, {}
            text.append(t)
            notes.append(list(n.items()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(notes, pa.map_(pa.string(), pa.string())), batch.column(1)], names=["filename", "text", "endnotes", "mtime"])


def word_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, text, endnotes, mtime) of every .docx in a folder but Word's lock files (~...); a file that cannot be read has a null text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*.docx").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.url_decode(name).alias("filename"), F.col("modificationTime").alias("mtime"), "content").mapInArrow(_parse, DOCUMENT)


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (filename, mtime) that the cache does not hold with this very time: those to parse again."""
    return files.join(cache.select("filename", "mtime").distinct(), ["filename", "mtime"], "left_anti")


def json_file(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON file, one value over many lines, read by a declared schema; no rows where the file is missing."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def index_mentions(indices: DataFrame) -> DataFrame:
    """(term, chunk_id) of every element of the posting lists of index rows; null elements left out."""
    lists = indices.select(F.explode("term_to_chunks").alias("term", "ids"))
    return lists.select("term", F.explode("ids").alias("chunk_id")).where("chunk_id IS NOT NULL")


def index_edges(indices: DataFrame) -> DataFrame:
    """(old_name, new_name) of the name changes of index rows, each once, lower-cased."""
    lists = indices.select(F.explode("name_changes").alias("old_name", "names"))
    return lists.select(F.lower("old_name").alias("old_name"), F.explode("names").alias("n")).where("n IS NOT NULL").select("old_name", F.lower("n").alias("new_name")).distinct()


def detections(runs: DataFrame) -> DataFrame:
    """(run_id, identity, surname) of detection runs, names trimmed and lower-cased, nulls and blanks left out."""
    found = runs.select("run_id", F.explode("identities").alias("identity", "v"))
    return found.select("run_id", "identity", F.explode("v.families").alias("s")).select("run_id", "identity", F.lower(F.trim("s")).alias("surname")).where("surname <> ''")


def responses(lines: DataFrame, schema: str = "map<string,array<string>>") -> DataFrame:
    """(custom_id, identity, surname) of response lines (value): the JSON object of each, its reply's fenced JSON, and the map inverted to rows."""
    from inkwell.functions.text import json_block

    parsed = lines.select(F.from_json("value", "custom_id string, response string").alias("r")).select("r.custom_id", json_block(F.col("r.response"), schema).alias("m"))
    return parsed.select("custom_id", F.explode("m").alias("identity", "names")).select("custom_id", "identity", F.explode("names").alias("surname"))
