"""Files as tables: transcript lines, documents of many formats, and a place for what can't be read."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SUFFIXES = (".txt", ".md", ".csv", ".html", ".htm", ".rtf", ".docx", ".pptx", ".xlsx", ".epub", ".pdf")


def transcript_table(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): newline-JSON by a given schema; a line that doesn't parse is in the second, not an error."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = raw.select("value", raw.metadataColumn("_metadata")["file_path"].alias("file"), parsed.alias("r"))
    good = lines.where("r._corrupt_record IS NULL").select("r.*", "file").drop("_corrupt_record")
    return good, lines.where("r._corrupt_record IS NOT NULL").select("file", F.col("value").alias("line"))


def html_text(source: str) -> str:
    """Visible text of a page: without scripts, styles and tags; blocks on lines of their own."""
    s = re.sub(r"(?is)<(script|style|head|noscript)\b.*?</\1>|<!--.*?-->", " ", source)
    s = re.sub(r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/section|/article)\b[^>]*>", "\n", s)
    s = html.unescape(re.sub(r"<[^>]+>", " ", s))
    return "\n".join(x for x in (re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in s.split("\n")) if x)


def _xml_text(data: bytes, block: str, run: str) -> str:
    out = []
    for b in ElementTree.fromstring(data).iter():
        if b.tag.rpartition("}")[2] == block:
            out.append("".join(t.text or "" for t in b.iter() if t.tag.rpartition("}")[2] == run))
    return "\n".join(x for x in out if x.strip())


def _rtf_text(s: str) -> str:
    s = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)\b(?:[^{}]|\{[^{}]*\})*\}", "", s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), s)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", re.sub(r"\\par[d]?\b ?", "\n", s))).strip()


def document_text(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file by its suffix. A PDF needs a reader that is not part of the library."""
    kind = "." + name.lower().rsplit(".", 1)[-1]
    try:
        if kind in (".txt", ".md"):
            return data.decode("utf-8", "replace"), None
        if kind == ".csv":
            return "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(data.decode("utf-8", "replace")))), None
        if kind in (".html", ".htm"):
            return html_text(data.decode("utf-8", "replace")), None
        if kind == ".rtf":
            return _rtf_text(data.decode("latin-1")), None
        if kind == ".pdf":
            try:
                from pypdf import PdfReader
            except ImportError:
                return None, "no PDF reader installed"
            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages), None
        z = zipfile.ZipFile(io.BytesIO(data))
        if kind == ".docx":
            return _xml_text(z.read("word/document.xml"), "p", "t"), None
        if kind == ".pptx":
            slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
            return "\n".join(_xml_text(z.read(n), "p", "t") for n in slides), None
        if kind == ".xlsx":
            parts = ["xl/sharedStrings.xml"] if "xl/sharedStrings.xml" in z.namelist() else []
            return "\n".join(_xml_text(z.read(n), "si", "t") for n in parts), None
        if kind == ".epub":
            pages = [n for n in z.namelist() if n.endswith((".xhtml", ".html", ".htm"))]
            return "\n".join(html_text(z.read(n).decode("utf-8", "replace")) for n in pages), None
        return None, f"unknown suffix {kind}"
    except Exception as e:  # a broken file is a row with an error, not a failed job
        return None, f"{type(e).__name__}: {e}"[:200]


def documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, text, error) of all files below a folder with an accepted suffix, one row per file."""
    glob = "*.{" + ",".join(s[1:] for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            got = [document_text(n, d) for n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["path", "text", "error"])

    return files.mapInArrow(run, "path string, text string, error string")


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows to a Parquet table, in folders by the given columns."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def export_lines(df: DataFrame, path: str) -> None:
    """Newline-JSON, one object per row."""
    df.write.mode("overwrite").json(path)
