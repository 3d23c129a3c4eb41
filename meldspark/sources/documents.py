"""Text of DOCX and PDF files, without libraries: an Arrow-batched function of bytes."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Stands between the visible text of a PDF and the addresses its labels link to (a fixed value).
LINKS = "<<<__PDF_LINK_URIS__>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def docx_text(data: bytes) -> str:
    """Paragraphs of the body, a line each; tables are not read."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "\n".join("".join(marks.get(e.tag, e.text or "" if e.tag == f"{_W}t" else "") for e in p.iter()) for p in body.findall(f"{_W}p"))


def _unescape(m: re.Match) -> bytes:
    return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1])


def _shown(token: bytes) -> str:
    if token[:1] == b"<":
        digits = b"".join(token[1:-1].split())
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(_unescape, token[1:-1])
    return raw.decode("cp1252", "replace")


def _drawn(content: bytes) -> str:
    """Strings in order of drawing; a move to another height begins a line, a wide gap is a space."""
    out, strings, numbers, height = [], [], [], None
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<":
            strings.append(_shown(token))
        elif token[-1:].isdigit() or token[-1:] == b".":
            numbers.append(float(token))
            if numbers[-1] < -200 and strings:
                strings.append(" ")
        else:
            op = token.decode("latin-1")
            if op in ("Td", "TD") and numbers and numbers[-1] or op in ("T*", "'", '"'):
                out.append("\n")
            elif op in ("Td", "TD") and out and out[-1][-1:] not in "\n ":
                out.append(" ")
            elif op == "Tm" and numbers:
                out.append("\n" if numbers[-1] != height else " ")
                height = numbers[-1]
            if op in ("Tj", "TJ", "'", '"'):
                out += [s for s in strings if s]
            strings, numbers = [], []
    return "".join(out).strip("\n")


def pdf_text(data: bytes) -> str:
    """Text of plain and Flate streams in fonts of one byte a character. Fonts with their own
    encodings, encrypted files and scans give no text, which is an error like a broken file."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    parts, whole = [], [data]
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            body = zlib.decompressobj().decompress(m[1])
        except zlib.error:
            body = m[1]
        whole.append(body)
        if b"BT" in body and b"ET" in body:
            blocks = re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S)
            parts += [t for t in map(_drawn, blocks) if t]
    if not parts:
        raise ValueError("no text found")
    links = [_shown(u) for b in whole for u in re.findall(rb"/URI\s*(\((?:[^()\\]|\\.)*\))", b)]
    return "\n".join(parts) + ("\n" + "\n".join([LINKS, *links]) if links else "")


@F.pandas_udf(StructType().add("text", StringType()).add("error", StringType()))
def document_text(content: pd.Series, path: pd.Series) -> pd.DataFrame:
    """Text of each document, or why there is none; null content gives nulls."""
    rows = []
    for data, name in zip(content, path, strict=True):
        if data is None:
            rows.append((None, None))
            continue
        try:
            rows.append(((docx_text if name.lower().endswith(".docx") else pdf_text)(bytes(data)), None))
        except Exception as e:  # one bad file must not stop the others
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["text", "error"], dtype=object)
