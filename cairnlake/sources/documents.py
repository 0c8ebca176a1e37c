"""Text of documents from their bytes, by extension, and the identity of content."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text kept per document, as the feature asks; whole where it is None.
TEXT_CAP = 256 << 10
WHOLE = 16 << 20
SAMPLE = 64 << 10
PLAIN = frozenset("txt md csv log json yaml yml xml rtf".split())
#: Parts of zipped formats that hold text, and the names of their text elements.
ZIPPED = {
    "docx": (r"word/(document|header\d*|footer\d*|footnotes)\.xml$", {"t"}, {"p"}), "pptx": (r"ppt/slides/slide\d+\.xml$", {"t"}, {"p"}),
    "xlsx": (r"xl/(sharedStrings|worksheets/sheet\d+)\.xml$", {"t"}, {"si", "row"}), "odt": (r"content\.xml$", {"p", "h", "span"}, {"p", "h"}),
}


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "head")
        self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0
        self.out.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def _html(data: bytes) -> str:
    page = _Visible()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    return " ".join("".join(page.out).split())


def text_runs(xml: bytes, names: set[str], breaks: set[str]) -> str:
    """The text of elements with these local names; elements in breaks end a line."""
    out: list[str] = []
    for _, e in ElementTree.iterparse(io.BytesIO(xml), events=("end",)):
        local = e.tag.rpartition("}")[2]
        if local in names and e.text:
            out.append(e.text)
        if local in breaks:
            out.append("\n")
        if local in names and e.tail and "span" in names:
            out.append(e.tail)
    return "\n".join(line for line in (" ".join(x.split()) for x in "".join(out).split("\n")) if line)


def extract_text(data: bytes | None, extension: str | None, cap: int | None = TEXT_CAP) -> str | None:
    """The text of a document, cut at a byte cap on a character; None if it cannot be read."""
    if data is None:
        return None
    kind = (extension or "").lower()
    try:
        if kind in PLAIN:
            text = data.decode("utf-8", "replace")
        elif kind in ("html", "htm", "xhtml"):
            text = _html(data)
        elif kind in ZIPPED or kind == "epub":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if kind == "epub":
                    text = "\n".join(_html(z.read(n)) for n in sorted(z.namelist()) if re.search(r"\.x?html?$", n))
                else:
                    pattern, names, breaks = ZIPPED[kind]
                    text = "\n".join(text_runs(z.read(n), names, breaks) for n in sorted(z.namelist()) if re.match(pattern, n))
        else:
            return None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError):
        return None
    return text if cap is None else text.encode()[:cap].decode("utf-8", "ignore")


def content_identity(data: bytes) -> str:
    """SHA-256 of content; beyond 16 MiB of its head, four inner samples, its tail and its size."""
    if len(data) <= WHOLE:
        return hashlib.sha256(data).hexdigest()
    h = hashlib.sha256(data[:SAMPLE])
    for i in range(1, 5):
        at = len(data) * i // 5
        h.update(data[at : at + SAMPLE])
    h.update(data[-SAMPLE:] + len(data).to_bytes(8, "little"))
    return h.hexdigest()


def with_text(files: DataFrame, cap: int | None = TEXT_CAP) -> DataFrame:
    """(path, text, identity) of files (path, content), as spark.read.format("binaryFile") gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(extract_text(c, p.rpartition(".")[2], cap), content_identity(c or b"")) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["path", "text", "identity"])

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, "path string, text string, identity string")
