"""Readers from the bytes of a file to the texts of its pages.

Word, slide and PDF files need no library. Recognition of images needs one that is installed; where none is, it says so.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from lectern.sources import pdf

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SHAPES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _run_text(run: ElementTree.Element) -> str:
    """Text of a word run: tabs and breaks as they print."""
    signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}
    return "".join((x.text or "") if x.tag == f"{_WORD}t" else signs.get(x.tag, "") for x in run)


def read_docx(content: bytes, language: str = "") -> list[str]:
    """The paragraphs of the document's body, a line each, as one page; tables, headers and notes are not part of it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    runs = lambda p: (r for child in p for r in ([child] if child.tag == f"{_WORD}r" else child.findall(f"{_WORD}r") if child.tag == f"{_WORD}hyperlink" else ()))
    return ["\n".join("".join(map(_run_text, runs(p))) for p in (body if body is not None else ()) if p.tag == f"{_WORD}p")]


def _slides(z: zipfile.ZipFile) -> list[str]:
    """Names of the slides' parts in the order in which they are shown."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    order = ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_SHAPES}sldId")
    return ["ppt/" + links[x.get(f"{_LINK}id")].removeprefix("/ppt/") for x in order]


def read_pptx(content: bytes, language: str = "") -> list[str]:
    """Slides as one page: a mark for each, then the text shapes on its top level, the runs of each followed by blanks and its end by a line feed."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for number, part in enumerate(_slides(z), 1):
            out.append(f"\n--- slide{number} --\n")
            tree = ElementTree.fromstring(z.read(part)).find(f"{_SHAPES}cSld/{_SHAPES}spTree")
            for shape in tree.findall(f"{_SHAPES}sp") if tree is not None else ():
                frame = shape.find(f"{_SHAPES}txBody")
                if frame is not None:
                    texts = (t.text or "" for p in frame.findall(f"{_DRAW}p") for r in p.findall(f"{_DRAW}r") for t in r.findall(f"{_DRAW}t"))
                    out.append("".join(f"{t} " for t in texts) + "\n")
    return ["".join(out)]


def read_pdf(content: bytes, language: str = "") -> list[str]:
    """The text of each page; pages that are pictures have none, and encrypted files are an error."""
    return pdf.page_texts(content)


def read_image(content: bytes, language: str = "eng+tam") -> list[str]:
    """Recognised text of an image as one page."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("recognition of images needs pytesseract and Pillow, or a reader of your own") from e
    return [pytesseract.image_to_string(Image.open(io.BytesIO(content)), lang=language)]


def read_text(content: bytes, language: str = "") -> list[str]:
    """A UTF-8 text as one page; other bytes are an error. Line ends are read as line feeds."""
    return [re.sub("\r\n?", "\n", content.decode("utf-8"))]


#: Readers by kind of file, for ``files.read_pages``.
READERS = {".pdf": read_pdf, ".docx": read_docx, ".pptx": read_pptx, ".txt": read_text, ".jpg": read_image, ".jpeg": read_image, ".png": read_image}
