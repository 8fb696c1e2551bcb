"""Paragraphs as office, e-book and rich-text files: the smallest valid file of each kind, as bytes."""

from __future__ import annotations

import gzip
import io
import zipfile
from xml.sax.saxutils import escape

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
ODF = "urn:oasis:names:tc:opendocument:xmlns"


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def docx(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    return _zip({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'})


def xlsx(lines: list[str]) -> bytes:
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c></row>' for i in range(1, len(lines) + 1))
    shared = "".join(f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in lines)
    return _zip({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>', "xl/sharedStrings.xml": f'<sst xmlns="{S}">{shared}</sst>'})


def pptx(lines: list[str]) -> bytes:
    return _zip({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="urn:p" xmlns:a="{A}"><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:sld>' for i, x in enumerate(lines, 1)})


def odt(lines: list[str]) -> bytes:
    body = "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)
    return _zip({"content.xml": f'<office:document-content xmlns:office="{ODF}:office:1.0" xmlns:text="{ODF}:text:1.0">{body}</office:document-content>'})


def epub(lines: list[str]) -> bytes:
    return _zip({"OEBPS/c1.xhtml": "<html><body>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "</body></html>"})


def archive(lines: list[str]) -> bytes:
    return _zip({f"{i:05d}.txt": x for i, x in enumerate(lines)})


def rtf(lines: list[str]) -> bytes:
    def coded(c: str) -> str:
        if c in "\\{}":
            return "\\" + c
        return c if ord(c) < 128 else "".join(f"\\u{u - 65536 if u > 32767 else u}?" for u in memoryview(c.encode("utf-16-le")).cast("H"))

    return ("{\\rtf1\\ansi " + "".join("".join(map(coded, x)) + "\\par " for x in lines) + "}").encode("ascii")


def prproj(lines: list[str]) -> bytes:
    """An editing project of one sequence, named by the first line, and its media."""
    name, *media = lines
    clips = "".join(f"<Media><FilePath>{escape(x)}</FilePath></Media>" for x in media)
    return gzip.compress(f'<PremiereData Version="3"><Sequence><Name>{escape(name)}</Name></Sequence>{clips}</PremiereData>'.encode(), mtime=0)


WRITERS = {"prproj": prproj, "docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odt, "epub": epub, "zip": archive, "rtf": rtf}
