"""Word, slide and workbook files from rows: the least that readers accept."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
_SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def clean(text: str) -> str:
    """Text without the characters that XML can't hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)


def _said(text: str) -> str:
    return escape(clean(text), {"\r": "&#13;"})


def _relations(*items: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_REL}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACK}/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def word_file(paragraphs: list[tuple[str, str]], tables: list[list[list[str]]] = (), images: list[bytes] = ()) -> bytes:
    """(style, text) paragraphs, tables of rows of cells, images."""
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr><w:r><w:t xml:space="preserve">{_said(text)}</w:t></w:r></w:p>' for style, text in paragraphs)
    cell = lambda c: f'<w:tc><w:p><w:r><w:t xml:space="preserve">{_said(c)}</w:t></w:r></w:p></w:tc>'
    t = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in rows) + "</w:tbl>" for rows in tables)
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in (1, 2, 3))
    rels = [("rId1", "styles", "styles.xml"), *((f"rIdImg{k}", "image", f"media/image{k}.png") for k in range(1, len(images) + 1))]
    media = {f"word/media/image{k}.png": i for k, i in enumerate(images, 1)}
    return _zip({"_rels/.rels": _relations(("rId1", "officeDocument", "word/document.xml")), "word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{p}{t}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{_WORD}">{styles}</w:styles>', "word/_rels/document.xml.rels": _relations(*rels)} | media)


def _body(text: str) -> str:
    return "<p:txBody>" + "".join(f"<a:p><a:r><a:t>{_said(line)}</a:t></a:r></a:p>" for line in text.split("\n")) + "</p:txBody>"


def slide_file(slides: list[tuple[list[str], list[list[list[str]]], str]]) -> bytes:
    """Slides of (texts, tables, note); all texts but the first stand in a group."""
    parts: dict[str, str | bytes] = {"_rels/.rels": _relations(("rId1", "officeDocument", "ppt/presentation.xml"))}
    ns = f'xmlns:a="{_DRAW}" xmlns:p="{_SLIDE}" xmlns:r="{_REL}"'
    for k, (texts, tables, note) in enumerate(slides, 1):
        shapes = [f"<p:sp>{_body(t)}</p:sp>" for t in texts]
        grids = ["<p:graphicFrame><a:graphic><a:graphicData><a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc>{_body(c)}</a:tc>" for c in row) + "</a:tr>" for row in rows) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>" for rows in tables]
        tree = f"{shapes[0] if shapes else ''}<p:grpSp>{''.join(shapes[1:])}</p:grpSp>{''.join(grids)}"
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        if note:
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = _relations(("rId1", "notesSlide", f"../notesSlides/notesSlide{k}.xml"))
            parts[f"ppt/notesSlides/notesSlide{k}.xml"] = f'<p:notes {ns}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="sldNum"/></p:nvPr></p:nvSpPr>{_body(str(k))}</p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr>{_body(note)}</p:sp></p:spTree></p:cSld></p:notes>'
    parts["ppt/_rels/presentation.xml.rels"] = _relations(*((f"rId{k}", "slide", f"slides/slide{k}.xml") for k in range(1, len(slides) + 1)))
    parts["ppt/presentation.xml"] = f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>"
    return _zip(parts)


def workbook_file(title: str, rows: list[list[str | float]], formulas: dict[str, str] | None = None, *, pivot: bool = True, images: list[bytes] = ()) -> bytes:
    """A sheet (texts as shared strings, formulas by cell) with images and, with
    ``pivot``, a pivot table whose cache holds all rows; texts are shared items."""
    strings: dict[str, int] = {}
    cells = []
    for r, row in enumerate(rows, 1):
        line = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            formula = (formulas or {}).get(at)
            if isinstance(v, str):
                line.append(f'<c r="{at}" t="s"><v>{strings.setdefault(clean(v), len(strings))}</v></c>')
            else:
                line.append(f'<c r="{at}">{f"<f>{escape(formula)}</f>" if formula else ""}<v>{v}</v></c>')
        cells.append(f'<row r="{r}">{"".join(line)}</row>')
    end = f"{chr(64 + len(rows[0]))}{len(rows)}"
    parts: dict[str, str | bytes] = {
        "_rels/.rels": _relations(("rId1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(title)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "sharedStrings", "sharedStrings.xml")),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{"".join(cells)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_SHEET}">' + "".join(f"<si><t>{_said(s)}</t></si>" for s in strings) + "</sst>",
    }
    sheet_relations = []
    if images:
        sheet_relations.append(("rIdD", "drawing", "../drawings/drawing1.xml"))
        parts["xl/drawings/drawing1.xml"] = f'<xdr:wsDr xmlns:xdr="{_DRAW}"/>'
        parts["xl/drawings/_rels/drawing1.xml.rels"] = _relations(*((f"rId{k}", "image", f"../media/image{k}.png") for k in range(1, len(images) + 1)))
        parts |= {f"xl/media/image{k}.png": i for k, i in enumerate(images, 1)}
    if pivot:
        sheet_relations.append(("rId1", "pivotTable", "../pivotTables/pivotTable1.xml"))
        heads, body = rows[0], rows[1:]
        shared = [list(dict.fromkeys(clean(r[k]) for r in body if isinstance(r[k], str))) for k in range(len(heads))]
        fields = "".join(f"<cacheField name={quoteattr(str(h))}><sharedItems>" + "".join(f"<s v={quoteattr(s)}/>" for s in items) + "</sharedItems></cacheField>" for h, items in zip(heads, shared))
        places = [{s: n for n, s in enumerate(items)} for items in shared]
        item = lambda k, v: f'<x v="{places[k][clean(v)]}"/>' if isinstance(v, str) else f'<n v="{v}"/>'
        parts |= {
            "xl/pivotTables/pivotTable1.xml": f'<pivotTableDefinition xmlns="{_SHEET}" name="Pivot1"/>',
            "xl/pivotTables/_rels/pivotTable1.xml.rels": _relations(("rId1", "pivotCacheDefinition", "../pivotCache/pivotCacheDefinition1.xml")),
            "xl/pivotCache/pivotCacheDefinition1.xml": f'<pivotCacheDefinition xmlns="{_SHEET}"><cacheSource type="worksheet"><worksheetSource ref="A1:{end}" sheet={quoteattr(title)}/></cacheSource><cacheFields>{fields}</cacheFields></pivotCacheDefinition>',
            "xl/pivotCache/_rels/pivotCacheDefinition1.xml.rels": _relations(("rId1", "pivotCacheRecords", "pivotCacheRecords1.xml")),
            "xl/pivotCache/pivotCacheRecords1.xml": f'<pivotCacheRecords xmlns="{_SHEET}">' + "".join("<r>" + "".join(item(k, v) for k, v in enumerate(r)) + "</r>" for r in body) + "</pivotCacheRecords>",
        }
    if sheet_relations:
        parts["xl/worksheets/_rels/sheet1.xml.rels"] = _relations(*sheet_relations)
    return _zip(parts)
