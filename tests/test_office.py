"""Readers of document files, on packages made here; files through Spark; SuperMinHash against its definition."""

import io
import math
import random
import struct
import zipfile

import pytest
import xxhash

from lexloom.functions import office, sketches
from lexloom.functions.plain import fold
from lexloom.sources.files import read_documents, read_files


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="urn:w" xmlns:r="urn:r"'
DOCX = package(**{
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    "word/_rels/document.xml.rels": '<R><Relationship Id="r1" TargetMode="External" Target="https://example.org/"/></R>',
    "word/document.xml": f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Ti</w:t></w:r><w:r><w:t>tle</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space="preserve">One </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">two </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>a</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>b</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x|y</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>""",
})


def test_docx():
    assert office.to_markdown(DOCX, "docx") == "## Title\n\nOne **two** [link](https://example.org/)\n\n1. a\n2. b\n\n| x\\|y | z |\n| --- | --- |\n| 1 |  |"
    assert office.to_text(DOCX, "docx") == "Title\n\nOne two link (https://example.org/)\n\n1. a\n2. b\n\nx|y | z\n1 | "


def test_xlsx_and_pptx():
    book = package(**{
        "xl/workbook.xml": '<w xmlns:r="urn:r"><sheets><sheet name="S1" r:id="a"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="a" Target="worksheets/s.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/worksheets/s.xml": '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2"><v>4.5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></w>',
    })
    assert office.to_markdown(book, "xlsx") == "## S1\n\n| head |  | rich |\n| --- | --- | --- |\n|  | 4.5 | TRUE |"
    show = package(**{
        "ppt/presentation.xml": '<p xmlns:r="urn:r"><sldIdLst><sldId id="256" r:id="b"/><sldId id="257" r:id="a"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="a" Target="slides/1.xml"/><Relationship Id="b" Target="/ppt/slides/2.xml"/></R>',
        "ppt/slides/1.xml": "<s><sp><txBody><p><r><t>last</t></r></p></txBody></sp></s>",
        "ppt/slides/2.xml": '<s><sp><nvSpPr><nvPr><ph type="title"/></nvPr></nvSpPr><txBody><p><r><t>First</t></r></p></txBody></sp></s>',
    })
    assert office.to_markdown(show, "pptx") == "# First\n\nlast"


def test_open_document_and_epub():
    text = package(**{"content.xml": '<d xmlns:t="urn:t" xmlns:x="urn:x"><body><text><t:h t:outline-level="3">H</t:h><t:p>a<t:s t:c="2"/>b <t:a x:href="u">l</t:a> c</t:p><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list></text></body></d>'})
    assert office.to_markdown(text, "odt") == "### H\n\na  b [l](u) c\n\n- i"
    sheet = package(**{"content.xml": '<d xmlns:t="urn:t"><body><spreadsheet><t:table t:name="S"><t:table-row><t:table-cell t:number-columns-repeated="2"><t:p>v</t:p></t:table-cell><t:table-cell t:number-columns-repeated="9999"/></t:table-row><t:table-row t:number-rows-repeated="1000000"><t:table-cell/></t:table-row></t:table></spreadsheet></body></d>'})
    assert office.to_text(sheet, "ods") == "S\n\nv | v | "
    book = package(**{
        "META-INF/container.xml": '<c><rootfile full-path="O/b.opf"/></c>',
        "O/b.opf": '<p><manifest><item id="1" href="a%20b.xhtml"/><item id="2" href="c.xhtml"/></manifest><spine><itemref idref="2"/><itemref idref="1"/></spine></p>',
        "O/a b.xhtml": "<p>second</p>",
        "O/c.xhtml": "<h1>first</h1>",
    })
    assert office.to_markdown(book, "epub") == "# first\n\nsecond"


def test_rtf_and_csv():
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\unknown x}caf\'e9 \u8364?\uc2 \u-10179??\u-8704??\par {\b a\{b\}}\~c\bin3 }}}\tab z}"
    assert office.to_text(rtf, "rtf") == "café €\U0001f600\n\na{b}\xa0c\tz"
    assert office.to_markdown(b"a;b\n1;\"x;y\"\n\n2", "csv") == "| a | b |\n| --- | --- |\n| 1 | x;y |\n| 2 |  |"
    assert office.to_markdown(b"", "csv") == "" and office.to_text(b"{\\rtf1}", "rtf") == ""


@pytest.mark.parametrize("kind", office.FORMATS[:8])
def test_broken_files(kind):
    rng = random.Random(3)
    bomb = package(**{"content.xml": '<!DOCTYPE d [<!ENTITY a "x">]><d>&a;</d>', "word/document.xml": "<a>", "META-INF/container.xml": "<a/>"})
    for data in (b"", b"PK\x03\x04", bomb, DOCX[:300], bytes(rng.randrange(256) for _ in range(500))):
        with pytest.raises(ValueError):
            office.to_text(data, kind)


def test_files(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.txt": b"{\\rtf1 hello}", "c.tsv": b"a\tb", "d.pdf": b"%PDF-1.7", "e": b"?", "f.csv": b"x" * 5000}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.format, r.value, r.error) for r in read_documents(spark, str(tmp_path), True, 4000).collect()}
    assert got["b.txt"] == ("rtf", "hello", None) and got["c.tsv"] == ("csv", "a | b", None)
    assert got["a.docx"][0] == "docx" and got["a.docx"][1].startswith("Title")
    assert got["d.pdf"] == ("pdf", None, "no reader for pdf")
    assert got["e"] == (None, None, "unknown format") and got["f.csv"] == ("csv", None, "larger than max_bytes")
    assert read_files(spark, str(tmp_path), 100).where("content IS NULL").count() == 2


def test_superminhash():
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("abcdefghijklm") * rng.randint(1, 9) for _ in range(n))
    m, text = 16, words(50)
    tokens = [t.encode() for t in fold(text)]
    least = [math.inf] * m
    for shingle in {sketches._hash(tokens[i : i + 3]) for i in range(len(tokens) - 2)}:
        draws = sketches.split_mix(xxhash.xxh64_intdigest(struct.pack("<QQQ", 2, 9, shingle)))
        left = list(range(m))
        for j in range(m):
            r = ((next(draws) >> 11) + 0.5) * 2.0**-53
            k = j + next(draws) % (m - j)
            left[j], left[k] = left[k], left[j]
            least[left[j]] = min(least[left[j]], j + r)
    want = [struct.unpack("<Q", struct.pack("<d", x))[0] for x in least]
    assert sketches.superminhash_signature(text, m, seed=9) == want == sketches.superminhash_signature(text, m, seed=9, block=7)
    assert sketches.superminhash_signature("a b") == [sketches.EMPTY] * 128
    # half of the words in common
    shared, a, b = (" ".join(f"{x}{i}" for i in range(300)) for x in "sab")
    near = sketches.minhash_jaccard(sketches.superminhash_signature(f"{shared} {a}", 512), sketches.superminhash_signature(f"{shared} {b}", 512))
    assert abs(near - 1 / 3) < 0.08
