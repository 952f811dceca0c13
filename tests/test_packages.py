"""Packages of small parts: what they take, and that the short ways through them end where the long ones do."""

import io
import zipfile

import pytest

from vellum.formats import ooxml

_DOC = {
    "paragraphs": [{"index": 0, "text": "a & b", "style": "Heading 2", "runs": [{"text": "a & "}, {"text": "b", "bold": True, "hyperlink_url": "http://x/?a&b"}]}, {"index": 1, "text": "q\tü", "style": "My <Style>"}],
    "tables": [{"index": 0, "rows": [{"cells": [{"text": "c"}, {"text": "d\ne"}]}]}],
    "document_order": [{"type": "paragraph", "index": 0}, {"type": "table", "index": 0}, {"type": "paragraph", "index": 1}],
}


def copy(package: bytes, comment: bytes = b"", method: int = zipfile.ZIP_DEFLATED, **changed: bytes) -> bytes:
    """The package as zipfile writes it; `changed` has new bodies by the part's name up to its suffix."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as z, zipfile.ZipFile(out, "w", method) as w:
        for name in z.namelist():
            w.writestr(name, changed.get(name.rpartition("/")[2].partition(".")[0], z.read(name)))
        w.comment = comment
    return out.getvalue()


@pytest.fixture
def no_zipfile(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("zipfile was asked")

    monkeypatch.setattr(ooxml.zipfile, "ZipFile", refuse)


def test_a_plain_docx_is_written_and_read_without_zipfile(no_zipfile):
    """zipfile took more than half of a round trip's time."""
    back = ooxml.read_docx(ooxml.write_docx(_DOC))
    assert [p["text"] for p in back["paragraphs"]] == ["a & b", "q\tü"] and [p["style"] for p in back["paragraphs"]] == ["Heading 2", "My <Style>"]
    assert [(r["text"], r["bold"], r["hyperlink_url"]) for r in back["paragraphs"][0]["runs"]] == [("a & ", None, None), ("b", True, "http://x/?a&b")]
    assert [c["text"] for c in back["tables"][0]["rows"][0]["cells"]] == ["c", "d\ne"]


@pytest.mark.parametrize("write", [ooxml.write_docx, ooxml.write_pptx])
def test_packages_are_sound_archives(write):
    made = write(_DOC)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_DEFLATED}
        assert {(i.date_time, i.external_attr >> 16) for i in z.infolist()} == {((1980, 1, 1, 0, 0, 0), 0o600)}
    assert write(_DOC) == made


def test_other_archives_read_alike():
    """With a comment, stored, in another method, or with something before and a large part."""
    made = ooxml.write_docx(_DOC)
    want = ooxml.read_docx(made)
    large = ooxml.write_docx({**_DOC, "paragraphs": [*_DOC["paragraphs"], {"index": 2, "text": "long " * 50_000}], "document_order": []})
    for other in (copy(made, b"note"), copy(made, method=zipfile.ZIP_STORED), copy(made, method=zipfile.ZIP_LZMA), b"before" + made):
        assert ooxml.read_docx(other) == want
    assert ooxml.read_docx(large)["paragraphs"][-1]["text"] == "long " * 50_000


def test_names_that_are_not_ascii_and_bytes_that_are_damaged():
    with zipfile.ZipFile(io.BytesIO(ooxml._archive({"ä.xml": "<a/>", "b.bin": b"\0"}))) as z:
        assert z.namelist() == ["ä.xml", "b.bin"] and z.read("ä.xml") == b"<a/>" and z.read("b.bin") == b"\0"
    made = ooxml.write_docx(_DOC)
    for n in (0, 10, len(made) // 2, len(made) - 3):
        with pytest.raises(ValueError, match="not a package"):
            ooxml.read_docx(made[:n])
    at = made.index(b"word/document.xml") + 60
    with pytest.raises((zipfile.BadZipFile, ooxml.zlib.error)):
        ooxml.read_docx(made[:at] + bytes([made[at] ^ 255]) + made[at + 1 :])


def test_what_is_remembered_is_not_handed_out():
    made = ooxml.write_docx(_DOC)
    first = ooxml.read_docx(made)
    first["styles"][0]["name"] = "changed"
    first["paragraphs"][0]["runs"][0]["bold"] = True
    assert ooxml.read_docx(made)["styles"][0]["name"] == "Normal" and ooxml.read_docx(made)["paragraphs"][0]["runs"][0]["bold"] is None


def _deck(n: int) -> bytes:
    return ooxml.write_pptx({"paragraphs": [{"index": i, "text": f"t{i}"} for i in range(n)], "document_order": [{"type": "paragraph", "index": i} for i in range(n)]})


def test_small_slides_are_parsed_at_one_go(monkeypatch, no_zipfile):
    """A parser for each slide took most of the time of reading a deck."""
    made, seen, parse = _deck(40), [], ooxml.ET.fromstring
    monkeypatch.setattr(ooxml.ET, "fromstring", lambda x: seen.append(len(x)) or parse(x))
    assert [p["text"] for p in ooxml.read_pptx(made)["paragraphs"]] == [f"t{i}" for i in range(40)]
    assert len(seen) <= 3


@pytest.mark.parametrize("body", [b"", b"<a>", b"</x1><x1>", b"<a/></x1><x1><b/>", b"<a/><b/>", b"text", b"<a/>text", b"&#32;<a/>", b"<!DOCTYPE a><a/>", b"<a/><!--"])
def test_a_slide_that_is_not_plain_touches_no_other(monkeypatch, body):
    """As if every slide were parsed alone: here by a package that never knows its parts' sizes."""
    head = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    made = copy(_deck(3), slide2=head + body)
    got = ooxml.read_pptx(made)
    monkeypatch.setattr(ooxml._Package, "small", lambda *_: False)
    assert got == ooxml.read_pptx(made)
    assert [p["text"] for p in got["paragraphs"]] == ["t0", "t2"] and len(got["slides"]) == 3


def test_large_slides_are_read_one_by_one(monkeypatch):
    made, seen, parse = ooxml.write_pptx({"paragraphs": [{"index": i, "text": f"{i} " * 20_000} for i in range(3)]}), [], ooxml.ET.fromstring
    monkeypatch.setattr(ooxml.ET, "fromstring", lambda x: seen.append(len(x)) or parse(x))
    assert [len(p["text"]) for p in ooxml.read_pptx(made)["paragraphs"]] == [40_000] * 3 and sum(x > 40_000 for x in seen) == 3 and max(seen) < 80_000
