"""Readers, writers and edits on golden cases, and properties that hold for any document."""

import random

import pytest

from vellum.formats import edit as E
from vellum.formats import html_reader, markdown_reader, ooxml, pdf, writers


def md(text, **how):
    return markdown_reader.read_markdown(text, **how)


def test_markdown_blocks():
    d = md("# T\n\ntext **b** [l](u)\n\n* x\n  - y\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert [(p["text"], p.get("style")) for p in d["paragraphs"]] == [("T", "Heading 1"), ("text **b** [l](u)", None), ("x", None), ("y", None)]
    assert [r["text"] for r in d["paragraphs"][1]["runs"]] == ["text ", "b", " [l](u)"]
    assert [p["list_info"]["indent_level"] for p in d["paragraphs"][2:]] == [0, 1]
    assert d["tables"][0]["row_count"] == d["tables"][0]["column_count"] == 2
    assert [(o["type"], o["index"]) for o in d["document_order"]] == [("paragraph", i) for i in range(4)] + [("table", 0)]


def test_markdown_heading_with_text_below_is_plain():
    assert md("# H\ntext")["paragraphs"][0]["text"] == "# H\ntext"


def test_markdown_profiles():
    assert md("text **b** [l](u)", profile="chunking")["paragraphs"][0]["text"] == "text b l"
    assert markdown_reader.visible("`**bold**`") == "bold"
    assert md("```py\nx_1 = 2\n\n~~~\n```\nafter")["paragraphs"][0] | {"runs": 0} == {"index": 0, "source": {"format": "markdown"}, "text": "x_1 = 2\n\n~~~", "style": "CodeBlock", "code_fence_language": "py", "is_bullet": False, "is_numbered": False, "runs": 0}
    assert md("```\nno end")["paragraphs"][0]["text"] == "no end"
    assert md("a ![x](d/p.png) ![](q)")["media"][0]["file_name"] == "p.png"


def test_html_inline_spaces_and_css():
    d = html_reader.read_html("<p><strong>Note:</strong> Service <em>x</em></p><p style='color: rgb(255, 0, 10); font-size:1.5em'>y")
    assert d["paragraphs"][0]["text"] == "Note:Servicex" and len(d["paragraphs"][0]["runs"]) == 3
    assert d["paragraphs"][1]["runs"][0]["color_rgb"] == "#ff000a" and d["paragraphs"][1]["runs"][0]["font_size_pt"] == 18.0


def test_html_structure():
    d = html_reader.read_html(
        "<!DOCTYPE html><html lang=de><head><title> T </title></head><body><!-- c --><ul><li>a<ol start=3><li>b<li>c</ol><li>d</ul><hr>"
        "<table><caption>Cap</caption><tr><th colspan=2>h<tr></tr><tr><td>x<td><table><tr><td>in</table></table>"
        "<dl><dt>t<dd>d</dl><fieldset><legend>L</legend><input placeholder=p></fieldset><button>B</button><p dir=rtl>r<img src='i/a.png' width=3>"
    )
    got = [(p["text"], p.get("style"), p.get("numbering_format"), p.get("list_level")) for p in d["paragraphs"]]
    assert got == [
        ("c", None, None, None), ("a", None, "bullet", 0), ("b", None, "3.", 1), ("c", None, "4.", 1), ("d", None, "bullet", 0), ("---", "HorizontalRule", None, None), ("Cap", "TableCaption", None, None),
        ("t", "DefinitionTerm", None, None), ("d", "DefinitionData", None, None), ("L", "Legend", None, None), ("p", None, None, None), ("B", None, None, None), ("r", None, None, None),
    ]
    assert [r["row_index"] for r in d["tables"][0]["rows"]] == [0, 2] and d["tables"][0]["rows"][1]["cells"][1]["nested_table_indices"] == [1]
    assert d["metadata"]["title"] == "T" and d["media"][0]["file_name"] == "a.png" and d["media"][0]["width_emu"] == 3


def test_order_of_edits():
    doc = {"paragraphs": [{"text": "a"}, {"text": "b"}], "tables": [{}], "media": [{}], "document_order": [{"type": "paragraph", "index": 0}, {"type": "paragraph", "index": 5}, {"type": "table", "index": 0}, {"type": "paragraph", "index": 0}]}
    order = lambda s: [o["type"][0] + str(o["index"]) for o in E.edit(doc, [{"op": "remove_empty_paragraphs"}], s)["document_order"]]
    assert order(False) == ["p0", "t0", "m0", "p1"] and order(True) == ["p0", "t0", "p1", "m0"]


def test_replace_text_counts_over_runs():
    doc = {"paragraphs": [{"index": 0, "text": "xaa", "runs": [{"text": "xa"}, {"text": "a"}]}]}
    out = E.edit(doc, [{"op": "replace_text", "path": "/paragraphs/0/text", "old_value": "a", "new_value": "b", "count": 1}])["paragraphs"][0]
    assert (out["text"], [r["text"] for r in out["runs"]]) == ("xba", ["xb", "a"])
    across = E.edit(doc, [{"op": "replace_text", "path": "/paragraphs/0/text", "old_value": "aa", "new_value": "z"}])["paragraphs"][0]
    assert (across["text"], len(across["runs"])) == ("xz", 1)
    assert E.edit({"paragraphs": [{"text": "t", "runs": []}]}, [{"op": "remove_empty_paragraphs"}])["paragraphs"][0]["text"] == ""


def test_tables_and_errors():
    doc = {"tables": [{"index": 0, "rows": [{"row_index": 0, "cells": [{"text": "a"}]}, {"row_index": 1, "cells": [{"text": "b"}]}]}]}
    out = E.edit(doc, [{"op": "insert_table_column", "path": "/tables/0", "index": 0, "value": ["x", "y"]}])["tables"][0]
    assert writers.cell_texts(out) == [["a", "x"], ["b", "y"]] and out["column_count"] == 2
    for bad in ({"op": "insert_table_column", "path": "/tables/0", "index": 0, "value": [1, 2, 3]}, {"op": "remove", "path": "a/b"}, {"op": "remove", "path": "/"}, {"op": "nope"}, {"op": "add_slide"}, {"op": "remove_table", "index": 4}, {"op": "replace", "path": "/none/0"}):
        with pytest.raises(ValueError, match="instruction 0"):
            E.edit(doc, [bad])
    assert E.tokens_of("/a~1b/0") == ["a/b", "0"]


def test_slides():
    ps = [{"index": i, "text": f"p{i}", "runs": [{"text": f"p{i}"}]} for i in range(3)]
    doc = {"paragraphs": ps, "slides": [{"index": 0, "title": "A", "paragraph_indices": [0]}, {"index": 1, "title": "B", "paragraph_indices": [1, 2]}]}
    run = lambda *steps: E.edit(doc, list(steps), True)
    assert [s["title"] for s in run({"op": "swap_slides", "index": 0, "target_index": 1})["slides"]] == ["B", "A"]
    assert [s["title"] for s in run({"op": "move_slide", "index": 1, "target_index": -1})["slides"]] == ["B", "A"]
    two = run({"op": "duplicate_slide", "index": 1, "target_index": 0, "value": {"title": "C"}})
    assert [(s["title"], s["paragraph_indices"], s["index"]) for s in two["slides"]] == [("A", [0], 0), ("C", [3, 4], 2), ("B", [1, 2], 1)]
    gone = run({"op": "remove_slide", "index": 0})
    assert [p["text"] for p in gone["paragraphs"]] == ["p1", "p2"] and gone["slides"][0]["paragraph_indices"] == [0, 1]
    new = run({"op": "insert_paragraph_after", "index": 0, "value": "n"})
    assert new["slides"][0]["paragraph_indices"] == [0, 1] and new["slides"][1]["paragraph_indices"] == [2, 3]
    assert run({"op": "replace_text_in_slide", "index": 1, "old_value": "p", "new_value": "q"})["paragraphs"][0]["text"] == "p0"
    assert run({"op": "add_slide", "index": 0, "value": {"title": "N"}})["slides"][1]["index"] == 2


def test_edit_keeps_order_a_permutation():
    for seed in range(40):
        r = random.Random(seed)
        doc = md("# a\n\nb\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\nc\n\nd ![i](j)")
        steps = []
        for _ in range(6):
            n = len(E.edit(doc, steps)["paragraphs"])
            steps.append(r.choice([{"op": "insert_paragraph_after", "index": r.randrange(n), "value": "new"}, {"op": "add", "path": "/paragraphs/-", "value": {"text": "z"}}, {"op": "add", "path": "/paragraphs/0", "value": {"text": "first", "runs": [{"text": "first"}]}}, {"op": "insert_table_after", "index": 0, "value": [["q"]]}] + [{"op": "remove_paragraph", "index": r.randrange(n)}] * (n > 1)))
        out = E.edit(doc, steps)
        for kind, name in E.KINDS.items():
            assert sorted(o["index"] for o in out["document_order"] if o["type"] == kind) == list(range(len(out[name])))
        assert [p["index"] for p in out["paragraphs"]] == list(range(len(out["paragraphs"])))
        assert not any(k.startswith("_") for p in out["paragraphs"] for k in p)


def test_text_and_markdown_writers():
    table = {"index": 0, "rows": [{"cells": [{"text": "1"}, {"text": "2"}]}]}
    assert writers.write_text({"paragraphs": [{"index": 0, "text": "a", "is_bullet": True}], "tables": [table]}) == "- a\n\n1 | 2\n"
    table = {"index": 0, "rows": [{"cells": [{"text": "a"}, {"text": "b"}]}, {"cells": [{"text": "c"}]}]}
    assert writers.write_markdown({"paragraphs": [{"index": 0, "text": "X", "style": "Heading 2"}], "tables": [table]}) == "## X\n\n| a | b |\n| --- | --- |\n| c |  |\n"


def test_html_writer_patches_the_source():
    page = "<html><body><div class='k'><p>one</p><p>two</p></div></body></html>"
    doc = html_reader.read_html(page)
    out = writers.write_html(E.edit(doc, [{"op": "replace", "path": "/paragraphs/1/text", "value": "2"}, {"op": "insert_paragraph_after", "index": 1, "value": "three"}]))
    assert '<div class="k"><p>one</p><p>2</p><p>three</p></div>' in out


def test_package_round_trips():
    doc = md("# T\n\ntext **b** x\n\n* y\n\n1. z\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    back = ooxml.read_docx(ooxml.write_docx(doc))
    assert [p["text"] for p in back["paragraphs"]] == ["T", "text b x", "y", "z"] and writers.cell_texts(back["tables"][0]) == [["a", "b"], ["1", "2"]]
    assert back["paragraphs"][1]["runs"][1]["bold"] is True and back["paragraphs"][0]["style"] == "Heading 1" and back["paragraphs"][3]["is_numbered"]
    deck = ooxml.read_pptx(ooxml.write_pptx(doc))
    again = ooxml.read_pptx(ooxml.write_pptx(deck))
    assert again["slides"] == deck["slides"] and len(deck["slides"]) == 5
    with pytest.raises(ValueError, match="package"):
        ooxml.read_docx(b"no zip")
    assert ooxml.resolve("ppt/slides/slide1.xml", "../media/i.png") == "ppt/media/i.png"
    assert ooxml.body_lines([" a ", "A", "t", "b"], "T") == ["a", "b"]


def test_pdf():
    doc = {"document_order": [{"type": "paragraph", "index": 0}, {"type": "paragraph", "index": 1}], "paragraphs": [{"index": 0, "text": "Head (1) \\", "style": "Heading 1", "page_index": 0}, {"index": 1, "text": "body " * 300, "page_index": 1}]}
    raw = pdf.write_pdf(doc, "Title")
    back = pdf.read_pdf(raw)["paragraphs"]
    assert [p["text"].strip() for p in back] == ["Title", "Head (1) \\", ("body " * 300).strip()] and [p["page_index"] for p in back] == [0, 0, 1]
    assert [p["style"] for p in back] == ["Heading 1", "Heading 2", "Normal"]
    assert pdf.body_size([12, 12, 12.5, 14, 18]) == 12 and pdf.heading_levels([12, 12.5, 14, 18], 12) == {18: "Heading 1", 14: "Heading 2"}
    assert pdf.list_type("• x") == "bullet:•" and pdf.list_type("3. x") == "decimal:3." and pdf.list_type("x") is None
    assert pdf.fit_image(936, 100) == (468.0, 50.0) and pdf.fit_image(10, 10) == (10, 10)
    for bad in (b"x", b"%PDF-1.4 /Encrypt 3 0 R"):
        with pytest.raises(ValueError, match="PDF|encrypted"):
            pdf.read_spans(bad)


def test_sliding_chunks_overlap():
    text = "".join(f"Sentence number {i} is here. " for i in range(200))
    out = pdf.sliding_chunks([(" ", text)])
    assert all(len(c) <= 800 for c in out) and all(c.endswith(".") for c in out)
    words = [w for c in out for w in c.split()]
    assert set(text.split()) == set(words)
    assert pdf.cut_at_boundary("a" * 900)[0] == "a" * 800


def test_null_fields_can_be_edited(spark):
    from vellum.schema import CELL, MEDIA, PARAGRAPH, RUN, TABLE

    from vellum.sources import documents as D

    text = "One\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![x](y.png)\n"
    docs = D.extract(spark.createDataFrame([(1, text.encode(), "md")], "id long, content binary, extension string"))
    for path, fields in {
        "/paragraphs/0": [f for f in PARAGRAPH.fields if f.name in ("alignment", "code_fence_language", "page_index", "list_info")],
        "/paragraphs/0/runs/0": [f for f in RUN.fields if f.name in ("bold", "font_name", "font_size_pt", "hyperlink_url")],
        "/tables/0": [f for f in TABLE.fields if f.name in ("style", "page_index")],
        "/tables/0/rows/0/cells/0": [f for f in CELL.fields if f.name in ("colspan", "rowspan")],
        "/media/0": [f for f in MEDIA.fields if f.name in ("width_emu", "height_emu", "local_url")],
    }.items():
        steps = [{"op": " Replace ", "path": f"{path}/{f.name}", "value": None} for f in fields]
        got = D.edit(docs, steps).select("applied_instructions", "error").first()
        assert (got.error, got.applied_instructions) == (None, len(steps))


@pytest.mark.parametrize(("text", "want"), [
    ("+ a", "bullet:•"), ("▸ a", "bullet:•"), ("∙ a", "bullet:•"), ("■ a", None), ("— a", None), ("(1) a", None),
    ("iv) a", "decimal:iv)"), ("12. a", "decimal:12."), ("b) a", "decimal:b)"), ("mild. a", "decimal:mild."), ("word. a", None),
])
def test_pdf_list_marks(text, want):
    from vellum.formats.pdf import list_type

    assert list_type(text) == want


def test_page_text_is_cut_at_sentences_and_words():
    from vellum.formats.pdf import boundary, carried, cut_at_boundary

    assert boundary("aaaa bbbb. cccc. dddd eeee", 20) == 17 and boundary("a. bbbb cccc dddd", 12) == 8
    assert boundary("x" * 30, 20) == 20 and boundary("a bcdefghijklmnop", 12) == 12
    assert carried("one two three", 7) == "three" and carried("onetwothree", 4) == "hree" and carried("one", 3) == "" == carried("one two", 0)
    assert cut_at_boundary("aaaa bbbb. cccc. dddd eeee", 20, 7) == ("aaaa bbbb. cccc.", "cccc. dddd eeee")
    assert cut_at_boundary("aaaabbbb.", 9, 4) == ("aaaabbbb.", "bbb.")


def test_chunk_files_by_strategy(spark):
    from vellum.sources import documents as D

    made = pdf.write_pdf({"paragraphs": [{"index": 0, "text": "Head", "style": "Heading 1", "runs": []}, {"index": 1, "text": "body text", "runs": []}], "document_order": [{"type": "paragraph", "index": 0}, {"type": "paragraph", "index": 1}]}, None)
    rows = [("a.pdf", made), ("b.txt", b"some text"), ("c.pdf", b"not a pdf"), ("d.xyz", b"x"), ("e.pdf", None), ("f.md", b"")]
    files = spark.createDataFrame(rows, "filename string, content binary")
    simple = {r.filename: r for r in D.chunk_files(files).collect()}
    assert simple["a.pdf"].chunks == ["Head body text"] and simple["b.txt"].chunks == ["some text"]
    assert all(simple[n].chunks == [] for n in ("c.pdf", "d.xyz", "e.pdf", "f.md")) and simple["d.xyz"].error
    structured = {r.filename: r.chunks for r in D.chunk_files(files, strategy="structured").collect()}
    assert structured["a.pdf"] == ["Head\nbody text"] and structured["b.txt"] == ["some text"]
    with pytest.raises(ValueError):
        D.chunk_files(files, strategy="other")


def test_a_damaged_slide_loses_only_itself():
    import io
    import zipfile

    made = ooxml.write_pptx({"paragraphs": [{"index": i, "text": f"t{i}", "style": "Heading 1", "runs": []} for i in range(3)], "document_order": [{"type": "paragraph", "index": i} for i in range(3)]}, None)
    old, out = zipfile.ZipFile(io.BytesIO(made)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            body = old.read(n)
            if n == "ppt/slides/slide2.xml":
                body = body[: len(body) // 2]
            if n == "ppt/slides/slide3.xml":
                body = body.replace(b"<a:p>", b'<a:p><a:pPr lvl="odd"/>')
            z.writestr(n, body)
    whole, got = ooxml.read_pptx(made), ooxml.read_pptx(out.getvalue())
    assert len(got["slides"]) == len(whole["slides"]) >= 3 and [s["index"] for s in got["slides"]] == list(range(len(got["slides"])))
    assert got["slides"][1]["paragraph_indices"] == [] and "t0" in got["slides"][0]["text"] and "t2" in got["slides"][2]["text"]
