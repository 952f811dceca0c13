"""Column plans, relational operators, sources and queries in Spark."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum import queries as Q
from vellum.functions import text as X
from vellum.plans import chunking as C
from vellum.plans import extract_text as ET
from vellum.sources import documents as D


def one(spark, value, kind, use):
    return spark.createDataFrame([(value,)], f"x {kind}").select(use(F.col("x")).alias("y")).first().y


def test_text_blocks(spark):
    text = "Intro line\ncontinued\n- a\n- b\n\n3) third\ntail"
    got = one(spark, text, "string", lambda c: ET.paragraphs(c))
    assert [(p.text, p.is_bullet, p.numbering_format) for p in got] == [("Intro line\ncontinued", False, None), ("a", True, "bullet"), ("b", True, "bullet"), ("third", False, "3)"), ("tail", False, None)]
    assert [p.text for p in one(spark, "TITLE\n=====\ntext", "string", lambda c: ET.paragraphs(c, drop_dividers=True))] == ["TITLE", "text"]
    assert len(one(spark, "TITLE\n=====\ntext", "string", lambda c: ET.paragraphs(c))) == 1
    assert one(spark, None, "string", lambda c: ET.paragraphs(c)) == []


def test_unicode_white_space(spark):
    assert one(spark, " a \x1c b　", "string", X.clean_text) == "a b"
    assert one(spark, "a\x0bb\x85c\r\nd\n", "string", X.split_lines) == ["a", "b", "c", "d"]


@pytest.mark.parametrize(("parts", "a", "b"), [((500, 600, 200), [1101, 200], [1302]), ((1000, 1000, 1000), [1000] * 3, [3002]), ((3000,), [1200, 1200, 600], [1200, 1200, 600])])
def test_packing_of_parts(spark, parts, a, b):
    values = [chr(97 + i) * n for i, n in enumerate(parts)]
    for accumulate, want in ((True, a), (False, b)):
        assert [len(x) for x in one(spark, values, "array<string>", lambda c, k=accumulate: C.split_unit(c, accumulate=k))] == want


def test_merge_and_absorb(spark):
    values = ["a" * 1190, "b" * 100]
    assert [len(x) for x in one(spark, values, "array<string>", lambda c: C.merge_short(c, least=350, ceiling=1200))] == [1190, 100]
    assert [len(x) for x in one(spark, values, "array<string>", lambda c: C.merge_short(c, least=350, ceiling=1550))] == [1291]
    items = [("H1", True), ("H2", True), ("H3", True), ("body", False)]
    got = one(spark, items, "array<struct<text:string,is_heading:boolean>>", lambda c: C.absorb_heading_only(C.build_units(c)))
    assert [list(u.parts) for u in got] == [["H2", "H3", "body"]]
    assert C.limits(10, 5) == (300, 120) and C.limits(400, 900) == (400, 400)


def test_chunks_lose_no_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    for r in Q.document_chunks(docs, "chunking").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
    for r in docs.collect():
        chunks = [t for _, t in sorted(got.get(r.doc_id, []))]
        assert all(c and len(c) <= 1550 for c in chunks)
        assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", r.text or "")


def test_names_and_styles(spark):
    cases = {"Heading 4": True, "Heading 5": False, "Title": True, "Heading 12": True, None: False}
    for style, want in cases.items():
        assert one(spark, style, "string", X.is_heading) is want
    assert one(spark, "Report.PDF", "string", lambda c: X.chunk_filename(c, F.lit("pdf"))) == "Report.PDF"
    assert one(spark, " ", "string", lambda c: X.chunk_filename(c, F.lit("docx"))) == "document.docx"
    assert one(spark, "xyz", "string", X.normalize_extension) == "docx"


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfone\xff\n- two\n")
    (tmp_path / "c.zip").write_bytes(b"x")
    files = D.read_files(spark, str(tmp_path))
    got = {r.filename: r.doc for r in D.extract(files).collect()}
    assert [p.text for p in got["a.md"].paragraphs] == ["T", "body"] and [p.text for p in got["b.txt"].paragraphs] == ["one�", "two"]
    assert "unsupported" in got["c.zip"].error
    from vellum.streaming import chunk_stream

    stream = chunk_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert {(r.filename, r.text) for r in spark.table("arrived").collect()} == {("a.md", "T\nbody"), ("b.txt", "one�\n- two")}


def test_flagship_has_no_python_and_prunes(spark, sf):
    plan = Q.chunks_by_language(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("ArrowEvalPython|MapInArrow|PythonUDF", plan) and re.search(r"ReadSchema: struct<doc_id:bigint,text:string,lang:string>", plan)


def _rows(df):
    return sorted(repr(tuple(None if v is None or v != v else v for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["chunks_by_language", "chunks_full_a", "txt_lists", "absorb_heading_only", "order_join", "bbox_antijoin", "md_chunks", "edit_table", "edit_slides", "gen_markdown", "html_list_items", "pdf_roundtrip", "run_merge"])
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(Q.ORACLES[name]).df(), Q.QUERIES[name](spark, sf).toPandas()
    assert list(got.columns) and sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def _brute_large(text):
    out, cur = [], ""
    for x in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", text))):
        if len(joined := f"{cur} {x}" if cur else x) <= 1200:
            cur = joined
            continue
        out, cur = [*out, cur], x
        while len(cur) > 1200:
            at = cur.rfind(" ", 0, 1200)
            at = 1200 if at <= 600 else at
            out, cur = [*out, cur[:at].strip()], cur[at:].strip()
    return [x for x in (*out, cur) if x]


def _brute_parts(parts, name):
    out, cur = [], ""
    for p in parts:
        joined = f"{cur}\n{p}" if cur else p
        if name.startswith("chunk_merge"):
            fits = cur and len(p) < 350 and len(joined) <= (1200 if name.endswith("a") else 1550)
        elif len(p) > 1200:
            out, cur = [*out, cur, *_brute_large(p)], ""
            continue
        else:
            fits = (len(joined) if name == "chunk_greedy_pack" else len(p) + bool(cur)) <= 1200
        out, cur = (out, joined) if fits else ([*out, cur], p)
    return [x for x in (*out, cur) if x]


@pytest.mark.parametrize("name", ["chunk_greedy_pack", "chunk_q1_pack", "chunk_merge_short_a", "chunk_merge_short_b"])
def test_packing_takes_whole_turns(spark, sf, name):
    turns, got = {}, {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.turn, r.role, r.text)):
        if part := " ".join((r.text or "").split()):
            turns.setdefault(r.conv_id, []).append(part)
    assert max(len(p) for x in turns.values() for p in x) > 1200
    for r in sorted(Q.QUERIES[name](spark, sf).collect()):
        got.setdefault(r.conv_id, []).append(r.text)
    assert got == {i: _brute_parts(x, name) for i, x in turns.items()}


def test_sentences_of_texts_of_any_length(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want |= {(r.doc_id, i): x for i, x in enumerate(filter(None, re.split(r"(?<=[.!?]) ", " ".join((r.text or "").split()))))}
    assert {(r.doc_id, r.sentence_index): r.text for r in Q.sentence_split(spark, sf).collect()} == want
