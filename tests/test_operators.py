"""Properties of the comparison operators on small inputs."""

import io
import zipfile

import pytest

from driftline.operators import align, analyze, textdiff
from driftline.operators.graph import components
from driftline.plans.compare import Config, run
from driftline.sources import files

TEXTS = [("", ""), ("a", ""), ("", "b"), ("same", "same"), ("one two three", "one 2 three"), ("x\ny\nz", "x\nY\nz\nw"), ("前传接口 A", "前传接口 B")]


@pytest.mark.parametrize("a, b", TEXTS)
def test_char_ops_rebuild_both_texts(a, b):
    ops = textdiff.char_ops(a, b)
    assert "".join(o["text"] for o in ops if o["type"] != "delete") == b
    assert "".join(o["text"] for o in ops if o["type"] != "insert") == a


def test_components_are_an_equivalence(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (5, 5)] + [(k, k + 1) for k in range(100, 140)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[3] == 1 and got[12] == 10 and got[140] == 100 and 5 not in got


def test_self_comparison_aligns(spark):
    rows = [("p", role, k, str(k), f"title number{k} words{k % 3}", "text", "1") for role in ("base", "compare") for k in range(9)]
    secs = spark.createDataFrame(rows, "pair_id string, role string, seq long, number string, title string, content string, page string")
    matched, base, compare = align.align(secs)
    assert all(r.base_seq == r.compare_seq for r in matched.collect()) and compare.count() == 0


@pytest.mark.parametrize("reply, want", [('{"a": 1} tail', '{"a": 1}'), ('x\n```json\n{"a": "}"}\n```', '{"a": "}"}'), ('bad { {"b": 2}', '{"b": 2}'), ("prose", "prose"), (None, "")])
def test_json_recovery(reply, want):
    assert analyze.recover_json(reply) == want


def test_breaker_opens_and_answers_in_order():
    calls = []

    def fail(system, user):
        calls.append(user)
        raise RuntimeError("down")

    out = list(analyze.call_with_breaker(((k, str(k)) for k in range(20)), fail, "", sleep=lambda s: None))
    assert [k for k, _, _ in out] == list(range(20)) and len(calls) == 5 and out[-1][2] == "熔断开启"


def test_docx_to_report(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>1 Scope</w:t></w:r></w:p><w:p><w:r><w:t>Some text that is long enough.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "base").mkdir()
    (tmp_path / "more").mkdir()
    (tmp_path / "base" / "b.docx").write_bytes(data.getvalue())
    (tmp_path / "more" / "c.md").write_text("# 1 Scope\nOther text that is much longer than before, by far.\n")
    lines = [r.text for r in files.docx_lines(files.docx(files.read_files(spark, str(tmp_path / "base")))).orderBy("line_no").collect()]
    assert lines[0] == "# 1 Scope" and "## Tables" in lines
    out = run(spark, str(tmp_path / "base"), str(tmp_path / "more"), str(tmp_path / "out"), Config(), day="20260101")
    assert list(out) == ["c.md"] and "D-001" in out["c.md"]
    assert files.load(spark, str(tmp_path / "out" / "20260101_base_vs_c.md"), ["analysed", "none"])["none"] is None
