"""Plans, files, configuration and the HTTP analyser."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from driftline.functions import fixed
from driftline.functions import text as tx
from driftline.operators import analyze, boilerplate, client, sections
from driftline.plans import compare
from driftline.sources import files
from driftline.streaming.watch import watch


@pytest.fixture
def service():
    """A chat-completion service: /down fails, /plain answers JSON, /events streams."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body, self.headers.get("Authorization")))
            code = 500 if "down" in self.path else 408 if "slow" in self.path else 200
            said = json.dumps({"diffs": [{"type": "param-diff", "impact": "高", "base_quote": "a", "compare_quote": "b", "description": "d", "workload_hint": "w"}], "summary": "s"})
            if body["stream"]:
                cut = len(said) // 2
                events = [json.dumps({"choices": [{"delta": {"content": x}}]}) for x in (said[:cut], said[cut:])]
                out = "".join(f"data: {e}\n\n" for e in [events[0], "{broken", events[1], "[DONE]", events[0]])
            else:
                out = json.dumps({"choices": [{"message": {"content": said}}]})
            self.send_response(code)
            self.end_headers()
            self.wfile.write(out.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_endpoints_are_tried_in_order_and_for_good(service):
    url, asked = service
    a = client.HttpAnalyzer([client.Endpoint(url + "/down"), client.Endpoint(url + "/events", "m", "k", True), client.Endpoint(url + "/plain")])
    assert json.loads(a("be brief", "x"))["summary"] == "s" and a.at == 1
    assert a.structured("", "y", {"type": "object"})["diffs"][0]["type"] == "param-diff"
    assert [p for p, _, _ in asked] == ["/down/chat/completions", "/events/chat/completions", "/events/chat/completions"]
    assert asked[1][2] == "Bearer k" and asked[1][1]["messages"][0] == {"role": "system", "content": "be brief"} and "schema" in asked[2][1]["messages"][-1]["content"]


def test_what_is_not_worth_another_try(service):
    url, _ = service
    for bad in ("http://127.0.0.1:9", url + "/slow"):
        with pytest.raises(analyze.PermanentError):
            client.HttpAnalyzer([client.Endpoint(bad)])("", "x")
    with pytest.raises(RuntimeError):
        client.HttpAnalyzer([client.Endpoint(url + "/down")])("", "x")
    with pytest.raises(analyze.PermanentError):
        client.HttpAnalyzer()("", "x")


def secs_of(spark):
    rows = [("p", "base", 0, "1", "Uplink timing", "The compression header uses BFP and a clock.", "1"), ("p", "compare", 0, "1", "Uplink timing", "The header is now plain, without any compression at all.", "1"), ("p", "base", 1, "2", "Removed part", "Gone from here on.", "2"), ("p", "compare", 1, "9", "Novel thing", "Never seen before this.", "3")]
    return spark.createDataFrame(rows, "pair_id string, role string, seq long, number string, title string, content string, page string")


def test_compare_asks_the_service_with_hints_and_knowledge(spark, service):
    url, asked = service
    cfg = compare.Config(knowledge=("Clocks matter.",), patterns=(("sync", ("clock",), 5, "clock changes break sync"), ("other", ("nothing",), 9, "not shown")), cluster_threshold=None)
    rows = compare.compare(secs_of(spark), cfg, client.HttpAnalyzer([client.Endpoint(url + "/plain")])).collect()
    assert len(rows) == 3 and all(r.llm_result.summary == "s" for r in rows)
    prompts = [b["messages"] for _, b, _ in asked]
    assert all("Clocks matter." in m[0]["content"] for m in prompts)
    said = [m[1]["content"] for m in prompts]
    pair = next(x for x in said if x.startswith(analyze.ASKED["pair"]))
    assert "clock changes break sync" in pair and "not shown" not in pair and "compression at all" in pair
    assert sum(x.startswith(analyze.ASKED["base_only"]) for x in said) == sum(x.startswith(analyze.ASKED["compare_only"]) for x in said) == 1


def test_an_open_breaker_is_named_in_the_rules_result(spark):
    def down(system, user):
        raise analyze.PermanentError("off")

    rows = spark.createDataFrame([(k, "p", "p:1", None, True, "t", "", "1", "", "old", "") for k in range(9)], "item_id long, pair_id string, base_section_id string, compare_section_id string, has_diff boolean, base_section_title string, compare_section_title string, base_section_number string, compare_section_number string, base_content string, compare_content string")
    got = [r.llm_result for r in analyze.analyze(rows, down).orderBy("item_id").collect()]
    assert all(r.diffs[0].type == "feature_removed" for r in got) and "熔断开启" in got[-1].diffs[0].description and "熔断开启" not in got[0].diffs[0].description


def test_configuration(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("alignment:\n  similarity_threshold: 0.4\ndiff.min_change_chars: 12\nboilerplate:\n  enabled: true\n  titles: [preface]\nknowledge: [one, two]\npatterns:\n  sync: {keywords: [clock], priority: 3, hint: careful}\nunknown: 1\n")
    cfg = compare.Config.load(str(path), {"DRIFTLINE_CONCURRENCY": "4", "DRIFTLINE_COMPAT": "true", "DRIFTLINE_MAX_ITEMS": "7"})
    assert (cfg.similarity_threshold, cfg.min_change_chars, cfg.concurrency, cfg.compat, cfg.max_items) == (0.4, 12, 4, True, 7)
    assert cfg.boilerplate.enabled and cfg.boilerplate.titles == ("preface",) and cfg.knowledge == ("one", "two") and cfg.patterns == (("sync", ("clock",), 3, "careful"),)
    assert compare.Config.load(None, {}) == compare.Config()
    assert compare.endpoint("http://x,m,,stream") == client.Endpoint("http://x", "m", "", True)


def test_pdf_by_plug_in_and_a_batch_that_goes_on(spark, tmp_path):
    def pdf_tables(data):
        if b"scored" not in data:
            raise ValueError("no tables here")
        return [(2, [["k", "v"], ["1", None]], 71.5)]

    pdf_pages, simple_tables = lambda data: data.decode().split("\f"), lambda data: [(1, [["plain", "x"]], None)]
    (tmp_path / "base").mkdir()
    (tmp_path / "more").mkdir()
    page = "1. Scope\nA paragraph that is long enough to stay.\f2. Method\nAnother paragraph that is long enough."
    (tmp_path / "base" / "b.pdf").write_bytes((page + " scored").encode())
    (tmp_path / "more" / "good.pdf").write_bytes(page.replace("long", "far longer").encode())
    (tmp_path / "more" / "bad.docx").write_bytes(b"no zip at all")
    (tmp_path / "more" / "old.doc").write_bytes(b"x")
    pdf = compare.Pdf(pdf_pages, None, pdf_tables, simple_tables)
    text = [r.text for r in compare.read_lines(spark, str(tmp_path / "base"), pdf).orderBy("line_no").collect()]
    assert text[0] == "# 1 Scope" and "## Tables" in text and "### Table 1 (accuracy 71.5%)" in text and "| 1 |  |" in text
    inside = [r.text for r in compare.read_lines(spark, str(tmp_path / "base"), compare.Pdf(pdf_pages, None, pdf_tables, None, True)).orderBy("line_no").collect()]
    assert inside.index("| k | v |") > inside.index("# 2 Method") and "## Tables" not in inside
    with pytest.raises(ValueError, match="bad.docx|old.doc"):
        compare.read_lines(spark, str(tmp_path / "more"), pdf)
    out = compare.run(spark, str(tmp_path / "base"), str(tmp_path / "more"), str(tmp_path / "out"), pdf=pdf, day="20260101", summarise=lambda text: f"{len(text)} characters")
    assert list(out) == ["good.pdf"]
    folder = tmp_path / "out" / "20260101_base_vs_good.pdf"
    assert (folder / "report.md").read_text() == out["good.pdf"] and (folder / "abstract.md").read_text().endswith("characters")
    assert spark.read.parquet(str(tmp_path / "out" / "20260101_base" / "condensed")).filter("pair_id = 'good.pdf'").count() > 0
    assert compare.resume(spark, str(folder)).startswith("# base vs good.pdf")


def test_default_lists_on_texts_that_hit(spark):
    rows = [(1, "U-Plane and C-plane timing", "x"), (2, "Table of Contents", "1 Scope ........ 7"), (3, "目录", ""), (4, "Body", "nothing of the kind")]
    df = spark.createDataFrame(rows, "id int, title string, content string")
    k = {r.id: set(r.k) for r in df.select("id", tx.keyword_set(F.col("title")).alias("k")).collect()}
    assert k[1] == {"u-plane", "c-plane", "timing"} and not k[4]
    hit = {r.id: r.h for r in df.select("id", boilerplate.is_boilerplate(F.col("title"), F.col("content"), boilerplate.Boilerplate()).alias("h")).collect()}
    assert hit == {1: False, 2: True, 3: True, 4: False}
    for signal in fixed.CONTENT_SIGNALS:
        one = spark.createDataFrame([("t", f"text {signal} text")], "title string, content string")
        assert one.select(boilerplate.content_hit(F.col("title"), F.col("content"), boilerplate.Boilerplate()).alias("h")).first().h, signal
    shown = {r.id: (r.hints, r.n_found) for r in analyze.hints(spark.createDataFrame([(1, "PRACH over eCPRI with PTP and BFP compression"), (2, "plain")], "id int, text string"), ["id"]).collect()}
    assert shown[1][0] == "eCPRI Header; PRACH; 时钟同步" and shown[1][1] >= 4 and shown[2] == ("", 0)


def test_sections_against_a_plain_scan(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for doc in range(12):
        for k in range(1, rnd.randrange(2, 60)):
            rows.append((f"d{doc}", k, k // 10, "#" * rnd.randrange(1, 7) + f" {k} T" if rnd.random() < 0.3 else rnd.choice(["text", "", "  x "])))
    df = spark.createDataFrame(rows, "doc_id string, line_no int, page_num int, text string")
    for compat in (False, True):
        want = {}
        for doc, k, _, t in rows:
            if t.startswith("#"):
                level, body = len(t.split(" ")[0]), []
                for d, n, _, u in rows:
                    if d == doc and n > k:
                        deep = len(u.split(" ")[0]) if u.startswith("#") else 9
                        if deep == level or (deep < level and not compat):
                            break
                        body.append(u)
                want[doc, k] = "\n".join(body).strip(" ")
        assert {(r.doc_id, r.line_no): r.content for r in sections.sections(df, compat).collect()} == want


def test_rare_terms_lose_no_pair(spark):
    import random

    from driftline.operators import align, cluster

    rnd = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    rows = [("p", role, k, str(k % 7), " ".join(rnd.choices(words, [1 / (j + 1) for j in range(30)], k=rnd.randrange(1, 6))), "header" if k % 3 else "", "1") for role in ("base", "compare") for k in range(40)]
    secs = spark.createDataFrame(rows, "pair_id string, role string, seq long, number string, title string, content string, page string")
    full = {(r.base_seq, r.compare_seq): r.similarity for r in align.combined(secs).collect()}
    for threshold in (0.25, 0.6):
        some = {(r.base_seq, r.compare_seq): r.similarity for r in align.combined(secs, threshold=threshold).collect()}
        assert {k: v for k, v in full.items() if v >= threshold} == {k: v for k, v in some.items() if v >= threshold} and some.items() <= full.items()
    items = secs.select((F.col("seq") + F.when(F.col("role") == "base", 0).otherwise(100)).alias("item_id"), F.col("title").alias("text"))
    every = {(r.a, r.b) for r in cluster.edges(items, 0.01).collect()}
    near = {(r.a, r.b): r.similarity for r in cluster.edges(items, 0.7).collect()}
    assert near.keys() <= every and near and cluster.edges(items, 0.01).filter("similarity >= 0.7").count() == len(near)


def test_watch_compares_files_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# 1 Scope\nOther text that is much longer than before, by far.\n")
    base = spark.createDataFrame([("b", 1, None, "# 1 Scope"), ("b", 2, None, "Text.")], "doc_id string, line_no int, page_num int, text string")
    watch(spark, base, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
