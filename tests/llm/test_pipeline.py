"""The pipeline against a brute-force version, and the oracle of the decontamination query."""

import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from driftline.llm import bpe
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    good = [f"g{''.join(rnd.choice('aeioulmn') for _ in range(6))}" for _ in range(300)]
    poor = [f"p{''.join(rnd.choice('aeioulmn') for _ in range(6))}" for _ in range(300)]
    prose = lambda words, n=60: " ".join(rnd.choice(words) for _ in range(n))
    texts = {k: prose(poor if k % 2 else good) for k in range(300)}
    passage = prose(good, 12)
    texts |= {1000: texts[0].upper(), 1001: f"{prose(good)} {passage} {prose(good, 40)}", 1002: f"{passage} {prose(good, 3)}", 1003: f"{prose(good)} token: abcdef1234 {prose(good)}", 1004: prose(poor)}
    path = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q1", passage)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")

    want, library = {}, Tokenizer.from_file(bpe.default_vocabulary())
    kept: set[str] = set()
    for k in sorted(texts):
        text = texts[k]
        if text.lower().startswith("p") or text.lower() in kept:
            continue
        kept.add(text.lower())
        rest = text.replace(passage, "")
        if 2 * len(rest.split()) < len(text.split()):
            continue
        ids = library.encode(ASSIGN.sub("[SECRET]", rest), add_special_tokens=False).ids
        want[k] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert {1001, 1003} < set(want) and not {1000, 1002, 1004} & set(want)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect()} == want


AWKWARD = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, "  \n", "en", None, 3), (4, "gala gila " * 8 + "token=abcdef12", "en", "web", 90), (4, "gala gila " * 8 + "token=abcdef12", "en", "web", 90), (5, "gala gila " * 30000, "en", "web", 300000), (None, "gono gelo gimi gana gola guma", "en", "a b", 30), (7, "puma pilo " * 20, "xx", "web", 200), (8, "one two three four", None, None, -1)]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, base string, spans string, __row string, h long, uid long, c long, class_id string, kept string, score string, quality string"


def test_stages_take_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables, through every stage."""
    import corpus_pipeline

    rows = [(*r, "b", "s", "r", 1, 2, 3, "i", "k", "x", "q") for r in AWKWARD]
    docs = spark.createDataFrame(rows, CLASH)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (7, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("q", "one two three four"), (None, None)], "item_id string, text string")
    for k, (d, lab, b) in enumerate([(docs, labels, bench), (docs, labels.limit(0), bench.limit(0)), (docs.limit(0), labels.limit(0), bench.limit(0))]):
        path = str(tmp_path / str(k))
        d.write.parquet(f"{path}/documents.parquet")
        lab.write.parquet(f"{path}/labels.parquet")
        b.write.parquet(f"{path}/benchmark.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, path)
            assert now.columns == docs.columns, name
            got = now.collect()
            assert all(tuple(r)[5:] == rows[0][5:] for r in got), name
        texts = {(r.doc_id, r.text) for r in got}
        if k == 1:
            # Without labels all are kept, without a benchmark nothing is cut; copies and secrets go.
            assert len(got) == len(AWKWARD) - 1 and (4, "gala gila " * 8 + "token=abcdef12".replace("token=abcdef12", "[SECRET]")) in texts and (1, None) in texts
        elif k == 0:
            assert (8, "one two three four") not in texts
        else:
            assert not got
        if k == 2:
            assert corpus_pipeline.run(spark, path).count() == 0


def test_last_stage_returns_token_ids(spark):
    import corpus_pipeline
    from driftline.llm import bpe

    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["bpe_encoding"](spark, docs, "").collect()}
    ids = bpe.tokenizer(bpe.default_vocabulary()).encode("one two three")
    assert bytes(got[1].token_ids) == ids and got[1].n_tokens == len(ids) // 4 and b"three" in bytes(got[1].decoded)
    assert bytes(got[2].token_ids) == bytes(got[2].decoded) == b"" and got[2].n_tokens == 0


@pytest.mark.parametrize("name", ["op4_decontamination"])
def test_oracle(name, spark, sf_dir):
    from driftline.llm import queries

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(got.fetchall())
