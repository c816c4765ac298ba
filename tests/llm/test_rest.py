"""Search, chat formatting, the pipeline, and the queries with SQL."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlink.llm import bit_search, catalogue, chat_format, packing, personal_data
from eventlink.llm.components import components

from .conftest import TAIL

FOLDER = "/root/testdata/sf0.001"


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 24)).round(3)
    rows = [(int(k), [float(v) for v in r], "c") for k, r in enumerate(x)]
    hot = rows[100][1]
    rows += [(1000 + k, hot, "c") for k in range(40)]
    rows += [(50, rows[50][1], "c")]
    odd = [(2000, None, "c"), (2050, [0.0] * 24, "c"), (2100, [1.0, None] * 12, "c"), (2150, [float("nan")] * 24, "c"), (2200, [1.0, 2.0], "c"), (2250, [], "c"), (None, hot, "c")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, code string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bit_search.neighbours(frame).collect()}
    whole = dict((k, np.array(v)) for k, v, _ in rows)
    ids = np.array(sorted(whole))
    unit = np.array([whole[k] / math.sqrt((whole[k] ** 2).sum()) for k in ids])
    want = {}
    for k in ids[ids % 50 == 0]:
        score = unit @ unit[ids == k][0]
        score[ids == k] = -9
        for rank, j in enumerate(np.lexsort((ids, -score.round(12)))[:5]):
            want[int(k), rank + 1] = int(ids[j]), score[j]
    assert set(got) == set(want)
    hits = sum(got[k][0] == want[k][0] for k in want)
    assert hits >= 0.98 * len(want)
    assert all(got[k][1] == pytest.approx(want[k][1], abs=0.02) for k in want)
    assert [got[100, r][0] for r in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
    assert bit_search.neighbours(frame.limit(0)).count() == 0


def test_few_rows_are_reranked_and_found(spark):
    """The given vectors: the bounds leave less than a tenth of all rows, and hardly a neighbour is missed."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    clean = bit_search.usable(vectors, "vec_id", "embedding")
    rows = bit_search.needed(clean, 5)
    queries = bit_search.written(clean.where("vec_id % 50 = 0").withColumn("query", F.monotonically_increasing_id()))
    codes = bit_search.written(bit_search.index(rows))
    assert "vector" not in codes.columns
    pairs = bit_search.candidates(codes, bit_search.rounded(queries), 5).count()
    whole = {r.vec_id: np.array(r.vector) for r in rows.collect()}
    asked = [k for k in sorted(whole) if k % 50 == 0]
    assert pairs < 0.1 * len(asked) * len(whole)
    ids = np.array(sorted(whole))
    unit = np.array([whole[k] / math.sqrt((whole[k] ** 2).sum()) for k in ids])
    got = {(r.query_id, r["rank"]): r.vec_id for r in bit_search.neighbours(vectors).collect()}
    hits = 0
    for k in asked:
        score = unit @ unit[ids == k][0]
        score[ids == k] = -9
        hits += sum(got[k, rank + 1] == ids[j] for rank, j in enumerate(np.lexsort((ids, -score))[:5]))
    assert hits >= 0.98 * 5 * len(asked)


def test_bounds_hold(spark):
    """Estimates from counts of common bits against the cosines themselves."""
    rng = np.random.default_rng(9)
    for dim in (3, 24, 64, 1100):
        x = rng.standard_normal((200, dim))
        frame = spark.createDataFrame([(k, dim, [float(v) for v in r], k) for k, r in enumerate(x)], "vec_id long, dim int, vector array<double>, row long")
        codes = bit_search.index(frame).collect()
        block = bit_search.Block(np.arange(200), np.arange(200), dim, [bytes(r.code) for r in codes], np.array([r.scalar for r in codes]))
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        inside = []
        for q in bit_search.rounded(frame.withColumnRenamed("row", "query")).where("query < 20").collect():
            low, high = block.bounds(bytes(q.planes), q.least, q.step, q.total)
            cosine = unit @ unit[q.query]
            inside.append(((low <= cosine) & (cosine <= high))[np.arange(200) != q.query].mean())
        assert np.mean(inside) > 0.98, (dim, np.mean(inside))


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "user", said, 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", "<\\s>\\", 1), (1, 2, "assistant", "[", 1), (1, 3, "user", "", 1),
        (2, 0, None, "x", 1), (2, None, "", "first", 1), (None, 0, "assistant", "[\\/INST]<s>", 1), (3, 0, "a[INST]b", "y", 1), (3, 0, "a[INST]b", "y", 1),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    formatted = chat_format.format_chat(frame)
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    for key in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == key))
        text = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        lost = "".join(t for _, _, role, t in turns if role == "assistant")
        r = got[key]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    one = formatted.where("conv_id = 1").first().formatted
    assert one.count("<s>") == one.count("</s>") == 3 and one.count("[INST]") == 5
    assert chat_format.format_chat(frame.limit(0)).count() == 0
    assert "Python" not in formatted._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (None, 1)] + [(500, 500 + k) for k in range(1, 300)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    want = {k: 100 for k in range(100, 161)} | {3: 3, 5: 3, 9: 3, 7: 7} | {500 + k: 500 for k in range(300)}
    assert got == want


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert Counter(tuple(r) for r in frame.select(*columns).collect()) == want


def test_pipeline(spark, odd, none):
    """The odd rows, stage by stage; what only the pipeline does to the operators' results."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.text is None or r.n_chars == len(r.text) for r in kept[name].values())
    assert set(kept["quality rules"]) == {3, 4, 7, 8, 9, 10}
    assert set(kept["near duplicates"]) == {3, 7, 8, 9}
    assert kept["repeated passages"][7].text == "before after that"
    assert kept["repeated passages"][8].text == f"other words end {TAIL}"
    assert kept["repeated passages"][9].text == kept["quality rules"][9].text
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    assert {r.doc_id for r in pieces.collect()} == {3, 7, 8, 9}
    empty = none.select(*docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, FOLDER))
        assert empty.count() == 0


def test_pipeline_keeps_rows_with_odd_ids(spark):
    """Null ids, repeated rows, and one id with two texts: of each document one row stays, with its words."""
    said = {name: " ".join(f"{name}{k}" for k in range(60)) for name in ("null", "copy", "shared", "alone", "named", "odd")}
    bad = "! " * 60
    rows = [
        (None, said["null"], "a"),
        (None, said["odd"], "a"),
        (1, said["copy"], "a"),
        (1, said["copy"], "a"),
        (1, said["copy"], "b"),
        (2, said["shared"], "a"),
        (2, said["alone"], "a"),
        (2, bad, "a"),
        (None, said["named"], "a"),
        (3, said["named"], "a"),
        (None, said["null"], "a"),
    ]
    docs = spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        if name == "quality rules":
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((k, t) for k, t, _ in rows if t != bad)
    want = [(None, "null"), (None, "odd"), (1, "copy"), (2, "shared"), (2, "alone"), (3, "named")]
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((k, said[n]) for k, n in want)
    assert {r.source for r in docs.where("doc_id = 1").collect()} == {"a"}


def test_pipeline_hands_on_columns_of_any_name(spark):
    """Columns named as the stages name theirs come out as they went in."""
    names = ["row", "ROW_", "_key", "_own", "key", "spans", "_row", "component_id", "kept", "said", "host"]
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{text} only{k} " * 1 + " ".join(f"x{k}y{j}" for j in range(90)), "en", "a", 5, *[f"{n}{k}" for n in names]) for k in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    given = {r.doc_id: tuple(r)[5:] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        assert docs.columns == [c.split()[0].strip("`") for c in schema.split(", ")]
    got = {r.doc_id: tuple(r)[5:] for r in docs.collect()}
    assert got == given and all("w30" not in r.text for r in docs.collect())


def test_redaction_leaves_nothing():
    field = personal_data.Field()
    text = "a.b@c.example.com +1 (603) 555-8791 10.0.0.1 4111 1111 1111 1111"
    out = personal_data.cleaned(text, field)
    assert not personal_data.base_spans(out)
