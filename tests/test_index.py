"""The inverted index against plain reckoning, and stems."""

import random
from math import log

import pytest
from pyspark.sql import functions as F

from gristmill.functions.stemming import stem
from gristmill.operators import index as I
from gristmill.operators import search
from gristmill.streaming import jobs

# Examples published with the algorithm, and everyday forms.
STEMS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensitiviti sensit triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll engineers engin engineering engin engineered engin generalizations gener oscillators oscil c++ c++ ab ab".split()


def test_stems():
    assert [(w, stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2]))


def bm25(docs, fields, words):
    """The best field's boosted score of each document, by definition."""
    out = {}
    for f, boost in fields.items():
        texts = {k: (d[f] or "").split() for k, d in docs.items()}
        mean = sum(map(len, texts.values())) / max(len(texts), 1)
        for k, ws in texts.items():
            score = 0
            for w in words:
                tf, df = ws.count(w), sum(w in x for x in texts.values())
                if tf:
                    score += log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if score:
                out[str(k)] = max(out.get(str(k), 0), boost * score)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BYTES", 200)


def test_segments(spark, tmp_path, small_blocks):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) or None
    fields = {"title": 3.0, "text": 1.0}
    index = I.Index(spark, str(tmp_path / "index"), fields, stems=False)
    assert index.count() == 0 and index.scores(["w1"]).count() == 0
    now = {}
    check = lambda: {r.key: r.score for r in index.scores(["w1", "w2", "absent"]).collect()} == pytest.approx(bm25(now, fields, ["w1", "w2"]))
    number = 0
    for size in (60, 25, 25):
        ops = [(draw.randrange(80), text(), text(), "upsert" if draw.random() < 0.7 or not number else "delete", s) for s in range(size)]
        index.bulk(number, spark.createDataFrame(ops, "id long, title string, text string, op string, seq int"))
        for k, title, body, op, _ in ops:
            now.pop(k, None)
            if op == "upsert":
                now[k] = {"title": title, "text": body}
        assert index.count() == len(now) and check()
        number += 1
        if number == 2:
            index.merge(1)
            assert len(index._listed()) == 1 and index.count() == len(now) and check()
    index.bulk(2, spark.createDataFrame(ops, "id long, title string, text string, op string, seq int"))  # once more: the same
    assert index.count() == len(now) and check()
    index.merge(2)
    assert index.count() == len(now) and check()
    with pytest.raises(ValueError):
        index.merge(1)
    assert index.scores([]).count() == 0


def test_index_from_a_stream_of_operations(spark, tmp_path):
    rows = [(1, "Payments engineers wanted", "upsert", 1), (2, "Payment engineer", "upsert", 2), (3, "Chef", "upsert", 3), (1, None, "delete", 4), (3, "Engineering of sauces", "upsert", 5), (2, "Payment engineer, senior", "upsert", 6)]
    frame = spark.createDataFrame(rows, "id long, title string, op string, seq int")
    for lo, hi in ((1, 3), (4, 6)):
        frame.where(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = I.Index(spark, str(tmp_path / "index"), {"title": 1.0})
    for _ in range(2):  # the second start finds nothing new
        stream = jobs.read(spark, str(tmp_path / "in"), files=1)
        stream.writeStream.foreachBatch(index.applied()).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert index.count() == 2 and len(index._listed()) == 2
    found = lambda q, **k: {r.key for r in index.lexical_leg(q, **k).collect()}
    assert found("engineers") == {"2", "3"} and found("sauce") == {"3"} and found("chef") == set()
    assert found("paymnt") == {"2"} and found("paymnt", fuzzy=False) == set() and found("the") == set()


def test_the_leg_equals_a_scan(spark, tmp_path):
    rows = [(1, "data engineer data", "builds pipelines"), (2, "dada artist", None), (3, "chef", "cooks data and more data soup"), (4, "", "")]
    docs = spark.createDataFrame(rows, "id long, title string, description string")
    index = I.Index(spark, str(tmp_path / "index"), {"title": 3.0, "description": 1.0}, stems=False)
    index.write(0, docs)
    got = {r.key: r.score for r in index.lexical_leg("data engineers").collect()}
    assert got == pytest.approx({str(r.id): r.score for r in search.lexical_leg(docs, "data engineers").collect()})
