"""Learned types that are rare, and more of them than are broadcast."""

from __future__ import annotations

from helixframe.llm import sentences as S

SCHEMA = "doc_id long, text string, lang string"


def test_rare_script_and_rare_type_are_learned(spark):
    texts = [(i, "Plain words here. " * 400, "en") for i in range(625)]
    texts += [(1000, "See zq. Mo and more of zq. Mo there", "en"), (1001, "Ο δρ. Νίκος και ο δρ. Πέτρος είδαν πολλά και ωραία πράγματα " * 20, "el")]
    kinds = {(r.model, r.type): r.kind for r in S.learn(spark.createDataFrame(texts, SCHEMA).repartition(4)).collect()}
    assert kinds["*greek", "δρ"] == "never"  # 1 of 627 texts
    assert kinds["*latin", "zq"] == "never"  # 2 of 250,000 periods


def test_types_beyond_the_broadcast_are_joined(spark, monkeypatch):
    texts = [(i, f"Some pl{i * 7 % 25} wo{i % 40} of pl{i * 3 % 25} came to Dr. Bran{i % 9} pl{i % 25}. Then ca{i % 50} went by etc.\nEach na{i % 30} said i.e. nothing more etc. Now re{i % 20} left", "en") for i in range(300)]
    df = spark.createDataFrame(texts + [(None, "", None), (1, "家野 Dr. Velmo麦草。", "ja")], SCHEMA).repartition(3)
    rows = lambda: sorted((str(r.doc_id), r.sent_start, r.sent_end) for r in S.sentences(df).collect())
    whole = rows()
    monkeypatch.setattr(S, "MAX_BROADCAST", 1)
    assert rows() == whole
