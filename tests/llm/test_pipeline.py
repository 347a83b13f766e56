"""Every stage against its operator on its own input, and the whole run."""

import corpus_pipeline
from geoquarry.llm import decontamination, near_dedup, pieces, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, benchmark = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if name != "pieces":
            assert out.columns == columns
        if name == "toxicity":
            index = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {i for i, r in before.items() if index.score(r.text)[0] < 0.5}
        elif name == "near_dedup":
            assert set(after) == {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()}
        elif name == "decontamination":
            assert set(after) == {r.doc_id for r in decontamination.decontaminate(docs, benchmark).where("not contaminated").collect()}
        elif name == "pii":
            assert set(after) == set(before)
            clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
            assert all(r.text == clean[i] and r.n_chars == len(r.text) for i, r in after.items())
            assert all(not any(s.kind != "card" for s in r["__spans"]) for r in pii.with_spans(out).collect() if "[EMAIL]" in r.text)
        else:
            segmenter = pieces.Segmenter(pieces.Vocabulary(pieces.default_path()))
            assert set(after) == set(before) and all(segmenter.decode(after[i].ids) == r.text for i, r in before.items())
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert all(after[i] == before[i] for i in after)
        docs = out


def test_clashing_columns_and_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as component_id", "'x' as kept", "2 as item_id", "3 as k1", "4 as toxic", "5 as term").limit(40)
    for source in (docs, docs.limit(0)):
        own = source
        for name, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, SF)
            assert own.columns == docs.columns, name
            assert own.count() <= source.count()


def test_odd_rows_in_every_stage(spark):
    """Null texts and ids, empty and very long texts, repeated rows and ids, ties, and names that clash."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    story = "A plain little story about the sea and a boat that went out one day and came back the next morning."
    rows = [
        (None, None), (None, story), (1, None), (1, None), (2, ""), (2, " \n "), (3, story), (3, story), (4, story), (5, f"{story} Mail me at someone@example.org now or never again, as far as I can see from here."), (5, "Another text under the same id, quite unlike it."),
        (6, "word " * 40_000), (7, f"x {benchmark} y"), (8, f"x {benchmark} y"), (9, "\u2581 \U0001f600 \x00 é"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, __k1 int, score int, of_text string")
    got = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    texts = {name: sorted(((r.doc_id, r.text) for r in own), key=str) for name, own in got.items() if name != "pieces"}
    assert texts["toxicity"] == sorted(rows, key=str)
    # the two rows under 3 agree and collapse; 4 repeats their text; 8 repeats 7; 5 keeps both of its texts
    want = [r for k, r in enumerate(rows) if k not in (7, 8, 13)]
    assert texts["near_dedup"] == sorted(want, key=str)
    assert texts["decontamination"] == sorted((r for r in rows if r[0] not in (7, 8)), key=str)
    assert texts["pii"] == sorted(((i, t and t.replace("someone@example.org", "[EMAIL]")) for i, t in rows), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got["pii"])
    segmenter = pieces.Segmenter(pieces.Vocabulary(pieces.default_path()))
    assert sorted(((r.doc_id, segmenter.decode(r.ids)) for r in got["pieces"]), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert all(r.round_trip for r in got["pieces"])
    for name in texts:
        assert got[name][0].asDict().keys() == set(docs.columns) and all((r["__k1"], r.score, r.of_text) == (1, 2, "z") for r in got[name])
