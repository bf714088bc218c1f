"""The pipeline with a toxicity model, against each stage stated by hand, and with empty side tables."""

import random

import pytest

rng = random.Random(77)
SYLLABLES = "ka to mi ren sol var del ing est ou th er on ne nu".split()


def prose(n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(n))


def write(spark, path, rows, items, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    import corpus_pipeline

    texts, toxic = [], set()
    for k in range(330):
        words = prose(45).split()
        if k % 3 == 0:
            toxic.add(k)
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "slurword"])
        texts.append(" ".join(words))
    copy, item, passage = texts[301], prose(30), prose(70)
    late = {330: copy + " end", 331: prose(10) + " " + item, 332: prose(30) + " " + passage, 333: prose(30) + " " + passage + " tail", 334: None, 335: ""}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in [*enumerate(texts), *late.items()]]
    # labels of the first 300 only: the others are judged by the model
    write(spark, tmp_path, rows, [(1, item)], [(k, 1, int(k in toxic)) for k in range(300)])
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()}
    clean = {r[0] for r in rows} - toxic
    assert len(clean - left) <= 2 and len(toxic & left) <= 5
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # of the copy the first stays, the document with the item goes, and of the passage only the second one's is cut
    assert set(got) == left - {330, 331}
    if {332, 333} <= left:
        assert got[333] < got[332]
    assert got[334] == got[335] == 0


@pytest.mark.parametrize("empty", ["labels", "benchmark", "documents"])
def test_empty_side_tables(spark, tmp_path, empty):
    import corpus_pipeline

    item = prose(30)
    rows = [(k, prose(40) + (" " + item if k == 7 else ""), "en", "s", 1) for k in range(20)]
    labels = [(k, 1, 0) for k in range(20)]
    write(spark, tmp_path, [] if empty == "documents" else rows, [] if empty == "benchmark" else [(1, item)], [] if empty == "labels" else labels)
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {"documents": set(), "labels": set(range(20)) - {7}, "benchmark": set(range(20))}[empty]
