"""The pipeline's stages on planted documents."""

import random

import corpus_pipeline
import __spark_entry__ as registry
from tests.conftest import SMALL


def text(rnd, n=150):
    return " ".join("".join(chr(97 + int(d)) for d in str(rnd.randrange(900))) for _ in range(n))


def test_stages_keep_clean_rows_and_act_on_the_others(spark, tmp_path):
    rnd = random.Random(5)
    item = " ".join(f"q{i}" for i in range(40))
    bad = ["nasty", "vile", "awful"]
    rows = [(i, text(rnd)) for i in range(240)]
    labels = [(i, 0) for i in range(0, 200)]
    toxic = list(range(300, 340))
    rows += [(i, text(rnd) + " " + " ".join(bad)) for i in toxic]
    labels += [(i, 1) for i in toxic[:30]]
    copy, near = rows[0][1], rows[1][1].split()
    near[60] = "other"
    rows += [(400, copy), (401, copy), (402, " ".join(near)), (403, f"a {item} b"), (404, "token = abcdefghijklmnop"), (405, None), (406, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, seen, str(tmp_path))
        if number < 4:
            assert result.columns == docs.columns
        result.write.parquet(f"{tmp_path}/out{number}")
        seen = spark.read.parquet(f"{tmp_path}/out{number}")
        kept.append({r["doc_id"] for r in seen.select("doc_id").collect()})
    everything = {i for i, _ in rows}
    assert everything - kept[0] == set(toxic)
    assert kept[0] - kept[1] == {400, 401, 402, 406}
    assert kept[1] - kept[2] == {403}
    assert kept[3] == kept[2] and kept[4] == kept[3]
    cleaned = spark.read.parquet(f"{tmp_path}/out3").filter("doc_id = 404").first()
    assert (cleaned["text"], cleaned["n_chars"]) == ("[secret]", 8)


def test_queries_are_registered():
    names = registry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_is_the_stages_in_order(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() > 0


def test_stages_with_hard_cases(spark, tmp_path):
    """Clashing column names, null ids, repeated rows, a very long text and an empty table."""
    rnd = random.Random(9)
    clash = "doc_id long, text string, n_chars int, _before string, _k1 int, _nth string, id string, hash int, row string, key_0 long"
    long_text = text(rnd, 30_000)
    rows = [(i, text(rnd)) for i in range(30)] + [(None, text(rnd)), (None, None), (50, None), (3, None), (60, long_text), (61, long_text)]
    rows += [rows[2], rows[2], (70, "api_key = abcdefghijklmnop and more words here " + text(rnd))]
    docs = spark.createDataFrame([(i, t, len(t or ""), f"b{i}", 1, "n", "x", 2, "r", 5) for i, t in rows], clash)
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for source in (docs, docs.limit(0)):
        seen = source
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            result = stage(spark, seen, str(tmp_path))
            path = f"{tmp_path}/hard{number}-{source is docs}"
            result.write.parquet(path)
            seen = spark.read.parquet(path)
            if number == 3:
                assert seen.columns == docs.columns
                kept = seen.collect()
                if source is docs:
                    # One of three empty texts, one of two long copies, one of three repeats.
                    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted([*range(30), 3, 60, 70])
                    assert sum(r["doc_id"] is None for r in kept) == 1
                    assert all(r["_before"] == f"b{r['doc_id']}" and (r["_k1"], r["_nth"], r["id"], r["hash"], r["row"]) == (1, "n", "x", 2, "r") for r in kept)
                    secret = next(r for r in kept if r["doc_id"] == 70)
                    assert "abcdefghijklmnop" not in secret["text"] and secret["n_chars"] == len(secret["text"])
                else:
                    assert kept == []
