"""The pipeline's stages keep clean documents and do their work, on odd rows as well."""

import random
import zlib

import corpus_pipeline
import pytest

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"))
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        docs = out
    assert 0 < docs.count() < n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, repeats, very long and empty texts, and columns named like those that the stages use themselves."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [text(rng.randint(60, 200)) for _ in range(80)]
    passage = text(60)
    texts[3] = f"{texts[3]}\n{passage}"
    texts[4] = f"{passage}\n{texts[4]}"
    texts[6] = f"{texts[5]} more"
    texts[7] = f"{texts[7]}. you worthless idiot! you are stupid trash."
    odd_texts = [None, "", " \n\t ", "short", text(30_000), texts[0]]
    rows = [(i, t, "en", "s", len(t or ""), "row", "key", 1.0, "body") for i, t in enumerate(texts + odd_texts)]
    rows += [rows[9], (None, texts[10] + " unnamed", None, None, None, None, None, None, None), (8, text(90), "en", "s", 1, "row", "key", 1.0, "body")]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, 0, int(i == 7)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, label string, score double, body string"
    return spark.createDataFrame(rows, schema).repartition(3).cache(), str(path)


def _ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_on_odd_rows(spark, odd, name):
    docs, path = odd
    out = STAGES[name](spark, docs, path).cache()
    assert out.dtypes == docs.dtypes
    kept = _ids(out)
    ids = [i for gone, i in kept if not gone]
    if name == "quality rules":
        assert not set(ids) & {80, 81, 82, 83} and ids.count(9) == 2 and (True, 0) in kept
    elif name == "toxicity":
        assert set(ids) == set(range(86)) - {7} and ids.count(9) == 2 and (True, 0) in kept
    elif name == "near dedup":
        assert not set(ids) & {6, 85} and {0, 5, 80, 81, 82} <= set(ids) and ids.count(9) == ids.count(8) == 1 and (True, 0) in kept
    else:
        assert len(kept) == docs.count()
        texts = {r.doc_id: r.text for r in out.collect()}
        assert texts[80] == texts[81] == "" and texts[0] == texts[85] == "" and texts[11] and len(texts[3]) < docs.where("doc_id = 3").first().n_chars
    assert {(r.row, r.label, r.score, r.body) for r in out.where("doc_id IS NOT NULL").collect()} <= {("row", "key", 1.0, "body")}
    none = STAGES[name](spark, docs.limit(0), path)
    assert none.dtypes == docs.dtypes and none.count() == 0


def test_packing_on_odd_rows(spark, odd):
    docs, path = odd
    out = STAGES["packing"](spark, docs, path)
    pieces = {(r.doc_id, r.piece): r for r in out.collect()}
    end = zlib.crc32((2).to_bytes(4, "little"))
    assert all(pieces[i, 0].length == 1 and pieces[i, 0].ids_crc32 == end for i in (80, 81))
    assert pieces[84, 20].length == 1024
    assert out.count() == len(pieces) + 2
    assert STAGES["packing"](spark, docs.limit(0), path).count() == 0
