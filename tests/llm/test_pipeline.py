"""The five stages of the corpus pipeline against brute-force counts, on odd inputs too."""

import random

import numpy as np
import pytest

import corpus_pipeline
from panelforge.llm import common, decontaminate, quality_model
from panelforge.llm.tokens import encoder, public_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def sentence(rng, n):
    return " ".join(letters(rng, rng.randint(2, 9)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(51)
    rows = [(k, "\n".join(sentence(rng, 20) for _ in range(4))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # exact copies
    items = [(k, sentence(rng, 25)) for k in range(4)]
    rows += [(200 + k, f"{sentence(rng, 40)}\n{items[k % 4][1]} {sentence(rng, 15)}") for k in range(8)]
    rows += [(300 + k, "buy now " * 40) for k in range(40)]  # labelled as bad
    rows += [(400, None), (401, ""), (None, sentence(rng, 60)), (3, rows[3][1])]
    rows += [(500 + k, f"{sentence(rng, 30)}\nthis very line stands in many documents of the corpus today") for k in range(6)]
    path = common.fresh_path(spark, "pipeline-test")
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(300 + k, 0, 0) for k in range(40)] + [(401, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, folder):
    docs = common.read_table(spark, folder, "documents")
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination", "packing"]

    good = common.written(functions["quality classifier"](spark, docs, folder), "t")
    assert good.columns == docs.columns
    labels = common.read_table(spark, folder, "labels").where(common.crc_fold("doc_id", 3) != 1)
    verdicts = quality_model.classify(docs, quality_model.train(docs, labels)).collect()
    assert sorted(str(r["doc_id"]) for r in verdicts if r["predicted"] == 1) == sorted(str(d) for d, _ in rows_of(good))
    assert not any(d is not None and 300 <= d < 340 for d, _ in rows_of(good)) and {k for k in range(60)} <= {d for d, _ in rows_of(good)}

    cut = common.written(functions["line dedup"](spark, good, folder), "t")
    assert cut.columns == docs.columns
    seen, expect = {}, []
    for d, t in sorted(set(rows_of(good)), key=lambda r: (r[0] is not None, r[0] or 0)):  # equal lines only: no others are near
        kept = [x for x in (t or "").split("\n") if not x or seen.setdefault(x, d) == d]
        if not t or kept:
            expect.append((d, t if t is None else "\n".join(kept)))
    assert sorted({(str(d), t) for d, t in rows_of(cut)}, key=str) == sorted({(str(d), t) for d, t in expect}, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("text IS NOT NULL").collect())

    one = common.written(functions["minhash near-dedup"](spark, cut, folder), "t")
    sets = [(d, {tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set()) for d, t in rows_of(cut)]
    gone = {d for d, a in sets for e, b in sets if d is not None and e is not None and e < d and a and 100 * len(a & b) >= 80 * len(a | b)}
    assert {str(d) for d, _ in rows_of(one)} == {str(d) for d, _ in rows_of(cut) if d not in gone}

    clean = common.written(functions["benchmark decontamination"](spark, one, folder), "t")
    items = [(r["item_id"], r["text"]) for r in common.read_table(spark, folder, "benchmark").collect()]
    leaked = {d for d, t in rows_of(one) if d is not None and any(x in (t or "") for _, x in items)}
    assert leaked and {str(d) for d, _ in rows_of(clean)} == {str(d) for d, _ in rows_of(one) if d not in leaked}
    assert decontaminate.find_leaks(clean, common.read_table(spark, folder, "benchmark")).where("doc_id IS NOT NULL").count() == 0

    pieces = functions["packing"](spark, clean, folder).collect()
    e = encoder(public_path("byte_bpe_50k.json"))
    want = sorted(len(e.encode(__import__("pyarrow").array([t]))[0]) + 1 for _, t in rows_of(clean))
    assert sorted(r["doc_tokens"] for r in pieces if r["start"] == 0) == want and sum(r["length"] for r in pieces) == sum(want)
    assert np.array([r["offset"] + r["length"] for r in pieces]).max() <= 1024


def test_run_of_empty_tables(spark, folder):
    path = common.fresh_path(spark, "pipeline-none")
    for name in ("documents", "labels", "benchmark"):
        common.read_table(spark, folder, name).limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Cluster())
