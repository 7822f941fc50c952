import re

import corpus_pipeline
from tests.llm.test_decontam import brute


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert 0 < len(kept[name]) <= before
        assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values())
        before = len(kept[name])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept["quality_classifier"] for i in good) / len(good) > 0.97
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept["quality_classifier"] for i in bad) / len(bad) < 0.1
    lines = [x for r in kept["line_dedup"].values() for x in r["text"].split("\n") if len(x.split()) > 52]
    assert len(lines) == len(set(lines))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    vocab = {w for _, t in items for w in re.findall(r"[^\W_]+", t.lower())}
    for r in list(kept["decontamination"].values())[:60]:
        if len(vocab & set(r["text"].lower().split())) >= 10 and len(r["text"]) < 1500:
            assert not brute(r["text"], items)[1]
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    words = sum(len(r["text"].split()) for r in docs.collect())
    assert abs(sum(len(r["text"].split()) for r in mix) - 1.5 * words) < 0.05 * words


def test_run_gives_the_mix(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["shard", "source", "slot", "block", "doc_ids", "text"] and got.count() > 0


def _folder(spark, tmp_path, docs):
    """A folder of tables as run() reads them, with these documents."""
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.01/{name}.parquet", tmp_path / f"{name}.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_run_on_nulls_repeats_and_clashes(spark, tmp_path):
    """Rows without text or id, repeated rows, other tables' column names: nothing crashes, the mix
    has one and a half times the words that the stages keep, out of documents that they keep."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(None, "a text without an id " * 30, "en", None, 600), (90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, " \n\t", "en", "s", 3), (None, None, None, None, None)]
    odd = spark.createDataFrame(odd, docs.schema)
    docs = docs.unionByName(docs.where("doc_id < 60")).unionByName(odd).unionByName(odd)
    names = ("clean", "score", "fp", "same", "leaks", "component", "_id", "_mark", "label", "salt", "key", "block")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    d = _folder(spark, tmp_path, docs)
    kept, columns = spark.read.parquet(f"{d}/documents.parquet"), docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert kept.columns == columns and kept.where(" OR ".join(f"{c} <> 'own {c}'" for c in names)).count() == 0
    rows = kept.collect()
    texts = [r["text"] for r in rows if r["text"]]
    assert len(texts) == len(set(texts))  # repeated rows are gone
    words = sum(len((r["text"] or "").split()) for r in rows)
    mix = corpus_pipeline.run(spark, d).collect()
    assert abs(sum(len(r["text"].split()) for r in mix) - 1.5 * words) < 0.06 * words
    assert {i for r in mix for i in r["doc_ids"]} <= {r["doc_id"] for r in rows}


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, docs)).count() == 0


def test_near_dedup_stage_by_brute_force(spark):
    """What the stage keeps of a whole table against all pairs of its texts."""
    import numpy as np

    from tidewright.llm.simhash import shingle_set

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = [shingle_set(t, 5, 42) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= 0.8 * (small + large - both):
                    a, b = sorted((top(i), top(j)))
                    group[b] = a
    want = {rows[i][0] for i in range(len(rows)) if top(i) == i}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert want <= got and len(rows) - len(got) >= 0.9 * (len(rows) - len(want)) > 10
