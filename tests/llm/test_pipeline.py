"""The pipeline's stages on documents with planted cases."""

import random

import corpus_pipeline
from corvale.llm.registry import oracle_sql, queries

LANGS = {"en": "the tion ing er on at of st", "de": "sch ung ein der ver ß ü ä"}


def text(r, lang, n):
    own = LANGS[lang].split()
    return " ".join("".join(r.choice(own) for _ in range(r.randint(2, 5))) for _ in range(n))


def test_stages(spark, tmp_path):
    r = random.Random(1)
    bench = [(i, text(r, "en", 25)) for i in range(5)]
    passage = text(r, "en", 60)
    docs = [[i, text(r, lang := r.choice(list(LANGS)), 80), lang, "s"] for i in range(120)]
    docs[20][1] = docs[10][1]
    docs[21][1] = docs[11][1] + " extra"
    docs[30][1] = text(r, "en", 40) + " " + bench[2][1] + " " + text(r, "en", 40)
    docs[40][1], docs[41][1] = text(r, "en", 50) + " " + passage, passage + " " + text(r, "en", 50)
    docs[50][1] = "1234 !!!"
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf_dir = str(tmp_path)
    now, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        now.write.parquet(f"{sf_dir}/{name}")
        now = spark.read.parquet(f"{sf_dir}/{name}")
        seen[name] = {x["doc_id"] for x in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == columns
    every = set(range(120))
    assert seen["language_id"] == every - {50}
    assert seen["minhash_near_dedup"] == every - {50, 20, 21}
    assert seen["suffix_array_dedup"] == seen["minhash_near_dedup"]
    cut = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf_dir}/suffix_array_dedup").collect()}
    assert passage in cut[40] and passage not in cut[41] and cut[60] == docs[60][1]
    assert seen["benchmark_decontamination"] == seen["suffix_array_dedup"] - {30}
    assert seen["packing"] == seen["benchmark_decontamination"]


def test_registry():
    names = [n for n in queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(oracle_sql()) <= set(names)


def test_contained_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.execute(oracle_sql()["op3_benchmark_containment"]).fetchall()
    got = queries()["op3_benchmark_containment"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_with_odd_rows(spark, sf_dir, tmp_path):
    """Null texts, repeated and null ids, an own column of a clashing name; and an empty table."""
    import random

    import corpus_pipeline

    r = random.Random(6)
    rows = [(i, text(r, lang, 60), lang) for i in range(40) for lang in ("en", "de")] + [(1, None, "en"), (None, text(r, "en", 40), None), (5, text(r, "de", 30), "de"), (5, text(r, "de", 30), "de"), (7, "", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, gone_id string, part string")
    for n, table in (("some", docs), ("none", docs.limit(0))):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, sf_dir)
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            kept = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
        assert (packed.count() > 50) == (n == "some")
