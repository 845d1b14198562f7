import corpus_pipeline
from cases import lower, near_classes, rows_of, words
from healthwatch.llm import mixing, queries, quality, spm
from healthwatch.llm.common import write_table

SF = "/root/testdata/sf0.001"


def test_stages_follow_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.collect()
        out = write_table(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == columns
        after = out.collect()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
            assert sorted(r["doc_id"] for r in after) == sorted(kept) and kept
        elif name == "exact_dedup":
            top = {}
            for r in before:
                top[lower(r["text"])] = max(top.get(lower(r["text"]), -1), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(top.values())
        elif name == "near_dedup":
            rows = rows_of(docs)
            top = {}
            for (i, _), c in zip(rows, near_classes(rows)):
                top[c] = max(top.get(c, -1), i)
            assert sorted(r["doc_id"] for r in after) == sorted(top.values())
        else:
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, n in copies.items() for _ in range(n))
            total = sum(len(words(r["text"])) for r in before)
            assert abs(sum(len(words(r["text"])) for r in after) / total - 1.5) < 0.2
        docs = out
    final = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    table = spm.piece_bytes(spm.Vocabulary.load())
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted((r["doc_id"], spm.decode_ids(table, r["token_ids"])) for r in final) == texts


def test_run_and_registry(spark):
    import __spark_entry__ as entry
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_oracles(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cur.fetchall()), key=str)
        df = queries.QUERIES[name](spark, SF)
        got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
        assert sorted(names) == sorted(df.columns) and got == want
