"""The pipeline's stages, each on what its predecessor kept, against brute force; and the registered queries' rows."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from test_dedup import bytes_left, groups

import corpus_pipeline
from trailgrain.llm import queries
from trailgrain.llm.quality_classifier import classify
from trailgrain.llm.quality_rules import quality_rules

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert out.columns == list(corpus_pipeline.COLUMNS)
        after = rows(out)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
            assert after and sorted(after) == sorted(x for x in before if x[0] in kept)
        elif name == "quality_classifier":
            kept = {r.doc_id for r in classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
            assert sorted(after) == sorted(x for x in before if x[0] in kept)
            assert len(after) > 0.9 * len(before)
        elif name == "near_duplicates":
            first = {g for _, g in groups(before).values()}
            assert sorted(after) == sorted(x for x in before if x[0] in first)
        else:
            want = {d: n for d, (_, n, _, _) in bytes_left(before).items()}
            assert {d for d, _ in after} == {d for d, _ in before}
            whole = dict(before)
            assert all(len(t.encode()) <= len(whole[d].encode()) - want[d] and (want[d] or t == whole[d]) for d, t in after)
        docs = out
    run, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), out.toPandas()
    for d, t in before:
        ids = np.array([*run.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = pieces[pieces.doc_id == d].sort_values("start")
        assert own.length.sum() == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own.itertuples())
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096


def test_pipeline_is_its_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "suffix_dedup", "packing"]


def test_registered_digests(spark):
    docs = dict(rows(spark.read.parquet(f"{DATA}/documents.parquet")))
    left = bytes_left(list(docs.items()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, DATA).collect()} == left
    for r in queries.op7_byte_bpe(spark, DATA).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    assert sorted(f"op{n}" for n in range(1, 11)) == sorted(k.split("_")[0] for k in queries.queries())


def test_rows_with_null_and_repeated_ids(spark):
    good = (docs := spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' and n_chars between 300 and 2000").orderBy("doc_id")).first().text
    lone = docs.where("doc_id > 100").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = lambda pairs: spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in pairs], schema)
    bad = "#$% " * 50
    assert {(d, t) for d, t in rows(corpus_pipeline.keep_good(spark, table([(None, good), (1, good), (1, bad), (None, bad)]), DATA))} == {(None, good), (1, good)}
    given = [(1, "a b c d e f g h"), (1, "one two three four five six"), (2, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "x y z u v w"), (1, "a b c d e f g h")]
    assert sorted(rows(corpus_pipeline.keep_one_of_near(spark, table(given), DATA)), key=str) == sorted([given[0], given[1], given[4]], key=str)
    repeat = "".join(chr(0x3041 + 7 * i % 80) for i in range(60))
    cut = [(1, "\ufffd start \u3042" + repeat + "\u30a2 end"), (2, "\ufffd other \u3044" + repeat + "\u30a4 more"), (2, lone), (2, lone)]
    got = rows(corpus_pipeline.cut_repeats(spark, table(cut), DATA))
    assert len(got) == 4
    assert cut[0] in got
    second = next(t for d, t in got if d == 2 and t.startswith("\ufffd"))
    assert second.startswith("\ufffd other ")
    assert second.endswith(" more")
    assert second.count("\ufffd") == 1


def test_stages_on_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = docs.limit(40).selectExpr("*", "1 as key", "'x' as block", "2 as kept", "3 as row", "4 as node", "5 as predicted", "6 as component_id", "7 as ids", "'t' as words")
    odd = more.limit(1).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars", *[c for c in more.columns if c not in docs.columns])
    table = more.unionByName(odd).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        out = stage(spark, table, DATA)
        assert out.columns == list(corpus_pipeline.COLUMNS) or name == "packing"
        nulls = out.where("doc_id is null").count()
        assert nulls == {"quality_rules": 0, "quality_classifier": 2, "near_duplicates": 1, "suffix_dedup": 2, "packing": 2}[name] or name == "quality_classifier"
        assert out.where("doc_id is not null").count() > 0
