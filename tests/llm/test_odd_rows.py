"""Null, empty, repeated and very long rows through the operators and stages that keep or judge rows."""

import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, exact_dedup, licenses, ngram_join, pieces, quality, toxicity, urls
from tracewright.llm.common import durable

ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (4, "a"), (None, "a"), (None, None), (5, "É ß 😀 x"), (6, "word " * 5000)]
#: Columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, key long, digest string, hash long, gone string, first long, comp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "d", 7, "g", 7, 7) for i, t in rows], SCHEMA)


def kept(df):
    assert df.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())


def rows(*chosen):
    return sorted((str(i), t or "") for i, t in chosen)


def test_exact_dedup_of_odd_rows(spark):
    # Null and empty are equal; of the texts "a", one of the two rows of id 4 stays.
    want = rows((1, None), (3, " \t\n"), (4, "a"), (5, "É ß 😀 x"), (6, "word " * 5000))
    assert kept(exact_dedup.drop_duplicates(frame(spark, ROWS))) == want
    assert kept(exact_dedup.drop_duplicates(frame(spark, []))) == []


def test_near_dedup_of_odd_rows(spark):
    # Rows without words stay; rows that repeat the smallest id stay too.
    assert kept(ngram_join.keep_one_of_each(frame(spark, ROWS))) == rows(*ROWS[:5], *ROWS[6:])
    assert kept(ngram_join.keep_one_of_each(frame(spark, []))) == []


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "word word word word"), (2, None), (3, "")], "item_id long, text string")
    assert kept(decontaminate.drop_contaminated(frame(spark, ROWS), bench)) == rows(*ROWS[:-1])
    assert kept(decontaminate.drop_contaminated(frame(spark, ROWS), bench.where("false"))) == rows(*ROWS)
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(frame(spark, ROWS), bench).collect()] == [(6, 1, 0)]


def test_quality_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert kept(quality.keep_good(frame(spark, ROWS), none)) == rows(*ROWS)  # the prior is one half
    assert kept(quality.keep_good(frame(spark, []), none)) == []


def test_urls_of_odd_rows(spark):
    odd = [(1, None), (1, None), (None, ""), (2, "http://"), (3, "x" * 100_000), (4, "http://" + "ab" * 200 + ".net/")]
    got = urls.judge(spark.createDataFrame([(i, u, "h", 1.0) for i, u in odd], "page_id long, url string, host string, score double")).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], r["verdict"]) for r in got) == sorted((str(i), "ab" * 200 + ".net" if i == 4 else "", "/" if i == 4 else "", "allow") for i, _ in odd)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copied_families_keep_one_carrier(spark):
    base = [" ".join(f"w{j}x{k}" for k in range(60)) for j in range(6)]
    docs = [(i, base[i % 6] + (" tail" if i % 12 > 5 else "")) for i in range(960)]
    got = ngram_join.jaccard_components(frame(spark, docs)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i % 6) for i in range(960)}


def test_long_texts_take_linear_time():
    began = time.time()
    scan = licenses.scan("under the mit license " * 100_000, licenses.automaton())
    assert len(scan["matches"]) == 100_000 and scan["matches"][-1]["start"] == 4 * 99_999
    restore = toxicity.Restorer(toxicity.LanguageModel(toxicity.trigrams(b"the quick moron " * 50)))
    assert restore("a" * 1_000_000 + " " + "abcd" * 250_000) == {"a"}
    assert time.time() - began < 60


def test_segments_join_to_the_whole_text():
    for text in ("a  b   c d", " a", "a ", "", "   ", "ab" * 9, "a b c " * 9):
        for size in (1, 2, 3, 7):
            got = list(pieces.segments(text, size))
            assert " ".join(got) == text
            assert sum((pieces.split(x) for x in got), []) == pieces.split(text)


def test_long_chunks_are_coded_and_forgotten(spark):
    import public_tokenizers

    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["word " * 300_000 + "  tail ", "x" * 5000 + " y", ""]
    for t, (ids, text) in zip(texts, codec(texts), strict=True):
        want = codec.model.encode(t, add_bos=True, add_eos=True)
        assert ids == pieces.pack(want) and text == codec.model.decode(want)
    assert max(map(len, codec.ids)) <= pieces.LONGEST and codec.size < pieces.REMEMBERED


def test_durable_tables_can_be_released(spark):
    from tracewright.llm.common import release

    df = durable(spark.range(3), "t")
    assert df.count() == 3
    release(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.schema(df.schema).parquet(df.durable_path).select(F.sum("id")).collect()
