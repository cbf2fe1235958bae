import pytest
from pyspark.sql import functions as F

from veritrail.llm import bpe, neardup


def test_counts_are_the_sizes_of_the_lists(spark):
    if not bpe.os.path.isdir(bpe.TOKENIZERS):
        pytest.skip("no tokenizers here")
    texts = [None, "", " ", "the the the queue", "the " + "xyzw" * 40, "naïve � résumé", "a\n\n b\t\tc", "q" * 2000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(r.doc_id, len(r.ids)) for r in bpe.encode(d).collect()}
    assert {tuple(r) for r in bpe.token_counts(d).collect()} == want
    known = bpe.hot_words(d, hot=2)  # words in the map and beyond it
    plan = d.select("doc_id", bpe.counted(F.col("text"), known).alias("tokens"))
    assert {tuple(r) for r in plan.collect()} == want


def test_word_hashes_are_sorted_as_numbers(spark):
    n = spark.createDataFrame([(bytes([i]), " ".join(f"w{j}" for j in range(i, i + 30)), None) for i in range(5)], "id binary, title string, body string")
    sets = neardup.word_sets(n)
    assert "array_sort" not in sets._jdf.queryExecution().optimizedPlan().toString()  # it calls a comparison function for each two
    rows = sets.collect()
    assert len(rows) == 5 and all(len(r.words) == 30 and r.words == sorted(r.words) for r in rows)


def test_pairs_of_bytes_are_those_of_the_rank_map(spark):
    if not bpe.os.path.isdir(bpe.TOKENIZERS):
        pytest.skip("no tokenizers here")
    ids = [[], [0], [255, 0], list(range(256)), [(7 * i * i + i // 3) % 256 for i in range(3000)]]
    both = bpe.with_rank_map(lambda book: F.array(bpe._bytes(book, F.col("t")), bpe._start(book, F.col("t"))))
    for r in spark.createDataFrame([(x,) for x in ids], "t array<int>").select(both.alias("x")).collect():
        assert r.x[0] == r.x[1]


def test_a_turn_copies_no_array(spark):
    if not bpe.os.path.isdir(bpe.TOKENIZERS):
        pytest.skip("no tokenizers here")
    book, t = F.col("book"), F.col("t")
    d = spark.createDataFrame([([0], [1])], "book array<int>, t array<int>")
    plan = d.select(bpe._fold(book, t).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "getarrayitem(transform(" not in plan.lower() and "get(transform(" not in plan.lower()  # such a variable copies what is made of it


def test_sizes_of_words_need_no_list(spark):
    if not bpe.os.path.isdir(bpe.TOKENIZERS):
        pytest.skip("no tokenizers here")
    texts = [" fetchNodeFolkoush", " slailtka\u00e2", " 9998", "", " \u0441\u043a\u0430\u0441\u0445\u0441\u043a\u043e\u043d\u0434", "x" * 65, "ab" * 2000]
    rows = spark.createDataFrame([(x,) for x in texts], "w string").select(bpe.with_rank_map(lambda b: F.array_size(bpe.encode_word(b, F.col("w")))).alias("a"), bpe.with_rank_map(lambda b: bpe.word_size(b, F.col("w"))).alias("b")).collect()
    assert all(r.a == r.b is not None for r in rows) and len(rows) == len(texts)
