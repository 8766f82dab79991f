"""What Python workers keep between tasks of different operators."""

import public_tokenizers
import pyarrow as pa
from docweave.llm import bpe, near_dedup
from docweave.llm._resident import let_go, resident, tidy


def held(spark):
    """By worker, the tokenizers that it keeps."""

    def run(batches):
        import os

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(bpe._tokenizer.__globals__["_kept"])])], ["pid", "n"])

    return {r.pid: r.n for r in spark.range(8).repartition(8).mapInArrow(run, "pid long, n long").collect()}


def test_sketches_let_go_of_tokenizers(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} and more of them") for i in range(64)], "doc_id long, text string").repartition(8)
    want = sorted(map(tuple, bpe.encode(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), contents=False).collect()))
    assert sum(held(spark).values()) > 0
    for _ in range(40):  # a round reaches only the workers that its tasks come to
        near_dedup.sketches(docs, 5, 192).collect()
        left = held(spark)
        if not any(left.values()):
            break
    assert not any(left.values())
    again = sorted(map(tuple, bpe.encode(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), contents=False).collect()))
    assert again == want


def test_tables_are_emptied_and_made_again():
    table = resident()
    seen = []

    def run(batches):
        seen.append(dict(table))
        table["x"] = 1
        yield from batches

    assert list(tidy(run)([1, 2])) == [1, 2] and list(tidy(run)([3])) == [3]
    assert seen == [{}, {"x": 1}]
    assert list(tidy(run, alone=True)([4])) == [4] and seen[2] == {} and table == {"x": 1}
    let_go()
    assert table == {}
