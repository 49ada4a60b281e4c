import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from shelfwise.llm.piece_bpe import encode_decode, op12_sentencepiece, piece_table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "t", "h", " ", "  ", "\n", "é", "漢", "🤖", "▁", "1", "2", ".", "\0", "ß", "the", "ing", "́", "�", "ก", "<s>", "aaaa", "ĠĠ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library_on_random_texts(library):
    table, rnd = piece_table(MODEL), random.Random(12)
    for _ in range(3000):
        text = "".join(rnd.choices(PARTS, k=rnd.randrange(40)))
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(table.encode(text), np.uintc).tolist() == want, text
        assert table.decode(np.array(want)) == library.decode(want)


def test_decodes_any_ids_as_the_library_does(library):
    table, rnd = piece_table(MODEL), random.Random(5)
    for _ in range(3000):
        ids = [rnd.choice((rnd.randrange(32000), rnd.randrange(260), 29871)) for _ in range(rnd.randrange(12))]
        assert table.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_pair_test_replays_merges(library):
    """The test by the parts at the border equals merging both strings step by step."""
    table, rnd = piece_table(MODEL), random.Random(3)
    some = rnd.sample(sorted(table.ids), 400)
    for left, right in zip(some, reversed(some)):
        for a, b in ((left, right), (left, right[0]), (left[-1], right)):
            assert table._meets(a, b) == table._keeps(a + b, len(a)), (a, b)


def test_one_long_segment_and_full_tables(library):
    table, rnd = piece_table(MODEL), random.Random(7)
    text = "".join(rnd.choices("abcdefgthé", k=200_000))
    assert np.frombuffer(table.encode(text), np.uintc).tolist() == library.encode(text, add_bos=True, add_eos=True)
    kept, table.remembered.most = table.remembered.most, 3
    try:
        text = "one two three four five six seven one two"
        assert np.frombuffer(table.encode(text), np.uintc).tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert len(table.remembered) <= 3
    finally:
        table.remembered.most = kept


def want(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()


def test_rows(spark, library):
    docs = [(1, None), (2, ""), (None, " x "), (3, "a  b"), (3, "a  b"), (4, "🤖" * 5000 + "word " * 20000)]
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in docs], "doc_id long, text string, ids int, decoded string")
    got = {(r.doc_id, bytes(r.ids), r.decoded) for r in encode_decode(df, batch_chars=10).collect()}
    ids = [library.encode(t or "", add_bos=True, add_eos=True) for _, t in docs]
    assert got == {(i, np.array(x, "<u4").tobytes(), library.decode(x)) for (i, _), x in zip(docs, ids)}
    assert encode_decode(df).count() == len(docs) and encode_decode(df.limit(0)).count() == 0


def test_query_equals_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_sentencepiece(spark, d).collect()}
    assert got == {i: want(library, t) for i, t in docs.items()}
