"""Round trips of patched frame-of-reference blocks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import token_blocks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300), max_size=5), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_blocks_round_trip(documents, percentile):
    ids = np.array([x for d in documents for x in d], np.uint32)
    data, start, blocks = token_blocks.encode_blocks(ids, np.array([len(d) for d in documents], np.int64), percentile)
    payload, k = data.tobytes(), 0
    for d, n in zip(documents, blocks):
        assert token_blocks.decode(payload, start[k : k + n].tolist()) == d
        k += n


def test_outliers_are_exceptions():
    ids = np.array([5] * 120 + [2**30] * 8, np.uint32)
    data, _, _ = token_blocks.encode_blocks(ids, np.array([128]))
    assert data[5] == 0 and data[6] == 8 and len(data) == token_blocks.HEAD + 5 * 8


def test_documents_round_trip(documents, texts):
    encode = token_blocks.tokenizer(token_blocks.TOKENIZER)
    rows = token_blocks.encode(documents).collect()
    ids = {r["doc_id"]: token_blocks.decode(bytes(r["payload"]), r["block_starts"]) for r in rows}
    assert ids == {d: encode(t) for d, t, _ in texts}
    assert {r["doc_id"]: r["ids"] for r in token_blocks.decoded(token_blocks.encode(documents)).collect()} == ids
    # fewer bytes than at 16 bits an id, and any block by itself
    assert sum(len(r["payload"]) for r in rows) < 2.1 * sum(map(len, ids.values()))
    r = max(rows, key=lambda r: r["n_blocks"])
    assert token_blocks.decode_block(bytes(r["payload"]), r["block_starts"][3]) == ids[r["doc_id"]][3 * 128 : 4 * 128]


def test_other_vocabularies(spark):
    df = spark.createDataFrame([(1, "Some text, <|endoftext|> here."), (2, None)], "doc_id long, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"):
        path = f"/opt/tokenizers/{name}"
        got = {r["doc_id"]: r["ids"] for r in token_blocks.decoded(token_blocks.encode(df, path)).collect()}
        assert got == {1: list(token_blocks.tokenizer(path)("Some text, <|endoftext|> here.")), 2: None}


def test_long_white_space_is_encoded_as_whole_texts_are():
    encode = token_blocks.tokenizer(token_blocks.TOKENIZER)
    plain = encode.__closure__[0].cell_contents
    for text in ("a" + " " * 600 + "b c", " " * 700, "x" + "\n \t" * 300 + "y", " " * 600 + "\n", "a \u2003" + "\u2003" * 600 + ", b" + " " * 513, " " * 512 + "1" + "  " * 400 + "!"):
        assert encode(text) == plain(text), repr(text[:9])
    million = encode("a" + " " * 1_000_000 + "b")
    assert len(million) == 1_000_001 and encode(" " * 1_000_000) == million[1:2] * 1_000_000
    assert sum(map(len, map(str, encode("!" * 1_000_000)))) > 0


def test_a_text_of_white_space_does_not_fail_its_task(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "!" * 300_000 + "\n" * 300_000 + "x"), (3, "ok")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_blocks.decoded(token_blocks.encode(df)).collect()}
    assert len(rows[1]["ids"]) == 1_000_000 and rows[3]["ids"] == token_blocks.tokenizer(token_blocks.TOKENIZER)("ok")


def test_ids_beyond_31_bits_are_decoded(spark):
    ids = [2**32 - 1, 0, 2**31]
    data, start, _ = token_blocks.encode_blocks(np.array(ids, np.uint32), np.array([3]))
    df = spark.createDataFrame([("k", start.tolist(), bytearray(data.tobytes()))], "doc_id string, block_starts array<int>, payload binary")
    assert token_blocks.decoded(df).first()["ids"] == ids
