import zlib

import numpy as np
import pyarrow as pa
import pytest

from vitalspark.llm import sentencepiece_viterbi as V
from vitalspark.llm import token_store
from vitalspark.llm.common import new_folder, tokenizer_file

BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["", "a  b", "\n x", "  lead", "trail ", " ", "x\n\n\n y", "é́ ﬁ ① Ａ", "tab\tx", "　x 　 y", "▁x y", "x\x00y", "a" * 3000, "ab " * 500 + "\U0001d11e" * 40 + "   z", "don't  I'll   x", "<|endoftext|> <s>", "hello world\r\n hello world", "\x1c x \x85 y  z"]


def test_chunks_give_the_ids_of_whole_texts():
    whole = [[*x.ids, 2] for x in token_store._tokenizer(BPE).encode_batch(ODD, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in token_store.encode(pa.array(ODD), BPE)] == whole
    assert [x.tolist() for x in token_store.encode(pa.array([None, "x"]), BPE)][0] == [2]


def test_file_round_trip():
    arrays = [np.array(x, "<u4") for x in ([1, 2, 50_000], [2], [7] * 900)]
    for dictionary in (b"", None):
        if dictionary is None:
            import zstandard

            dictionary = zstandard.train_dictionary(2000, [np.arange(i, i + 50, dtype="<u2").tobytes() for i in range(400)]).as_bytes()
        content = token_store.pack([5, None, 9], arrays, dictionary, "<u2")
        reader = token_store.Reader(content)
        assert [reader.doc_id(i) for i in range(3)] == [5, None, 9] and all((reader.ids(i) == a).all() for i, a in enumerate(arrays))
    with pytest.raises(ValueError):
        token_store.Reader(content[:-4] + b"nope")


def test_store(spark, odd, empty):
    folder = new_folder(spark, "store")
    token_store.write(odd, folder, BPE, file_rows=4)
    got = token_store.read(spark, folder).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in odd.collect()))
    whole = token_store._tokenizer(BPE).encode_batch([r[2] for r in rows], add_special_tokens=False)
    want, start = [], 0
    for (_, _, _, doc_id), x in zip(rows, whole):
        ids = [*x.ids, 2]
        want.append((doc_id, start, len(ids), ids))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in got), key=lambda x: x[1]) == want
    digests = {(r.start, r.ids_crc32) for r in token_store.read(spark, folder, digest=True).collect()}
    assert digests == {(s, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, _, ids in want}
    assert {r.doc_id: r.ids for r in token_store.fetch(spark, folder, [3, 11, 999]).collect()} == {d: ids for d, _, _, ids in want if d in (3, 11)}
    none = new_folder(spark, "store")
    token_store.write(empty, none, BPE)
    assert token_store.read(spark, none).collect() == []


def test_viterbi_gives_the_library_s_ids():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for x in ODD:
        want = model.encode(x)
        assert V.encode_text(x, PIECES) == want and next(V.encode(pa.array([x]), PIECES)).tolist() == want
        assert V.decode(want, PIECES) == model.decode(want)


def test_viterbi_window_is_bounded():
    stream = V.Stream(V.pieces(PIECES))
    text = ("antidisestablishmentarianismé" * 400).replace(" ", V.SPACE)
    ids = [*stream.feed(text[:5000]), *stream.feed(text[5000:]), *stream.end()]
    assert V.decode(ids, PIECES) == text and stream.widest <= 2 * (V.COMMIT_EVERY + V.pieces(PIECES).longest)


def test_viterbi_documents(odd, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in odd.where("doc_id IS NOT NULL").collect()}
    got = V.encode_documents(odd, PIECES)
    assert all(r.ids == model.encode(texts[r.doc_id] or "") for r in got.where("doc_id IS NOT NULL").collect()) and got.count() == odd.count()
    assert all(r.text == (texts[r.doc_id] or "") for r in V.decode_documents(got, PIECES).where("doc_id IS NOT NULL").collect())
    assert all(r.same for r in V.round_trip(odd, PIECES).collect()) and V.round_trip(empty, PIECES).collect() == [] and V.encode_and_check(empty, PIECES).collect() == []
