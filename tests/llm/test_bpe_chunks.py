import hashlib

import numpy as np
import pytest
from odd import documents, empty_documents, odd_documents
from pairloom.llm import bpe_chunks, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe_path())
    t.no_truncation()
    t.no_padding()
    return t


def plain(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)


def test_equals_whole_text_encoding(spark, sf_dir, tokenizer):
    for docs in (odd_documents(spark), documents(spark, sf_dir)):
        coded = bpe_chunks.encode(docs, queries.word_bpe_path())
        names = coded.columns[-2:]
        for r in coded.collect():
            assert (bytes(r[names[0]]), r[names[1]]) == plain(tokenizer, r["text"])
    assert bpe_chunks.encode(empty_documents(spark), queries.word_bpe_path()).count() == 0


def test_clashing_names_stay(spark):
    docs = odd_documents(spark)
    coded = bpe_chunks.encode(docs, queries.word_bpe_path())
    assert coded.columns == [*docs.columns, "ids_", "decoded_"]
    assert coded.where("ids <> 'taken'").count() == 0


def test_shared_chunks_are_encoded_once_and_joins_repaired(tokenizer):
    coder = bpe_chunks.ChunkCoder(queries.word_bpe_path())
    text = " ".join(f"Word{i * i} don't, stop{i}" for i in range(2000))
    texts = [text, "Other begin " + text, "x" * 9000 + text[1:], text.replace(" ", "", 5)]
    ids, decoded = coder.code([t.encode() for t in texts])
    for t, i, d in zip(texts, ids, decoded, strict=True):
        assert (i, d.decode()) == plain(tokenizer, t)
    assert coder.reused > coder.made


def test_what_is_used_stays_cached(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "CACHED_WORDS", 50)
    monkeypatch.setattr(bpe_chunks, "CACHED_CHUNK_BYTES", 3000)
    coder = bpe_chunks.ChunkCoder(queries.word_bpe_path())
    often = " ".join(f"common{i}" for i in range(30))
    for n in range(40):
        text = f"{often} rare{n} {often} {' '.join(f'own{n}x{i}' for i in range(40))}"
        ids, decoded = coder.code([text.encode()])
        assert (ids[0], decoded[0].decode()) == plain(tokenizer, text)
        assert b"common7" in coder.words or b"common7" in coder.old_words
        assert len(coder.words) <= 50 + 100 and len(coder.old_words) <= 50 + 100


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        bpe_chunks.ChunkCoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    rows = queries.QUERIES["op1_bpe_chunk_reuse"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = plain(tokenizer, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_coders_are_dropped_by_other_operators():
    from pairloom.llm import bpe_chunks
    bpe_chunks._coders["none"] = object()
    bpe_chunks.forget_coders()
    assert not bpe_chunks._coders
    bpe_chunks.give_back()
