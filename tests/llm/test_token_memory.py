"""The memory of encoded words: frequent words outlive a full memory, and texts part at the same stops."""

import re
import string

import public_tokenizers

from gridloom.llm import token_store


def test_frequent_words_are_encoded_once(monkeypatch):
    monkeypatch.setattr(token_store, "_CACHE_WORDS", 20)
    encoder = token_store.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    learned, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.extend(words), learn(words)))
    rare = [f"{a}{b}x" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    texts = [" ".join(rare[12 * k : 12 * k + 12]) + (" river" if k % 2 == 0 else "") for k in range(40)]
    got = [ids for t in texts for ids in encoder.encode([t])]
    assert learned.count(b"river") == 1
    for t, ids in zip(texts, got, strict=True):
        assert ids == token_store.array("I", encoder.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
    assert len(encoder.cache) + len(encoder.older) <= 2 * (20 + 13)


def test_texts_part_between_letters_and_stops():
    encoder = token_store.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for x in (b"a.b", b"a..", b"3.14", b"x.,y", b"one , two", b" .", b"a .", b"a\t.b", b"\xc3\xa9.", b",", b""):
        assert encoder._parted(x).split() == re.sub(rb"(?<=[a-z])(?=[.,])", b" ", x).split()
