from array import array

import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pagewright.llm import pretokens
from pagewright.llm.pretokens import byte_coder, word_counter
from pagewright.llm.token_counts import token_counts

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LATIN = st.text(st.characters(max_codepoint=0x24F), max_size=60)
MIXED = st.text(st.sampled_from("aZé ßİı's’“–€\t\n\r\x0b\x1c\x85\xa0 0½²'llRE<|>中😀́"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.one_of(LATIN, MIXED, st.text(max_size=30)))
def test_equal_to_the_library(text):
    assert word_counter(WORD).count(text) == len(word_counter(WORD).library.encode(text, add_special_tokens=False).ids)
    ids = memoryview(byte_coder(BYTE).ids(text)).cast("I").tolist()
    assert ids == byte_coder(BYTE).library.encode(text, add_special_tokens=False).ids


def test_whole_tokens_are_proved():
    counter = word_counter(WORD)
    assert len(counter.whole) > 20_000 and "the" in counter.whole
    assert all(counter.cost[w] == 1 == counter.merged(w) for w in list(counter.whole)[::97])


def test_rows(spark):
    lib = Tokenizer.from_file(WORD)
    texts = [None, "", "The cat", "The cat", "<|endoftext|> mid <|startoftext|>", "long words " * 30000, "İ Σς 中文 é", "x\x00y"]
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_counts(df, WORD, 9).collect()), key=str)
    want = [(i or None, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 9) for i, t in enumerate(texts)]
    assert got == sorted(want, key=str)
    assert token_counts(df.limit(0), WORD).count() == 0


def test_every_plain_character_as_the_library_has_it():
    """Each beside letters, digits, blanks, marks and its like; by this module's own path, not the library's."""
    plain = [c for c in map(chr, range(0x20, 0x10000)) if pretokens._PLAIN.match(c)]
    assert len(plain) > 32_000
    counter, coder = pretokens.WordCounter(WORD), pretokens.ByteCoder(BYTE)
    words, bytes_ = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    counter.library = coder.library = None
    for at in range(0, len(plain), 64):
        some = plain[at : at + 64]
        text = " ".join(f"a{c}b {c}{c} 1{c}2 .{c}, {c}'s{d}{c.upper() if pretokens._PLAIN.match(c.upper()) else c}\n{c}" for c, d in zip(some, some[1:] + some[:1]))
        assert counter.count(text) == len(words.encode(text, add_special_tokens=False).ids), text
        assert list(array("I", coder.ids(text))) == bytes_.encode(text, add_special_tokens=False).ids, text
