"""Token ids by words: a word is split once, and texts encode as the library does."""

import pytest

from sigloom.llm import tokenids


def encoder():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return tokenids.Encoder(f.read())


def test_a_word_is_split_once(monkeypatch):
    e, met = encoder(), []
    monkeypatch.setattr(tokenids, "PIECES", type("Split", (), {"findall": lambda self, text, split=tokenids.PIECES.findall: met.append(text) or split(text)})())
    text = "Well, it's plain: x_1 Well, it's plain: x_1"
    assert e.encode(text) == e.encode(text) == e.pack(e.tokenizer.encode(text, add_special_tokens=False).ids)
    assert sorted(met) == sorted(["Well,", "Well,", " Well,", " it's", " plain:", " x_1"])


@pytest.mark.parametrize("ends", ["", " ", "  ", "\n", "\n ", " \n", " \n ", "\t  x", "\x85 ", "  y", "   "])
def test_spaces_in_runs_encode_as_the_library_does(ends):
    e = encoder()
    for text in (ends, "a" + ends, ends + "a", "a" + ends + "b c" + ends, "'s" + ends + "'s", "é," + ends + "1" + ends + "é"):
        assert e.encode(text) == e.pack(e.tokenizer.encode(text, add_special_tokens=False).ids), text
