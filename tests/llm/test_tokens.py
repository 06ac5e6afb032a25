import struct

import pytest

from opinara.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
ODD = [
    "", " ", "  a  b", "a\n b", "a \nb", "a\nb\n", "\n", "\na", "a\n\nb", "a\n\n\nb c", "don't  can't 's x", "a ́b c\x1cd", "tab\t x", "a ",
    " a", "A B <|endoftext|> x", "é ß ΑΣ ΟΔΟΣ x İa", "1 2 33 4-5 -- . , a., .a x!! y?\n z", "日本語 テキスト 。", "👍🏽 a", "a\xa0 b", "\xa0",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name, make_prose):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    library.encode_special_tokens = True
    enc = Encoder(P.path(name), remembered=50)
    texts = ODD + [make_prose(i, 60).replace(" of", ".\nOf") for i in range(30)]
    for text in texts + texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert enc.ids(text) == struct.pack(f"<{len(ids)}I", *ids), text
