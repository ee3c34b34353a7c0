from hypothesis import given, settings
from hypothesis import strategies as st

from portolan.llm import tokens

BYTES = open(tokens.BYTES, "rb").read()
BPE, SHORT = tokens.Ranks(BYTES), tokens.Ranks(BYTES, 3)
PIECES = tokens.tokenizer("model", open(tokens.PIECES, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t.a1é漢'")), max_size=40))
def test_runs_of_blanks_taken_out_give_the_same_ids(text):
    assert SHORT.encode(text) == BPE.inner.encode_ordinary(text)


def test_very_long_texts_come_back():
    for text in (" " * 1_000_000, "a" + "\n \t" * 400_000 + "b", "x" * 300_000, "ab " * 200_000, "", "naïve 😀 <|endoftext|> </s>"):
        assert BPE.decode(BPE.encode(text)) == text and PIECES.decode(PIECES.encode(text)) == text
    assert PIECES.decode(PIECES.encode("a▁b")) == "a b"


def test_vocabularies():
    assert max(BPE.inner._mergeable_ranks.values()) < tokens.BYTES_END
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.PIECES)
    assert model.vocab_size() == tokens.PIECES_VOCABULARY and model.eos_id() == tokens.PIECES_END
