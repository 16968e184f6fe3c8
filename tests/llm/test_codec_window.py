"""The codec's own path through long texts without blanks holds a bounded window."""

import pytest

from ratesift.llm.sentencepiece_codec import MODEL, Codec, Vocabulary


def test_long_spans_are_fed_in_slices():
    sentencepiece = pytest.importorskip("sentencepiece")
    model, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec(Vocabulary())
    feed, most = codec.encoder.feed, [0]

    def watched(text):
        ids = feed(text)
        most[0] = max(most[0], len(codec.encoder.tokens))
        return ids

    codec.encoder.feed = watched
    for text in ("日本語テキスト" * 3000, "QmFzZTY0IHRleHQ" * 2000, "ab cd " + "x" * 30_000 + " ef"):
        ids, decoded = codec.both(text)
        assert ids.tolist() == model.encode(text) and decoded == text
    assert 0 < most[0] <= 12 * codec.v.longest
