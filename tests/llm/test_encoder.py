"""The encoder of token shards: what goes to the library, and equality with it."""

from __future__ import annotations

import random

import pyarrow as pa

from pagewright.llm import token_output
from pagewright.llm.queries import tokenizer_path


def test_new_words_go_to_the_library_many_to_a_text(monkeypatch):
    encoder = token_output.Encoder(tokenizer_path())
    sent = []
    batch = encoder._batch
    monkeypatch.setattr(encoder, "_batch", lambda texts: sent.extend(texts) or batch(texts))
    texts = ["start " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{sign}" for i in range(4000)) for sign in (",", ".", "")]
    first = encoder.encode(texts)
    assert len(sent) < 100
    assert [x.tolist() for x in first] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library_on_odd_texts(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_WORDS", 40)  # most words are not kept
    rnd, encoder = random.Random(1), token_output.Encoder(tokenizer_path())
    parts = ["a", "The", "é", "é", "—", "\n", "\t", " ", "  ", "'s", "12", ".", ",'t", "　", "\x1c", "\x85", "\0", "<|endoftext|>", "日本", "x\n", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    for i in range(0, 3000, 500):
        assert [x.tolist() for x in encoder.encode(texts[i : i + 500])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[i : i + 500]]
    assert encoder.encode([]) == []


def _ids(encoder, texts):
    return [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_pieces_of_new_words_are_not_sent_again(monkeypatch):
    encoder = token_output.Encoder(tokenizer_path())
    stems = [f"w{chr(97 + i % 26)}\u00e9{chr(97 + i // 26)}" for i in range(600)]
    text = lambda sign: "start " + " ".join(s + sign for s in stems)
    encoder.encode([text("!") + " x.\nHe y, z. x"])
    sent = []
    batch = encoder._batch
    monkeypatch.setattr(encoder, "_batch", lambda texts: sent.extend(texts) or batch(texts))
    texts = [text(""), text("."), text(","), text(".\nHe")]
    assert [x.tolist() for x in encoder.encode(texts)] == _ids(encoder, texts)
    assert not sent


def test_what_the_library_is_given_at_once_is_small():
    """Its results hold some hundred bytes a token; 1,024 texts of 128 words each took 45 MB or more."""
    encoder, most = token_output.Encoder(tokenizer_path()), []

    class Library:
        def encode_batch_fast(self, texts, **more):
            most.append(sum(map(len, texts)))
            return encode_batch_fast(texts, **more)

    encode_batch_fast, encoder.tokenizer = encoder.tokenizer.encode_batch_fast, Library()
    encoder.encode(["start " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(40_000))])
    assert max(most) < 100_000


def test_encoder_equals_the_library_on_marks_and_numbers():
    rnd, encoder = random.Random(2), token_output.Encoder(tokenizer_path())
    parts = ["a", "The", "\u00e9", "\u00ff", "\u00d7", "\u0301", "\u00b2", "\u2167", "\u01c5", "\u00aa", "\u4e00", "\u200b", "\u00a0", "\u3000", "\x1c", "\n", " ", " ", "'", "'s", "'ll", "7", "-", "_", "!"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(24))) for _ in range(6000)]
    assert [x.tolist() for x in encoder.encode(texts)] == _ids(encoder, texts)


def test_workers_get_no_more_text_than_is_encoded_at_once(spark, tmp_path, monkeypatch):
    """Parts of 10 MB came as one batch."""
    schema = token_output.SHARD_ARROW

    def sizes(path, end_id):
        def run(batches):
            for n, b in enumerate(batches):
                yield pa.RecordBatch.from_pylist([{"part": b.column(0)[0].as_py(), "seq": n, "n_tokens": b.nbytes}], schema)

        return run

    monkeypatch.setattr(token_output, "_shards", sizes)
    token_output.write_tokens(spark.range(40).selectExpr("id doc_id", "repeat('word ', 200000) text"), str(tmp_path / "out"), "")
    found = [r.n_tokens for r in token_output.read_shards(spark, str(tmp_path / "out")).collect()]
    assert sum(found) > 40_000_000
    assert max(found) < 6_000_000
