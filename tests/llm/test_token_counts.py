import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.token_counts import Counter, balanced, cuts_are_safe, pieces, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_pieces_join_to_the_text_and_counts_are_those_of_whole_texts(whole):
    r, counter = random.Random(1), Counter(PATH)
    letters = " \n\t\r\x1c\x85 　ab'1!sé<|>"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 16)))
        assert "".join(pieces(text)) == text
        assert counter.counts([text]) == [len(whole.encode(text, add_special_tokens=False))], text


def test_batches_are_balanced_by_bytes():
    batches = list(balanced(["é" * 10] * 100, 100))
    assert sum(map(len, batches)) == 100 and all(sum(len(x.encode()) for x in b) <= 100 for b in batches)
    assert list(balanced(["a" * 500, "b"], 100)) == [["a" * 500], ["b"]]


def test_odd_rows(spark, odd_rows, odd_docs, clashing_docs, no_docs, whole):
    want = sorted((str(i), len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False))) for i, t, *_ in odd_rows)
    for docs in (odd_docs, clashing_docs):
        got = token_counts(docs, PATH, limit=10).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 10) for r in got)
    assert token_counts(no_docs, PATH).count() == 0


def test_sentencepiece_models_get_whole_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["a  b", "", "Hello there, world"]
    assert Counter(path).counts(texts) == [len(x) for x in model.encode(texts)]


def test_long_texts_without_blanks_are_cut_and_counted_right(whole):
    r, counter = random.Random(2), Counter(PATH)
    for letters in ("ab1\n", "ab12", "ab!\t1", "ab'sé1"):
        text = "".join(r.choice(letters) for _ in range(30_000))
        cut = pieces(text)
        assert "".join(cut) == text and max(map(len, cut)) < 3000 and counter.counts([text]) == [len(whole.encode(text, add_special_tokens=False))]


def test_files_of_another_pattern_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert cuts_are_safe(PATH) and not cuts_are_safe(path)
    model = Tokenizer.from_file(path)
    texts = ["A  b\n.", "", "it's 12 of\nthe...\n\nworld"]
    assert Counter(path).counts(texts) == [len(model.encode(x, add_special_tokens=False)) for x in texts]
