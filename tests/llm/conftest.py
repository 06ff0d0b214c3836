import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use themselves must not disturb them: plain ones, results, and the marks of internal columns.
OWN = "row id fp set size sizes words word shard slot law place copies domain n_tokens component component_id key print line last data block bucket anchors h m at ctx off t k p votes template kind label diagonal begin end share spans items hits severity p_toxic toxic text_hash text_sha text_crc32 grown_shard leaf own a b".split()
MARKED = "_text _full _rest _order _bucket _cut _before _more _domain _lang _source _counter _place _start _severity _s _hashes _grams _packed _kept _all _base m_domain m_tokens m_cut m_order".split()
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in [*OWN, *MARKED])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, other scripts and white space."""
    r = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "été", "straße", "12", "of", "the", "mit", "license"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 12, 60, 61)]
    texts += ["", " ", "\n", "\n\n a \n", None, "x" * 5000, "A\tB\x0bC\x1cD E　F", "naïve ẞ K ſ", "<|endoftext|> a", "MIT License", "the MIT license. Apache License", "GNU General Public License GNU General Public License", "cc by cc-by"]
    texts += [texts[4] + " tail", texts[4], texts[4], " ".join(r.choice(vocabulary) for _ in range(20_000))]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[4], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing_docs(spark, odd_rows):
    return spark.createDataFrame([(*r, *(f"user's {c}" for c in [*OWN, *MARKED])) for r in odd_rows], CLASHING).repartition(2)


@pytest.fixture(scope="session")
def unharmed():
    """Whether the user's columns, but for those named as results, still hold the user's values."""

    def check(row, results):
        return all(row[c] == f"user's {c}" for c in [*OWN, *MARKED] if c not in results)

    return check


@pytest.fixture(scope="session")
def clashing_schema():
    return CLASHING, [*OWN, *MARKED]
