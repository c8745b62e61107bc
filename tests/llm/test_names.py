"""Columns of any name go through every operator that keeps the columns of its input."""

import public_tokenizers as P
import pytest

from quillstack.llm import byte_bpe, prefix_tokens, quality_ngram, secret_links, simhash_trie, source_mix

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["a.b", "back`tick"]

OPERATORS = {
    "encode": lambda d: byte_bpe.encode(d, RANKS, P.PATTERN),
    "decode": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS, P.PATTERN), RANKS, P.PATTERN),
    "counts": lambda d: prefix_tokens.with_counts(d, VOCABULARY, P.PATTERN, 9),
    "judged": quality_ngram.judged,
    "scan": secret_links.scan,
    "redact": secret_links.redact,
    "fingerprint": simhash_trie.with_fingerprint,
    "keep_one": simhash_trie.keep_one,
    "mixed": source_mix.mixed,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_names(odd_docs, name):
    out = OPERATORS[name](odd_docs)
    assert set(ODD) <= set(out.columns)
    rows = out.collect()
    assert rows and {(r["a.b"], r["back`tick"]) for r in rows} == {("dot", 1)}
    low = [c.lower() for c in out.columns]
    assert len(low) == len(set(low))
