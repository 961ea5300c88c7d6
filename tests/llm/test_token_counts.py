from collections import Counter

import public_tokenizers as P
import tiktoken

from crewgate.llm import token_counts, tokens


def test_histogram_and_suffix_sums(docs, rows, nothing):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=tokens.rank_file(path),
                            special_tokens={})
    n = sorted(len(enc.encode_ordinary(t or "")) for _, t in rows)
    sums = token_counts.suffix_sums(token_counts.histogram(docs, path, P.PATTERN)).cache()
    got = {r.length: r for r in sums.collect()}
    assert {k: r.documents for k, r in got.items()} == dict(Counter(n))
    for k, r in got.items():
        assert r.documents_at_least == sum(x >= k for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= k)
        assert r.truncated_tokens == sum(min(x, k) for x in n)
        assert abs(r.share_at_most - sum(x <= k for x in n) / len(n)) < 1e-12
        assert (r.total_documents, r.total_tokens) == (len(n), sum(n))
    limits = [1, 10, 128, 1024, 10 ** 6]
    for r in token_counts.at_limits(sums, limits).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in n)
        assert r.documents_longer == sum(x > r.limit for x in n)
    for q in (0.1, 0.5, 0.9, 1.0):
        want = next(x for k, x in enumerate(n, 1) if k >= q * len(n) - 1e-9)
        assert token_counts.quantile(sums, q).first().length == want
    assert token_counts.suffix_sums(
        token_counts.histogram(nothing, path, P.PATTERN)).count() == 0
