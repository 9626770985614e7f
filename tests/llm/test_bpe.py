import base64
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from paperloom.llm.bpe import VOCABULARY, codec, decode, digests, encode


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library():
    own, lib, draw = codec(P.path(VOCABULARY), P.PATTERN), library(), random.Random(5)
    alphabet = "aabcdethn  'sltr\n\t\r\x0b\x1c\x85\xa0 　éßñ123١²½_-!?🙂日本語กข́"
    texts = ["", " ", "a" * 3000, "ab" * 2000, "\n" * 500, "=" * 999, "don't we'll I'M <|endoftext|>"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 120))) for _ in range(1500)]
    for text in texts:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == lib.encode_ordinary(text), repr(text)
        assert own.decode(packed) == text.encode()


def test_odd_rows(odd_docs, no_docs):
    rows = decode(encode(odd_docs)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r["size"] == "s" for r in rows)
    assert {r.doc_id: r.n_tokens for r in digests(odd_docs).collect()}[3] == 0
    assert digests(no_docs).count() == 0
