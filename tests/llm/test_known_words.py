import numpy as np
import pyarrow as pa

from tessera.llm import tokens

TEXTS = ["The cat, the CAT. x9 Ärger", None, "dog cat. cat x9 " + "long" * 30, "", "a b c d e f g h Dog, dog 日本 x9"]


def asked(known, texts, coder):
    """Ids per text, and the words that had to be encoded."""
    seen = []
    each, letters = coder._each, coder._letters
    coder.known = known
    coder._each = lambda listed: (seen.extend(listed), each(listed))[1]
    coder._letters = lambda listed: (seen.extend(listed), letters(listed))[1]
    out = []
    for _ in range(3):
        for t in texts:
            offsets, ids = coder.encode(pa.array([t or ""]))
            out.append(ids[offsets[0]:offsets[1]].tolist())
    return out, seen


def test_words_are_encoded_once_and_few_are_kept():
    plain = tokens.WordTokenizer(tokens.default_tokenizer())
    want = [plain.inner.encode(t or "", add_special_tokens=False).ids for t in TEXTS] * 3
    out, seen = asked(tokens.Remembered(), TEXTS, tokens.WordTokenizer(tokens.default_tokenizer()))
    short = [w for w in seen if 0 < len(w) <= 40]
    assert out == want and len(short) == len(set(short))
    small = tokens.Remembered(6)
    out, again = asked(small, TEXTS, tokens.WordTokenizer(tokens.default_tokenizer()))
    assert out == want and len(again) > len(seen) and len(small.words) <= 6
    assert len(small.starts) == len(small.sizes) == len(small.used) == len(small.words) and len(small.ids) == small.sizes.sum()
    assert small.ids.dtype == np.uint32
