"""Token ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: A text with a run this long of one character class goes to the slower library, whose merges stay near linear there.
_LONG_RUN = re.compile(r"\S{20000}|\s{20000}")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocab: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids of the vocabulary file (JSON of the tokenizers library), without added special tokens.

    The ids are those of the library's plain encode(): the string of a special token, such as <|endoftext|>, is that one
    token. Where the same vocabulary lies beside the file as ranks (``.tiktoken``), the rank library encodes texts
    without such strings, with the same ids, about four times as fast.
    """
    import os

    from tokenizers import Tokenizer

    vocab = vocab or default_vocab()
    slow = Tokenizer.from_file(vocab)
    added = re.compile("|".join(re.escape(t.content) for t in slow.get_added_tokens_decoder().values()) or r"(?!)")

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    ranks = re.sub(r"\.json$", ".tiktoken", vocab)
    if ranks == vocab or not os.path.exists(ranks):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if added.search(text) or len(text) >= 20000 and _LONG_RUN.search(text):
            return plain(text)
        return fast.encode_ordinary(text)

    return encode
