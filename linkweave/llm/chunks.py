"""Cutting text where a byte-level BPE pre-tokenizer always cuts, with a memo.

The pre-tokenizer pattern starts a new piece at every single space that a
non-space character follows, whatever stands before it.  So a text's ids are the
ids of its first chunk and of each later ``" " + chunk``, one after the other, and
the ids of a chunk can be remembered.  The memo is bounded; what does not fit in
is encoded each time.  Around an added token other rules hold, so a text that has one
is encoded as a whole.  Files with other rules of cutting are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

#: Chunks that a worker process remembers at most (about 150 bytes each).
MEMO = 600_000
_CUT = re.compile(r" (?=\S)")


def require_byte_level(definition: str) -> None:
    """Raise ValueError unless texts are cut by the byte-level rule that this module, and the encoder, rely on."""
    meant = json.loads(definition)
    rule, model = meant.get("pre_tokenizer") or {}, meant["model"]
    faults = {
        "a normalizer": meant.get("normalizer") is not None,
        "another pre-tokenizer": rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") is not False or rule.get("use_regex", True) is not True,
        "another model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added tokens that are matched by more than their text": any(x.get(k) for x in meant.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")),
    }
    if found := [k for k, v in faults.items() if v]:
        raise ValueError(f"the tokenizer has {', '.join(found)}")


def added_tokens(definition: str) -> list[str]:
    return [x["content"] for x in json.loads(definition).get("added_tokens", [])]


class ChunkMemo:
    """``encode(texts)`` gives the encoded bytes of each text; they must be joinable.  ``whole``: strings whose texts are not cut."""

    def __init__(self, encode: Callable[[Sequence[str]], list[bytes]], whole: Sequence[str] = (), limit: int = MEMO):
        self.encode, self.whole, self.limit, self.known = encode, whole, limit, {}

    def text(self, text: str) -> bytes:
        if any(x in text for x in self.whole):
            return self.encode([text])[0]
        first, *rest = text.split(" ")
        found = list(map(self.known.get, rest))
        if None in found:
            lost = [i for i, x in enumerate(found) if x is None]
            if any(not rest[i] or rest[i][0].isspace() for i in lost):  # a space that no word follows
                first, *rest = _CUT.split(text)
                found = list(map(self.known.get, rest))
                lost = [i for i, x in enumerate(found) if x is None]
            if lost:
                new = list(dict.fromkeys(rest[i] for i in lost))
                got = dict(zip(new, self.encode([f" {x}" for x in new]), strict=True))
                for i in lost:
                    found[i] = got[rest[i]]
                if len(self.known) + len(got) <= self.limit:
                    self.known.update(got)
        return self.encode([first])[0] + b"".join(found)
