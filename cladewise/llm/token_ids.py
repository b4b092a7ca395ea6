"""Token ids of whole texts by a public byte-level BPE.

``TextTokenizer`` gives what ``Tokenizer.encode(text, add_special_tokens=False)``
gives, several times faster. The vocabulary stands in two files: for one library
as merges and for another as ranks, which is faster. Both cut a text into words
by one pattern of letters, numbers, white space and the rest. Texts in which
every character's class is the same in each Unicode version go by the ranks;
others, those that hold a special token's string, and those with runs of white
space that are too long for the pattern's engine there go by the merges.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from functools import cache

import numpy as np

#: White space of this length is more than the pattern's engine is given.
LONGEST_RUN = 1000
_RUN, _TWO = re.compile(rf"\s{{{LONGEST_RUN}}}"), re.compile(r"\s\s")
#: Characters of this and above have no old class to compare with.
END = 0x30000


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(category: str) -> str:
    return category[0] if category[0] in "LNZ" else "C" if category == "Cn" else "other"


def _ranges(points: list[int]) -> str:
    edges = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    return "".join(f"{re.escape(chr(part[0]))}-{re.escape(chr(part[-1]))}" for part in np.split(np.array(points), edges))


@cache
def _unsure() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Unsure characters below U+10000, characters from there on, and unsure ones among these. Apart, as classes of the first kind are looked up and others searched."""
    old, bad = unicodedata.ucd_3_2_0, []
    for c in range(0x80, END):
        now, then = _class(unicodedata.category(chr(c))), old.category(chr(c))
        safe = now == _class(then) and now != "C" if then != "Cn" else now == "other"
        if not safe:
            bad.append(c)
    low, high = [c for c in bad if c < 0x10000], [c for c in bad if c >= 0x10000]
    return re.compile(f"[\x1c-\x1f\x85{_ranges(low)}]"), re.compile(f"[\U00010000-{chr(sys.maxunicode)}]"), re.compile(f"[{_ranges(high)}{chr(END)}-{chr(sys.maxunicode)}]")


def unsure(text: str) -> bool:
    """Whether some character's class may depend on the Unicode version: not assigned, or assigned late as letter, number or space, or changed since Unicode 3.2; or a control that only some count as white space."""
    low, far, high = _unsure()
    return bool(low.search(text)) or (not text.isascii() and bool(high.search("".join(set(far.findall(text))))))


def has_long_run(text: str) -> bool:
    """A long run covers two neighbours among the characters at every 500th place, so most texts need no search."""
    return bool(_TWO.search(text[:: LONGEST_RUN // 2])) and bool(_RUN.search(text))


class TextTokenizer:
    """special: whether a special token's string in a text is that token. Else it is ordinary text."""

    def __init__(self, ranks_path: str, merges_path: str, pattern: str, special: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.largest = max(ranks.values(), default=0)
        self.whole = Tokenizer.from_file(merges_path)
        self.whole.encode_special_tokens = not special
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()] if special else []

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text, 32 bits each; null has none."""
        if not text:
            return np.zeros(0, np.uint32)
        if unsure(text) or has_long_run(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_OPEN: dict[tuple, TextTokenizer] = {}


def tokenizer(ranks_path: str | None = None, merges_path: str | None = None, special: bool = True) -> TextTokenizer:
    """One for each worker process and kind."""
    import public_tokenizers

    key = ranks_path or tokenizer_file("byte_bpe_50k.tiktoken"), merges_path or tokenizer_file("byte_bpe_50k.json"), special
    if key not in _OPEN:
        _OPEN[key] = TextTokenizer(key[0], key[1], public_tokenizers.PATTERN, special)
    return _OPEN[key]
