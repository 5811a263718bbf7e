"""Loading of public tokenizers in Python workers."""

from __future__ import annotations

import base64
import os
import re

import regex

from mathquarry.session import worker_cache

DEFAULT_NAME = "byte_bpe_50k"
DEFAULT_DIR = "/opt/tokenizers"

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Places where a token must begin whatever surrounds them: a run of letters,
#: of digits or of other signs ends.  After an apostrophe a contraction may go
#: on, so that place doesn't count.  Used with ``finditer``; the place is the
#: end of the match.
SAFE = regex.compile(r"\p{L}(?=[^\p{L}])|\p{N}(?=[^\p{N}])|[^\s\p{L}\p{N}'](?=[\s\p{L}\p{N}])", regex.V0)
#: The same for texts of ASCII only, with the faster library.
SAFE_ASCII = re.compile(r"[A-Za-z](?=[^A-Za-z])|[0-9](?=[^0-9])|[^\sA-Za-z0-9'](?=[\sA-Za-z0-9])", re.A)


def encoder(name: str = DEFAULT_NAME, folder: str = DEFAULT_DIR):
    """The ``tiktoken`` encoding of a vocabulary file, one per worker."""
    cache = worker_cache()
    key = ("encoder", name, folder)
    if key not in cache:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        cache[key] = tiktoken.Encoding(f"own-{name}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


def clean(text: str) -> str:
    """Text that can be encoded; lone surrogates become U+FFFD."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def safe_points(text: str) -> tuple[int, int]:
    """First and last place in the text where a token must begin; (-1, -1) if there is none."""
    if (m := SAFE.search(text)) is None:
        return -1, -1
    first, last = m.end(), m.end()
    back = 64
    while True:
        start = max(first, len(text) - back)
        for m in SAFE.finditer(text, max(0, start - 1)):
            last = max(last, m.end())
        if last > start or start == first:
            return first, last
        back *= 4
