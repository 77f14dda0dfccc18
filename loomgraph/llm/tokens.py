"""Tokenizers in workers: loaded once a process, with a bounded cache of words.

The tokenizers used here never join ids across a blank or a line feed, so a
text is cut there and each word's ids are looked up as bytes; a text's ids are
the joined bytes. A cache has at most `limit` words, then it starts anew, so
memory doesn't grow with the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import compress
from unicodedata import is_normalized

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHED_WORDS = 750_000
LONGEST = 48
#: Parts of words in a string that the model gets at once.
PARTS = 512
#: Characters of text that are looked up at once.
AT_ONCE = 1 << 21
_loaded: dict[tuple, object] = {}


def loaded(key: tuple, make: Callable[[], object]):
    """One object for each key in this process."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def forget() -> None:
    """Drops this process's tokenizers and their words: a worker outlives its operator, and the next one's needs the memory."""
    if _loaded:
        _loaded.clear()
        gc.collect()
        with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


class WordCache:
    """Joined ids of a text as bytes, by way of its words' ids.

    cut: splits a text into words that are encoded independently; encode:
    words to bytes, for a list of distinct words.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable[bytes]], limit: int = CACHED_WORDS):
        self.cut, self.encode, self.limit = cut, encode, limit
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size <= AT_ONCE:
                size += len(texts[stop] or "")
                stop += 1
            yield from self._some(texts[at:stop])
            at = stop

    def _some(self, texts: list[str | None]) -> Iterator[bytes]:
        cut = [self.cut(t) if t else () for t in texts]
        words = set().union(*cut)
        known, fresh = self.known, words.difference(self.known)
        if len(known) + len(fresh) > self.limit:
            known.clear()
            fresh = words
        fresh = list(fresh)
        known.update(zip(fresh, self.encode(fresh), strict=True))
        get = known.__getitem__
        for own in cut:
            yield b"".join(map(get, own))
        for w in fresh:
            if len(w) > LONGEST:
                del known[w]


def lowered(text: str) -> str:
    """The text in lower case, where that and Unicode's composed form are the same in either order; else the text itself."""
    low = text.replace("Σ", "σ").lower()
    return low if is_normalized("NFC", text) and is_normalized("NFC", low) else text


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(more))
        more += b not in own
    return out


_TAILS = ".,!?;:#*$%&|<>"


def word_bpe(path: str) -> WordCache:
    """Ids as little-endian 4-byte numbers, by a tokenizers file whose normalizer composes and lower-cases and whose pre-tokenizer parts letters from signs and drops white space.

    A new word of Latin letters with signs after it goes to the model straight
    away, in two parts, many at once; any other word goes through the whole
    tokenizer. The letters' ids are kept apart, since the same letters stand
    before many signs.
    """

    def make() -> WordCache:
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        fast = getattr(t, "encode_batch_fast", t.encode_batch)
        parts = Tokenizer(t.model)
        parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        fast_parts = getattr(parts, "encode_batch_fast", parts.encode_batch)
        suffix, letters = t.model.end_of_word_suffix, byte_letters()
        last = np.zeros(t.get_vocab_size(), bool)  # ids that end a part
        last[[i for x, i in t.get_vocab().items() if x.endswith(suffix)]] = True
        tails: dict[str, bytes] = {"": b""}
        cores: dict[str, bytes] = {}

        def ids(some: list[str]) -> Iterator[bytes]:
            spelled = [x if x.isascii() else "".join([letters[b] for b in x.encode()]) for x in some]
            for e in fast_parts([" ".join(spelled[i : i + PARTS]) for i in range(0, len(spelled), PARTS)], add_special_tokens=False):
                own = np.array(e.ids, "<u4")
                raw, at = own.tobytes(), 0
                for end in (4 * np.flatnonzero(last[own]) + 4).tolist():
                    yield raw[at:end]
                    at = end

        def learn(known: dict[str, bytes], some: set[str], limit: int) -> list[str]:
            """Those learnt that are too long to be kept."""
            fresh = some.difference(known)
            if len(known) + len(fresh) > limit:
                known.clear()
                fresh = some
            fresh = list(fresh)
            known.update(zip(fresh, ids(fresh), strict=True))
            return [x for x in fresh if len(x) > LONGEST]

        def encode(words: list[str]) -> list[bytes | None]:
            bare = [w.rstrip(_TAILS) for w in words]
            plain = [core.isalpha() and (core.isascii() or (max(core) < "\u0250" and is_normalized("NFC", core))) and core == core.lower() for core in bare]
            signs = [w[len(core) :] for w, core in zip(words, bare, strict=True)]
            long = learn(tails, set(compress(signs, plain)) - {""}, 10_000), learn(cores, set(compress(bare, plain)), CACHED_WORDS)
            tails[""] = b""
            rest = iter(fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
            out = [cores[core] + tails[tail] if p else np.array(next(rest).ids, "<u4").tobytes() for core, tail, p in zip(bare, signs, plain, strict=True)]
            for known, some in zip((tails, cores), long, strict=True):
                for x in some:
                    del known[x]
            return out

        return WordCache(lambda text: lowered(text).replace("\n", " ").split(" "), encode)

    return loaded(("word_bpe", path), make)


def byte_bpe(path: str):
    """A tiktoken encoding of a file of ranks, without special tokens."""

    def make():
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return loaded(("byte_bpe", path), make)
