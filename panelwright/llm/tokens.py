"""Exact token ids of public tokenizer files, cached by word.

The vocabulary lower-cases, drops white space and splits between letter,
digit and punctuation runs, so the ids of a text are those of its
white-space-separated chunks in order.  Chunks repeat, ids are looked up.
A chunk of Latin-1 letters, digits and ASCII marks is looked up by its parts, which
are the vocabulary's own: runs of letters, single digits, runs of marks.  Any
other goes through the tokenizer itself, as do apostrophes, which may start a part
of their own, and what may be a special token.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import dealt_words, ends_of, hold, uncollected

#: Entries of each of two generations of the cache of chunks, and of that of their parts.
CACHE, PARTS = 300_000, 700_000
#: A chunk as Latin-1 letters (one part, in normal form), ASCII marks but apostrophes (one part), and what is neither.
SPLIT = re.compile(r"([a-zß-öø-ÿÀ-ÖØ-Þ]*+)([!-&(-/:-@\[-`{-~]*+)(.*+)\n")
#: Chunks of several such parts, and the parts.
PLAIN = re.compile(r"[a-zß-öø-ÿÀ-ÖØ-Þ0-9!-&(-/:-@\[-`{-~]++")
PARTS_OF = re.compile(r"[a-zß-öø-ÿÀ-ÖØ-Þ]++|[0-9]|[!-&(-/:-@\[-`{-~]++")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of the Latin-1 letters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class WordTokenizer:
    """``ids(texts)``: for each UTF-8 text, its ids as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.fast = None
        if spec["model"].get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None:
            # the same merges over parts that are split and lower-cased already
            self.fast = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.final = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.final[[i for s, i in spec["model"]["vocab"].items() if s.endswith("</w>")]] = True
            self.letters = _byte_letters()
        if self.full.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def clear(self) -> None:
        """Empty the caches."""
        self.young, self.old, self.parts = {}, {}, {}

    def _learn_plain(self, cores: list[str]) -> None:
        for at in range(0, len(cores), 2000):
            some = cores[at : at + 2000]
            joined = " ".join(c.translate(self.letters) for c in some)
            ids = np.array(self.fast.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary's word ends do not delimit words")
            data, last = ids.astype("<u2").tobytes(), 0
            for c, e in zip(some, ends.tolist()):
                self.parts[c] = data[2 * last : 2 * e]
                last = e

    def _learn_whole(self, texts: list[str]) -> None:
        for at in range(0, len(texts), 2000):
            some = texts[at : at + 2000]
            for t, e in zip(some, self.full.encode_batch_fast(some, add_special_tokens=False)):
                self.parts[t] = np.array(e.ids, "<u2").tobytes()

    def _learn(self, rest: list[bytes]) -> list[bytes]:
        """The ids of chunks that no cache holds: from their parts, or from the tokenizer."""
        parts = self.parts
        if len(parts) > PARTS:
            parts.clear()
        split = SPLIT.findall(b"\n".join(rest).decode("utf-8", "replace") + "\n")
        core_new, whole_new, pieces = {}, {}, []
        for core, tail, more in split:
            if core and not more and self.fast:
                core = core if core in parts else core.lower()  # Latin-1 letters have one small form each
                if core not in parts:
                    core_new[core] = None
                if tail and tail not in parts:
                    whole_new[tail] = None
                pieces.append((core, tail) if tail else (core,))
            elif self.fast and "<|" not in (chunk := core + tail + more) and PLAIN.fullmatch(chunk):
                pieces.append(found := PARTS_OF.findall(chunk.lower()))
                for x in found:
                    if x not in parts:
                        (core_new if x.isalpha() else whole_new)[x] = None
            else:
                if (chunk := core + tail + more) not in parts:
                    whole_new[chunk] = None
                pieces.append((chunk,))
        self._learn_plain(list(core_new))
        self._learn_whole(list(whole_new))
        return [parts[x[0]] if len(x) == 1 else b"".join([parts[y] for y in x]) for x in pieces]

    def _known(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct chunks, in their order, from a cache's younger half, its older one, or learned."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        found = dict(zip(chunks, map(self.young.get, chunks)))
        new = [w for w, x in found.items() if x is None]
        if new:
            held = dict(zip(new, map(self.old.get, new)))
            rest = [w for w, x in held.items() if x is None]
            if rest:
                held.update(zip(rest, self._learn(rest)))
            found.update(held)
            self.young.update(held)
        return found

    @uncollected()
    def ids(self, texts: list[bytes]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and size < 1 << 20:
                size += len(texts[end])
                end += 1
            # white space and A-Z don't matter to the vocabulary, but for special tokens, which are written as they are
            words, index, size = dealt_words([t if b"<|" in t else t.lower() for t in texts[at:end]])
            data, ends = ends_of(words)
            data, ends = data.tobytes(), ends.tolist()
            known = self._known([data[a:b] for a, b in zip(ends, ends[1:])])
            # each occurrence's ids, end to end
            data, ends = ends_of(pa.array(list(known.values()), pa.large_binary()).take(pa.array(index)))
            stops = ends[np.concatenate(([0], np.cumsum(size)))].tolist()
            out += [data[a:b].tobytes() for a, b in zip(stops, stops[1:])]
            at = end
        return out


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """One tokenizer for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    found = _LOADED[path]
    hold("tokens", *_LOADED.values())
    return found


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
