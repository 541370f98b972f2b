"""Token ids of whole texts by the tokenizers library, with a bounded memo of the matches that a tokenizer's pattern cuts a text into.

The vocabularies here encode every match of their pattern by itself, so a text's ids are those of its matches one after the other.
Natural text repeats its matches: they are looked up, and the library sees each new one once. Texts of other than the characters in
``PLAIN``, on whose classes all regular-expression engines agree, go to the library whole. Tests compare with encoding in one go.

Cases: a null text is an empty one and has no ids; a very long text is encoded whole, its matches are held as long as its batch; a full
memo starts anew and changes no result.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Letters and numbers of the plain characters. The dotted capital I is none of them: its lower case is two characters.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
#: The pattern of byte-level vocabularies, and that of the word-level one, which drops white space and lower-cases.
_BYTE_MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
_WORD_MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

#: Matches held by one worker; beyond that the memo starts anew.
MEMO = 800_000
#: Words that go to the library in one string.
JOINED = 2000


class Encoder:
    """Text to ids as bytes of unsigned 32-bit integers (little-endian machines). words: a word-level vocabulary.

    New words of letters are joined in one string for the library. Its ids fall apart again where a word's first token (byte level:
    it has the space) or last token (word level: it has the end mark) stands, if as many words come out as went in.
    """

    def __init__(self, tokenizer, words: bool = False, memo: int = MEMO):
        self.tokenizer, self.words, self.limit, self.memo = tokenizer, words, memo, {}
        self.find = (_WORD_MATCH if words else _BYTE_MATCH).findall
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        space = byte_table()[0][32]
        self.marks = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith("</w>") if words else token.startswith(space)
        added = tokenizer.get_added_tokens_decoder().values()
        self.special = [] if tokenizer.encode_special_tokens else [t.content for t in added if t.special]

    def _one_by_one(self, matches: list[str]) -> None:
        for m, e in zip(matches, self.tokenizer.encode_batch_fast(matches, add_special_tokens=False), strict=True):
            self.memo[m] = array("I", e.ids).tobytes()

    def _joined(self, matches: list[str]) -> None:
        """Words of letters; at byte level each with the space before it."""
        for at in range(0, len(matches), JOINED):
            some = matches[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.words else "").join(some)], add_special_tokens=False)[0].ids, np.uint32)
            marked = np.flatnonzero(self.marks[ids])
            bounds = np.append(0, marked + 1) if self.words else np.append(marked, len(ids))
            if len(bounds) != len(some) + 1 or bounds[0] != 0 or bounds[-1] != len(ids):
                self._one_by_one(some)
                continue
            data, bounds = ids.tobytes(), (4 * bounds).tolist()
            self.memo.update(zip(some, [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))

    def _learn(self, missing: set[str]) -> None:
        letters, others = [], []
        for m in missing:
            word = m.isalpha() if self.words else m[0] == " " and m[1:].isalpha()
            (letters if word else others).append(m)
        self._joined(letters)
        self._one_by_one(others)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One result per text, in order; a null text is an empty one. New matches of all the texts are learnt at once."""
        cut: list[list[str] | None] = []
        for text in texts:
            text = text or ""
            plain = PLAIN.fullmatch(text) and not any(x in text for x in self.special)
            cut.append(self.find(text.lower() if self.words else text) if plain else None)
        found = [None if c is None else list(map(self.memo.get, c)) for c in cut]
        holes = [[] if f is None else [i for i, x in enumerate(f) if x is None] for f in found]
        if missing := {c[i] for c, at in zip(cut, holes, strict=True) for i in at}:
            if len(self.memo) + len(missing) > self.limit:
                self.memo = {}
            self._learn(missing)
            for f, c, at in zip(found, cut, holes, strict=True):
                for i in at:
                    f[i] = self.memo[c[i]]
        return [self._whole(t or "") if f is None else b"".join(f) for t, f in zip(texts, found, strict=True)]


def _library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    import tokenizers

    return tokenizers


@lru_cache(maxsize=4)
def file_encoder(path: str, words: bool = False, special_as_text: bool = True) -> Encoder:
    """The encoder of a tokenizers file. words: a word-level vocabulary. special_as_text: special tokens' strings in a text are ordinary
    text, as the files' own README sets it, so that no document can forge a document's end; else they are the special ids."""
    tokenizer = _library().Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return Encoder(tokenizer, words)


@lru_cache(maxsize=1)
def byte_table() -> tuple[dict[int, str], dict[str, int]]:
    """Byte to visible character and back, as byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return table, {c: b for b, c in table.items()}


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def rank_encoder(path: str) -> tuple[Encoder, list[bytes]]:
    """An encoder of a rank file, and the bytes of each id.

    Every way to split a token into two tokens is a merge, ordered by the token's rank, since a rank file joins any neighbours
    whose bytes together are a token.
    """
    import public_tokenizers

    t = _library()
    ranks = read_ranks(path)
    table, _ = byte_table()
    show = {token: "".join(table[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(show[token[:i]], show[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    model = t.models.BPE(vocab={show[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = t.Tokenizer(model)
    tokenizer.pre_tokenizer = t.pre_tokenizers.Sequence(
        [t.pre_tokenizers.Split(t.Regex(public_tokenizers.PATTERN), "isolated"), t.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return Encoder(tokenizer), by_id
