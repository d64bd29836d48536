"""Encoding by a tokenizer file, with each worker remembering pieces it has seen.

A text is cut where the tokenizer itself always cuts, at blanks and line feeds,
so the pieces' ids joined are the text's ids. Pieces repeat a great deal; a piece
is handed to the tokenizers library once and then looked up. Where a file lowers
all letters and cuts words from signs, so are pieces of plain letters: fewer are
different then. Texts on which a cut might change the result (other white space
next to blanks, special strings) go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

from feefloor.llm.common import kept

#: Most pieces a worker remembers. When they are reached the later half is dropped:
#: frequent pieces are met early, so what stays is what is asked for most.
REMEMBERED = 1_000_000
#: As many, where pieces are a tokenizer's own words: of these fewer are asked for again.
WORDS_REMEMBERED = 300_000
#: Characters of one text that are cut into pieces at a time.
BLOCK_CHARS = 1 << 20

_MARK = "<|"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BLANK_RUNS = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
_SAFE_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: Letters beside a-z on which the normalizer only lowers, each for itself.
_LETTERS = "À-ÖØ-öø-ÿŒœ"
_ODD = re.compile(f"[^\\x00-\\x7f{_LETTERS}]")
#: The pre-tokenizer's own words, of lowered text without odd characters.
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-z{_LETTERS}]+|[0-9]|[^ \t-\r0-9a-z{_LETTERS}]+")


def _blocks(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > BLOCK_CHARS:
        cut = _SAFE_CUT.search(text, begin + BLOCK_CHARS)
        if not cut:
            break
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


def _spaced_pieces(text: str) -> list[str]:
    return _BLANK_RUNS.findall(text)


def _bare_words(text: str) -> list[str]:
    """Words where all is plain, else what stands between blanks if it holds odd characters."""
    if not _ODD.search(text):
        return _WORDS.findall(text.lower())
    return [word for piece in text.replace("\n", " ").split(" ")
            for word in ((piece,) if _ODD.search(piece) else _WORDS.findall(piece.lower()))]


#: How a file's own pre-tokenizer treats blanks: kept as part of the next piece, or dropped;
#: which texts are not cut; which pieces are one word of its own (None: unknown).
STYLES: dict[str, tuple[Callable[[str], list[str]], Callable[[str], bool],
                        Callable[[str], bool] | None]] = {
    "byte_bpe_50k.json": (_spaced_pieces,
                          lambda t: _MARK in t or _OTHER_SPACE.search(t) is not None, None),
    "word_bpe_49k.json": (_bare_words, lambda t: _MARK in t, lambda p: not _ODD.search(p)),
}


class Encoder:
    """Texts to values folded from ids; ``value`` maps a list of ids to what is kept."""

    def __init__(self, path: str, value: Callable[[list[int]], object]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.value = value
        self.known: dict[str, object] = {}
        # A file without a known style is never cut.
        self.pieces, self.whole, self.word = STYLES.get(os.path.basename(path), (None,) * 3)

    def of_all(self, texts: list[str]) -> list[object]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [self.value(e.ids) for e in encoded]

    def of_words(self, words: list[str]) -> list[object]:
        """As ``of_all``, for words that the tokenizer does not cut: by one call."""
        encoded = self.library.encode(" ".join(words), add_special_tokens=False)
        ids: list[list[int]] = [[] for _ in words]
        for word, number in zip(encoded.word_ids, encoded.ids):
            ids[word].append(number)
        return list(map(self.value, ids))

    def learn(self, pieces: list[str]) -> None:
        """Remember the values of ``pieces``, which are different."""
        words = list(filter(self.word, pieces)) if self.word else []
        rest = list(set(pieces).difference(words))
        if words:
            self.known.update(zip(words, self.of_words(words)))
        if rest:
            self.known.update(zip(rest, self.of_all(rest)))

    def parts(self, text: str) -> Iterator[list[object]]:
        """Values of the pieces of ``text`` in order, a block at a time."""
        if self.pieces is None or self.whole(text):
            yield self.of_all([text])
            return
        for block in _blocks(text):
            pieces = self.pieces(block)
            new = set(pieces).difference(self.known)
            if new:
                self.learn(list(new))
            found = [self.known[p] for p in pieces]
            most = WORDS_REMEMBERED if self.word else REMEMBERED
            if len(self.known) > most:
                self.known = dict(islice(self.known.items(), most // 2))
            yield found


#: Name under which workers keep their encoders, for ``map_arrow``.
KEPT = "encoders"
_encoders: dict[tuple[str, str], Encoder] = kept.setdefault(KEPT, {})


def encoder(path: str, name: str, value: Callable[[list[int]], object]) -> Encoder:
    """The worker's encoder for a file and a named kind of value."""
    if (path, name) not in _encoders:
        _encoders[path, name] = Encoder(path, value)
    return _encoders[path, name]


def version_digest(path: str) -> str:
    """SHA-256 of the tokenizer file, the library's version and the way it is called."""
    import tokenizers

    with open(path, "rb") as file:
        content = hashlib.file_digest(file, "sha256").hexdigest()
    call = f"{content} tokenizers {tokenizers.__version__} add_special_tokens=False"
    return hashlib.sha256(call.encode()).hexdigest()
