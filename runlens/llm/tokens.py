"""Token ids by the tokenizers library, remembered piece by piece.

Both public vocabularies cut a text into pieces (words, numbers, runs of
signs) that the library's model encodes independently. Most pieces of a corpus
repeat, so a worker keeps the ids the model gave for each and encodes a piece
once. Texts that might be cut differently here (characters beyond Latin, rare
white space, the vocabulary's special tokens) and all texts under a vocabulary
that cuts in another way are encoded whole by the library.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

from runlens.llm.common import claim, keeps

#: Pieces whose ids a worker keeps at once, some 200 bytes each, unless it is told otherwise.
KEPT_PIECES = 400_000
#: Texts encoded together.
CHUNK = 200

#: Latin, and the usual dashes, quotes and currency signs.
_USUAL = [chr(i) for a, b in ((0, 0x250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)) for i in range(a, b)]


def _chars(kind: str) -> str:
    return "".join(re.escape(c) for c in _USUAL if unicodedata.category(c)[0] == kind)


_L, _N = _chars("L"), _chars("N")
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
#: How the two public vocabularies cut a text, letters first as no other branch can begin with one.
_CUT = {
    "byte": re.compile(rf" ?[{_L}]+|{_SUFFIX}| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"[{_L}]+|{_SUFFIX}|[{_N}]|[^\s{_L}{_N}]+"),
}
#: Characters that are not usual, and those that count as white space or change case in one place only.
_ODD = re.compile("[\x1c-\x1f\x85\xa0İɐ-‏ -  -₟⃀-\U0010ffff]")

#: The settings under which a vocabulary file cuts as _CUT does (fixed values of the public files).
_BYTE_CUT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_CUT = [{"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
_WORD_NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _without_offsets(step: dict) -> dict:
    return {k: v for k, v in step.items() if k != "trim_offsets"}


def cut_of(settings: dict) -> str | None:
    """byte or word where the file's own settings say that texts are cut so, else None."""
    before, cut = settings.get("normalizer"), settings.get("pre_tokenizer") or {}
    if before is None and _without_offsets(cut) == _BYTE_CUT:
        return "byte"
    if (before or {}).get("normalizers") == _WORD_NORMALISED and [_without_offsets(s) for s in cut.get("pretokenizers", [])] == _WORD_CUT:
        return "word"
    return None


class _Known(dict):
    """The ids of every piece as bytes; those of new ones are filled in later."""

    def __init__(self):
        self.new: dict[str, bytearray] = {}

    def __missing__(self, piece: str) -> bytearray:
        held = self[piece] = self.new[piece] = bytearray()
        return held


class PieceTokenizer:
    """Texts to ids as little-endian unsigned 32-bit integers, equal to the library's encode(text, add_special_tokens=False).

    Special tokens in a text are told apart as the library does by default;
    ``special_as_text`` takes them as ordinary text.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.kept, self.library = kept, Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        settings = json.loads(self.library.to_str())
        self.kind = cut_of(settings)
        self.special = [] if special_as_text else [t["content"].lower() for t in settings["added_tokens"]]
        if self.kind:
            self.cut, self.model = _CUT[self.kind].findall, self.library.model
            # How the library writes the bytes of each character, as its model wants them.
            self.letters = str.maketrans({c: "".join(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(c)) or c for c in _USUAL})
        self.known = _Known()

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """How the text is cut; None where it must be encoded whole."""
        if self.kind is None or _ODD.search(text):
            return None
        if self.kind == "word":
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        if any(s in text for s in self.special):
            return None
        return self.cut(text)

    def _learn(self) -> None:
        new, self.known.new = self.known.new, {}
        for piece, held in new.items():
            held[:] = array("I", [t.id for t in self.model.tokenize(piece.translate(self.letters))]).tobytes()
            self.known[piece] = bytes(held)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if len(self.known) > self.kept:
            self.known = _Known()
        found = [(text or "", self._pieces(text or "")) for text in texts]
        found = [(text, None if pieces is None else list(map(self.known.__getitem__, pieces))) for text, pieces in found]
        self._learn()
        return [self._whole(text) if held is None else b"".join(held) for text, held in found]


_tokenizer = functools.cache(PieceTokenizer)
keeps("pieces", _tokenizer.cache_clear)


def tokenizer(path: str, kept: int = KEPT_PIECES) -> PieceTokenizer:
    """One per worker process and file, while no other stage works there."""
    claim("pieces")
    return _tokenizer(path, kept)
