"""A SentencePiece vocabulary with scores, and the automaton over its pieces."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick

#: Where the public vocabulary lies; a parameter of every operator that uses it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
#: Chunks that a task remembers before it forgets them all.
MEMORY = 400_000


@dataclass
class Vocabulary:
    """Pieces (text, id, score) that may match, byte pieces by value, and the unknown piece."""

    pieces: list[tuple[str, int, float]]
    bytes_: list[int] | None
    unknown: int
    size: int
    _made: dict = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        """Read a model file; its pieces count as a unigram vocabulary with the scores that the file gives."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_ = [], {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                bytes_[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((model.id_to_piece(i), i, model.get_score(i)))
        return cls(pieces, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, model.unk_id(), model.get_piece_size())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def automaton(self) -> ahocorasick.Automaton:
        """Aho-Corasick automaton whose outputs are (length, id, score); outputs at one end come longest first."""
        if "automaton" not in self._made:
            found = ahocorasick.Automaton()
            for text, number, score in self.pieces:
                found.add_word(text, (len(text), number, score))
            found.make_automaton()
            self._made["automaton"] = found
        return self._made["automaton"]

    @property
    def single(self) -> frozenset[str]:
        if "single" not in self._made:
            self._made["single"] = frozenset(p for p, _, _ in self.pieces if len(p) == 1)
        return self._made["single"]

    @property
    def unknown_score(self) -> float:
        return min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY

    @property
    def chunk(self) -> re.Pattern | None:
        """Parts of an escaped text between which no piece reaches; None if the vocabulary has no such places.

        They begin at a space mark that follows another character and, where no piece holds a newline,
        before and after newlines.
        """
        if "chunk" not in self._made:
            inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in self.pieces)
            newline = any("\n" in p for p, _, _ in self.pieces)
            stop = "" if newline else "\n"
            self._made["chunk"] = None if inner else re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|{stop}" if stop else ""))
        return self._made["chunk"]

    def chunks(self, text: str) -> list[str]:
        """The parts of a text, with its space marks."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.chunk.findall(marked) if self.chunk else [marked]
