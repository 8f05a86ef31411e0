"""A SentencePiece model's pieces, and cutting texts where no piece can lie across.

The model file is read with the ``sentencepiece`` library.  Its text form has
a leading space, and every space is written U+2581.
"""

from __future__ import annotations

import functools
import re

SPACE = "▁"
#: Score of what is no piece.
NONE = float("-inf")


class Vocabulary:
    """score: of each piece that text can become; ids; bytes: id of each byte's piece, if any.

    A text is cut into units before each run of spaces (no piece has a space
    after something else), and units into runs at pairs of characters that
    are in no piece side by side.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in text}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in text}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.most = max(map(len, self.score), default=1)
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.cuts_before_spaces = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        if model.normalize(" a  bﬁ\t") != f"{SPACE}{SPACE}a{SPACE}{SPACE}bﬁ\t" or not self.cuts_before_spaces:
            raise ValueError("only models without normalisation, whose spaces begin pieces, are supported")

    @functools.cached_property
    def matcher(self):
        """Automaton that finds every piece in a text, with (length, score, id)."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for piece, score in self.score.items():
            out.add_word(piece, (len(piece), score, self.ids[piece]))
        out.make_automaton()
        return out

    def runs(self, unit: str) -> list[str]:
        """The unit, cut at pairs of characters that no piece holds."""
        pairs, out, begin = self.pairs, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                out.append(unit[begin:i])
                begin = i
        out.append(unit[begin:])
        return out


UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def units(text: str) -> list[str]:
    """Units of a text in the model's form; none for an empty text."""
    if not text:
        return []
    return UNIT.findall(SPACE + text.replace(" ", SPACE))


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
