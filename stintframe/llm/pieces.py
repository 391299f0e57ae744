"""The pieces of a SentencePiece model file, as the operators on words need them."""

from __future__ import annotations

import math
from functools import cache
from typing import NamedTuple

#: The mark that stands for a space.
MARK = "▁"


class Pieces(NamedTuple):
    """``ids`` of the ordinary pieces, their ids in the order of the file being their rank; ``byte_ids`` of the 256 bytes."""

    ids: dict[str, int]
    byte_ids: list[int]
    file_scores: dict[int, float]

    def scores(self, kind: str = "rank") -> dict[int, float]:
        """Log-probabilities of the ordinary pieces.

        ``file``: the scores in the file, which are log-probabilities in a unigram model and the negative merge rank in a BPE
        one.  ``rank``: by the order of the file, for BPE files: merges stand in the order of their frequency, which falls
        about as 1 / (rank + 2.7).
        """
        if kind == "file":
            return self.file_scores
        if kind != "rank":
            raise ValueError(f"scores are by rank or file, not {kind}")
        total = sum(1 / (r + 2.7) for r in range(len(self.ids)))
        return {i: -math.log((r + 2.7) * total) for r, i in enumerate(self.ids.values())}


@cache
def pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    bytes_ = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    return Pieces(ids, [bytes_[f"<0x{b:02X}>"] for b in range(256)], {i: model.get_score(i) for i in ids.values()})
