"""The pieces of a public SentencePiece model. Its file is a parameter and never copied."""

from __future__ import annotations

from dataclasses import dataclass

MARK = "▁"
PIECE_MODEL = "piece_bpe_32k.model"


def model_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    """Text pieces with their scores, and the ids of the 256 byte pieces.

    Pieces with a mark behind their first character span words and are left out.
    """

    size: int
    pieces: dict[str, tuple[int, float]]
    bytes: list[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, raw = {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                raw[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and piece and MARK not in piece[1:]:
                pieces[piece] = (i, model.get_score(i))
        return cls(model.get_piece_size(), pieces, raw)
