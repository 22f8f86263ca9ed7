"""Public vocabularies, opened once in each process. A name is looked up in the installed package of vocabularies, a path is taken as it is."""

from __future__ import annotations

import base64
import os
from functools import cache

#: Another folder of vocabulary files than the installed package's; every executor has them.
FOLDER = os.environ.get("TESSERA_TOKENIZERS")
SPACE = "▁"


def path(name: str) -> str:
    if os.path.isabs(name):
        return name
    if FOLDER:
        return os.path.join(FOLDER, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def tiktoken_encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def sentencepiece_model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path(name))


@cache
def pieces(name: str) -> tuple[str, ...]:
    """The pieces of a SentencePiece model by id."""
    m = sentencepiece_model(name)
    return tuple(m.id_to_piece(i) for i in range(m.get_piece_size()))


@cache
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))
