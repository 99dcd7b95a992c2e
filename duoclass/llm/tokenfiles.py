"""Public tokenizer files: read once on the driver, sent to the tasks (a fixed few MB)."""

from __future__ import annotations

import json


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_json(path: str | None = None) -> dict:
    """The parts of a byte-level BPE file that encoding needs.

    Only files of that kind are accepted: no normalizer, byte-level splitting by the
    usual pattern without a leading space, no dropout, no other special settings.
    """
    with open(path or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        d = json.load(f)
    m, pre = d["model"], d["pre_tokenizer"]
    if d["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE file")
    if m.get("dropout") or m.get("unk_token") or m.get("continuing_subword_prefix") or m.get("end_of_word_suffix"):
        raise ValueError("not a plain byte-level BPE file")
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    added = {}
    for t in d["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError("added tokens with stripping or word rules are not supported")
        added[t["content"]] = t["id"]
    return {"vocab": m["vocab"], "merges": merges, "added": added}


def unigram_pieces(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file, in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
