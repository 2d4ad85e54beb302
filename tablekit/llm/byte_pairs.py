"""Byte-level pair vocabularies from tokenizer JSON files, and exact encoding of texts with very long blank runs."""

from __future__ import annotations

import functools
import json
import re

import tiktoken

#: How byte-level vocabularies of this kind cut texts (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that \s stands for in it (fixed values of Unicode).
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The pattern's matcher gives up on longer runs of white space; such a run is one part, which needs no matcher.
LONG_RUN = 1 << 14
_LONG = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


def ordinary(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text under ``PATTERN``, however long its runs of white space.

    Before a visible character the pattern leaves the last white character of a run to the next part, so that the text may be cut there.
    """
    out, at = [], 0
    for run in _LONG.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[at : run.start()])
        out += encoder._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it can be seen, else the next ones from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}


@functools.lru_cache(maxsize=2)
def read_json(data: bytes) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a byte-level tokenizer file and the bytes of each id. Special tokens are plain text to it.

    The file's order of merges must be that of its ids, so that ids are ranks; other kinds of files raise.
    """
    read = json.loads(data)
    model, cutter = read["model"], read["pre_tokenizer"]
    special = {t["content"] for t in read.get("added_tokens", ())}
    plain = {p: i for p, i in model["vocab"].items() if p not in special}
    merged = [plain.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if (
        model["type"] != "BPE" or cutter != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cutter.get("trim_offsets"), "use_regex": True}
        or read.get("normalizer") or model.get("dropout") or None in merged or merged != sorted(merged) or len(plain) != 256 + len(merged)
    ):
        raise ValueError("only byte-level vocabularies whose ids follow the order of merges")
    letters = _byte_letters()
    tokens = {i: bytes(map(letters.__getitem__, p)) for p, i in plain.items()}
    encoder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={b: i for i, b in tokens.items()}, special_tokens={})
    return encoder, [tokens.get(i, b"") for i in range(max(tokens) + 1)]
